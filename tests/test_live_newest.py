"""All purchases are part of a batch's plan only where a product lost its newest one."""

from paperlark.streaming import live

PURCHASE = "sign int, id string, name string, raw_key string, category string, price long, discount long, purchased_at long"
RECEIPT = "sign int, purchased_at long, total long, total_discount long"


def test_all_purchases_are_read_only_when_needed(spark, tmp_path):
    none = spark.createDataFrame([], RECEIPT)
    first = spark.createDataFrame([(1, "a", "n", "k", "c", 5, 0, 10), (1, "b", "n", "k", "c", 6, 0, 20), (1, "c", None, "k", "c", 7, 0, 5)], PURCHASE)
    first.write.parquet(str(tmp_path / "every_purchase"))
    every = spark.read.parquet(str(tmp_path / "every_purchase"))
    views = live.fold_changes(live.empty_views(spark), first, none, every)
    newest = lambda v: sorted((r.name or "", r.id, r.price) for r in v["newest"].collect())
    assert newest(views) == [("", "c", 7), ("n", "b", 6)]
    older = live.fold_changes(views, spark.createDataFrame([(-1, "a", "n", "k", "c", 5, 0, 10)], PURCHASE), none, every.where("id <> 'a'"))
    assert newest(older) == [("", "c", 7), ("n", "b", 6)]
    gone = live.fold_changes(views, spark.createDataFrame([(-1, "b", "n", "k", "c", 6, 0, 20)], PURCHASE), none, every.where("id <> 'b'"))
    assert newest(gone) == [("", "c", 7), ("n", "a", 5)]
    reads = lambda v: "every_purchase" in str(v["newest"].inputFiles())
    assert (reads(views), reads(older), reads(gone)) == (False, False, True)
