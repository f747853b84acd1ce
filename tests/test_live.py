"""Live reports after random edits against the batch reports."""

import random


from paperlark.operators import analytics as A
from paperlark.streaming import imports, live

ITEM = "id string, receipt_id long, name string, raw_key string, category string, price long, discount long"
RECEIPT = "id long, store string, branch string, purchased_at long, total long, total_discount long"
CHANGE = "kind string, sign int, id string, name string, raw_key string, category string, price long, discount long, purchased_at long, total long, total_discount long"


def rows_of(receipt, items, sign):
    at = receipt[3]
    return [("receipt", sign, None, None, None, None, None, None, at, receipt[4], receipt[5])] + [("purchase", sign, i[0], *i[2:], at, None, None) for i in items]


def batch_reports(spark, state):
    items = spark.createDataFrame([i for _, some in state.values() for i in some], ITEM)
    receipts = spark.createDataFrame([r for r, _ in state.values()], RECEIPT)
    return {
        "products": A.product_summaries(items, receipts), "categories": A.category_sums(items, receipts), "from": A.category_sums(items, receipts, 86_400_000 * 40),
        "months": A.month_sums(receipts, 3), "total": A.total_of(receipts, "total"), "saved": A.total_of(receipts, "total_discount", 86_400_000 * 40),
    }


def live_reports(views):
    return {
        "products": live.live_products(views), "categories": live.live_categories(views), "from": live.live_categories(views, "1970-02-10"),
        "months": live.live_months(views, 3), "total": live.live_total(views, "total"), "saved": live.live_total(views, "total_discount", "1970-02-10"),
    }


def test_random_edits(spark, tmp_path):
    rng, state, feed = random.Random(8), {}, []
    item = lambda r, k: (f"{r}-{k}", r, rng.choice(["a", "b", "c", None]), rng.choice(["k1", "k2", None]), rng.choice(["X", "Y", "Z"]), rng.randrange(100, 999), rng.randrange(0, 50))
    made = lambda r: ((r, "s", None, rng.choice([None, rng.randrange(0, 90) * 86_400_000 + 5]), rng.randrange(1000), rng.randrange(9)), [item(r, k) for k in range(rng.randrange(1, 4))])
    (tmp_path / "in").mkdir()
    for batch in range(4):
        rows = []
        for r in rng.sample(range(30), 30 if not batch else 8):
            old = state.pop(r, None)
            rows += rows_of(*old, -1) if old else []
            if not old or rng.random() < 0.7:
                new = made(r)
                if old and rng.random() < 0.5:  # only a price or a name changes
                    new = (old[0], [(*i[:2], rng.choice([i[2], "d"]), *i[3:5], rng.randrange(100, 999), i[6]) for i in old[1]])
                state[r] = new
                rows += rows_of(*new, 1)
        feed.append((rows, dict(state)))
        frame = spark.createDataFrame(rows, CHANGE)
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / str(batch)))
        every = lambda: spark.createDataFrame([("purchase", 1, i[0], *i[2:], r[3], None, None) for r, some in state.values() for i in some], CHANGE)
        live.keep_live(imports.watch_folder(spark, str(tmp_path / "in"), CHANGE), str(tmp_path / "out"), str(tmp_path / "state"), every).awaitTermination()
    views = live.read_views(spark, str(tmp_path / "out"))
    want, got = batch_reports(spark, state), live_reports(views)
    for name in want:
        columns = sorted(want[name].columns)
        assert sorted(map(repr, got[name].select(columns).collect())) == sorted(map(repr, want[name].select(columns).collect())), name
    assert views["newest"].count() <= 5
    # no changes, and the views of nothing
    same = live_reports(live.fold_changes(views, spark.createDataFrame([], CHANGE), spark.createDataFrame([], CHANGE), every()))
    assert sorted(map(repr, same["categories"].collect())) == sorted(map(repr, got["categories"].collect()))
    assert live.live_total(live.empty_views(spark), "total").first().total == 0
