"""Reports that stay right while receipts change: sums are kept and changed by what changes, never computed anew.

A change is given as rows before it with sign -1 and rows after it with sign 1; an edit has both. Sums and counts take in the signs.
The newest purchase of a product is no sum: a newer row replaces it, and where the newest itself goes, that product alone is looked
up again among all purchases; which ones these are is written to the shared folder. What is kept: sums by day and category, by day, and by name with the counts of its categories
and raw keys, whose smallest ones the report shows. A batch costs its changes and the kept rows, whatever the number of purchases.

Rows: purchases(sign, id, name, raw_key, category, price, discount, purchased_at), receipts(sign, purchased_at, total, total_discount);
purchases without a date count on no day, and the newest of them only where a product has no dated one. Null names, categories and
keys are groups of their own, as in the reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlark.functions.dates import from_millis, month_of
from paperlark.operators.analytics import final_price
from paperlark.sources.shared import kept
from paperlark.sources.snapshots import current, read_snapshot, write_snapshot

#: What is kept: keys and sums of each view.
SUMS = {
    "categories": (("day", "category"), ("spent", "n")),
    "receipts": (("day", "month"), ("total", "total_discount", "n")),
    "products": (("name",), ("spent", "n")),
    "product_categories": (("name", "category"), ("n",)),
    "product_keys": (("name", "raw_key"), ("n",)),
}
_TYPES = {"day": "date", "month": "string", "category": "string", "name": "string", "raw_key": "string"}
NEWEST = "name string, at long, id string, price long"


def _day(at: str = "purchased_at") -> Column:
    return F.to_date(from_millis(F.col(at)))


def empty_views(spark: SparkSession) -> dict[str, DataFrame]:
    """The views of no purchases."""
    views = {name: spark.createDataFrame([], ", ".join([f"{k} {_TYPES[k]}" for k in keys] + [f"{s} long" for s in sums])) for name, (keys, sums) in SUMS.items()}
    return views | {"newest": spark.createDataFrame([], NEWEST)}


def _changes(purchases: DataFrame, receipts: DataFrame) -> dict[str, DataFrame]:
    """The signed sums of a change, by view."""
    spent, n = F.col("sign") * final_price(), F.col("sign")
    own = purchases.select(_day().alias("day"), "category", "name", "raw_key", spent.cast("long").alias("spent"), n.cast("long").alias("n"))
    told = receipts.select(_day().alias("day"), month_of(F.col("purchased_at")).alias("month"), *[(F.col("sign") * F.col(c)).cast("long").alias(c) for c in ("total", "total_discount")], n.cast("long").alias("n"))
    return {name: told if name == "receipts" else own for name in SUMS}


def _folded(old: DataFrame, change: DataFrame, keys: tuple, sums: tuple) -> DataFrame:
    both = old.select(*keys, *sums).unionByName(change.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).where("n <> 0")


def _newest(purchases: DataFrame) -> DataFrame:
    at = F.coalesce("purchased_at", F.lit(-(1 << 62)))
    best = F.max(F.struct(at.alias("at"), F.col("id").cast("string").alias("id"), final_price().cast("long").alias("price")))
    return purchases.groupBy("name").agg(best.alias("x")).select("name", "x.*")


def fold_changes(views: dict[str, DataFrame], purchases: DataFrame, receipts: DataFrame, all_purchases: DataFrame) -> dict[str, DataFrame]:
    """The views after a change; all_purchases are those after it, read for the products only whose newest purchase went."""
    changes = _changes(purchases, receipts)
    after = {name: _folded(views[name], changes[name], keys, sums) for name, (keys, sums) in SUMS.items()}
    # the newest purchases that go, looked up among the changes; an edited row comes again with its new values
    newest = views["newest"].select(F.col("name").alias("_n"), F.col("id").alias("_i"))
    gone = purchases.where("sign < 0").select("name", F.col("id").cast("string").alias("id"))
    lost = kept(gone.join(newest, F.expr("name <=> _n and id = _i")).select("_n").distinct())
    # all purchases are read only where a product lost its newest one
    again = views["newest"].limit(0) if lost.isEmpty() else _newest(all_purchases.join(lost, F.expr("name <=> _n"), "left_semi"))
    stays = views["newest"].join(lost, F.expr("name <=> _n"), "left_anti")
    new = _newest(purchases.where("sign > 0"))
    every = stays.unionByName(again).unionByName(new)
    newest = every.groupBy("name").agg(F.max(F.struct("at", "id", "price")).alias("x")).select("name", "x.*")
    return after | {"newest": newest}


def live_categories(views: dict[str, DataFrame], start: str | None = None) -> DataFrame:
    """Category sums, from a day on or of all purchases."""
    some = views["categories"] if start is None else views["categories"].where(F.col("day") >= F.lit(start).cast("date"))
    return some.groupBy("category").agg(F.sum("spent").alias("spent"), F.sum("n").alias("n"))


def live_months(views: dict[str, DataFrame], top: int = 24) -> DataFrame:
    """Spending of the newest months (a top-k report)."""
    return views["receipts"].where("month is not null").groupBy("month").agg(F.sum("total").alias("spent"), F.sum("n").alias("receipts")).orderBy(F.desc("month")).limit(top)


def live_total(views: dict[str, DataFrame], column: str, start: str | None = None) -> DataFrame:
    """One row: the sum of 'total' or 'total_discount', from a day on or of all receipts."""
    some = views["receipts"] if start is None else views["receipts"].where(F.col("day") >= F.lit(start).cast("date"))
    return some.agg(F.coalesce(F.sum(column), F.lit(0)).alias(column))


def live_products(views: dict[str, DataFrame]) -> DataFrame:
    """Product summaries, as ``analytics.product_summaries`` gives them."""
    least = lambda view, c: views[view].groupBy(F.col("name").alias(f"_{c}")).agg(F.min(c).alias(c))
    found = views["products"].join(least("product_categories", "category"), F.expr("name <=> _category")).join(least("product_keys", "raw_key"), F.expr("name <=> _raw_key"))
    newest = views["newest"].select(F.col("name").alias("_name"), F.col("price").alias("last_price"), F.nullif("at", F.lit(-(1 << 62))).alias("last_at"))
    return found.join(newest, F.expr("name <=> _name")).select("name", "category", "raw_key", "n", "spent", "last_price", "last_at")


def read_views(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_snapshot(spark, folder, name) for name in (*SUMS, "newest")} if current(spark, folder) else empty_views(spark)


def keep_live(purchases: DataFrame, folder: str, checkpoint: str, all_purchases: Callable[[], DataFrame]) -> StreamingQuery:
    """Keep the views of a folder up to date with a stream of changes; all views change at once.

    Each row has kind ('purchase' or 'receipt') and the columns of both; all_purchases gives the purchases after the batch. A batch
    that runs again after a failure finds its number in the pointer and changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = current(spark, folder)
        if told and told["number"] >= number:
            return
        batch = batch.persist()
        try:
            views = fold_changes(read_views(spark, folder), batch.where("kind = 'purchase'"), batch.where("kind = 'receipt'"), all_purchases())
            write_snapshot(folder, views, number)
        finally:
            batch.unpersist()

    return purchases.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
