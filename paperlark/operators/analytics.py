"""Spending questions over receipts and items.

receipts: id, store, branch, purchased_at (ms), total, total_discount, created_at, warning. items: id, receipt_id, position,
raw_name, raw_key, name, category, quantity, unit, unit_price, price, discount, catalog_id, image_url. Money is whole cents.
Every report is one declarative plan of built-in functions; latest rows are aggregates, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlark.functions.dates import from_millis, month_of, month_title
from paperlark.functions.money import per_unit
from paperlark.functions.text import strip_diacritics


def final_price() -> Column:
    return F.col("price") - F.col("discount")


def with_receipts(items: DataFrame, receipts: DataFrame) -> DataFrame:
    return items.join(receipts.select(F.col("id").alias("receipt_id"), "store", "branch", "purchased_at"), "receipt_id")


def since(df: DataFrame, start: int | None, column: str = "purchased_at") -> DataFrame:
    """Rows from start on; all of them, those without a date too, where start is None."""
    return df if start is None else df.where(F.col(column) >= start)


def product_summaries(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Of each name: category, raw_key, n, spent, last_price (of the newest item, ties to the largest id), last_at."""
    newest = F.struct(F.coalesce("purchased_at", F.lit(-(1 << 62))), F.col("id"))
    return with_receipts(items, receipts).groupBy("name").agg(
        F.min("category").alias("category"), F.min("raw_key").alias("raw_key"), F.count("*").alias("n"), F.sum(final_price()).alias("spent"),
        F.max_by(final_price(), newest).alias("last_price"), F.max("purchased_at").alias("last_at"),
    ).orderBy(F.desc("n"), F.desc("spent"), "name")


def receipt_list(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts with their number of items, newest first; without a date the time of saving counts."""
    counted = items.groupBy(F.col("receipt_id").alias("id")).agg(F.count("*").alias("item_count"))
    return (
        receipts.join(counted, "id", "left").select("id", "store", "branch", "purchased_at", "total", "warning", F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("purchased_at", "created_at").alias("at"))
        .orderBy(F.desc("at"), "id").drop("at")
    )


def priced(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """The purchases with the price of a unit, in any order."""
    return with_receipts(items, receipts).withColumns({"final_price": final_price(), "per_unit": per_unit(final_price(), F.col("quantity"))})


def price_history(items: DataFrame, receipts: DataFrame, *, name: str | None = None, raw_key: str | None = None) -> DataFrame:
    """The purchases of one product, by name or raw key, newest first, with the price of a unit; without either, those of every product, by raw key."""
    one = name is not None or raw_key is not None
    some = items.where(F.col("name") == name) if name is not None else items.where(F.col("raw_key") == raw_key) if one else items
    return priced(some, receipts).orderBy(*([] if one else ["raw_key"]), F.desc("purchased_at"), "id")


def raw_names(items: DataFrame) -> DataFrame:
    return items.groupBy("raw_key").agg(F.min("raw_name").alias("raw_name"), F.min("name").alias("name"), F.count("*").alias("n")).orderBy(F.desc("n"), "raw_key")


def category_sums(items: DataFrame, receipts: DataFrame, start: int | None = None) -> DataFrame:
    found = since(with_receipts(items, receipts), start)
    return found.groupBy("category").agg(F.sum(final_price()).alias("spent"), F.count("*").alias("n")).orderBy(F.desc("spent"), "category")


def month_sums(receipts: DataFrame, top: int = 24) -> DataFrame:
    """Spending of the newest months (a top-k report)."""
    dated = receipts.where("purchased_at is not null")
    return dated.groupBy(month_of(F.col("purchased_at")).alias("month")).agg(F.sum("total").alias("spent"), F.count("*").alias("receipts")).orderBy(F.desc("month")).limit(top)


def total_of(receipts: DataFrame, column: str, start: int | None = None) -> DataFrame:
    """One row: the sum of a column ('total' spent, 'total_discount' saved); 0 without rows."""
    return since(receipts, start).agg(F.coalesce(F.sum(column), F.lit(0)).alias(column))


def unmatched(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """Items that neither a mapping nor the catalog knows."""
    return items.where("catalog_id is null").join(mappings.select("raw_key"), "raw_key", "left_anti")


def unmatched_items(items: DataFrame, receipts: DataFrame, mappings: DataFrame) -> DataFrame:
    found = with_receipts(unmatched(items, mappings), receipts)
    return found.groupBy("store", "raw_key").agg(F.min("raw_name").alias("raw_name"), F.min("name").alias("name"), F.count("*").alias("n")).orderBy(F.desc("n"), "store", "raw_key")


def unmatched_count(items: DataFrame, mappings: DataFrame) -> DataFrame:
    return unmatched(items, mappings).agg(F.count_distinct("raw_key").alias("n"))


def items_of(items: DataFrame, receipt_id: int | None = None) -> DataFrame:
    """The items of one receipt, or of every one, in their places."""
    some = items if receipt_id is None else items.where(F.col("receipt_id") == receipt_id)
    return some.orderBy(*([] if receipt_id is not None else ["receipt_id"]), "position", "id")


def newest_first(df: DataFrame, column: str, key: str) -> DataFrame:
    """Products by updated_at, or unknown codes by scanned_at, the newest first, ties by key."""
    return df.orderBy(F.desc(column), key)


def products_of(products: DataFrame, raw_keys: DataFrame) -> DataFrame:
    """The products linked with the raw keys, with the key."""
    return raw_keys.select("raw_key").distinct().join(products, F.col("raw_key") == F.col("linked_raw_key"))


def table_counts(receipts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: how many receipts and catalog products there are."""
    return receipts.agg(F.count("*").alias("receipts")).join(F.broadcast(catalog.agg(F.count("*").alias("catalog"))))  # two single rows


def image_paths(receipts: DataFrame) -> DataFrame:
    return receipts.where("image_path is not null").select("image_path")


def picker(choices: DataFrame, text: str, top: int = 100) -> DataFrame:
    """The first ``top`` choices (label, sublabel, seq) whose label and sublabel hold the text, in the order of seq (a top-k report)."""
    both = choices.withColumn("_both", F.concat(F.col("label"), F.lit(" "), F.coalesce("sublabel", F.lit(""))))
    return search(both, text, column="_both").drop("_both").orderBy("seq").limit(top)


def catalog_by_ean(products: DataFrame, eans: DataFrame, ean: str | None = None) -> DataFrame:
    some = eans if ean is None else eans.where(F.col("ean") == ean)
    return some.join(products, "product_id")


def month_groups(receipts: DataFrame) -> DataFrame:
    """Sums by month under its Czech title, newest first, undated ones ('Bez data') last."""
    day = from_millis(F.col("purchased_at"))
    found = receipts.groupBy(F.date_trunc("month", day).alias("start")).agg(F.sum("total").alias("total"), F.count("*").alias("n"))
    return found.orderBy(F.desc_nulls_last("start")).select(month_title(F.col("start")).alias("title"), "total", "n")


def product_detail(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Of each name: purchases, sums, the average (fraction cut off), least and largest price of a unit, discounts, raw names in the order of the newest."""
    unit = per_unit(final_price(), F.col("quantity"))
    found = with_receipts(items, receipts).withColumn("pu", unit)
    spelt = found.groupBy("name", "raw_name").agg(
        F.count("*").alias("n"), F.sum(final_price()).alias("spent"), F.sum("pu").alias("pu"), F.count("pu").alias("pn"), F.min("pu").alias("min_unit"), F.max("pu").alias("max_unit"),
        F.count_if(F.col("discount") > 0).alias("discounted"), F.sum("discount").alias("saved"), F.max(F.coalesce("purchased_at", F.lit(-(1 << 62)))).alias("at"),
    )
    # a product has few spellings: only their sums meet
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("raw_name").isNotNull(), F.struct((-F.col("at")).alias("o"), "raw_name")))), lambda x: x["raw_name"])
    return spelt.groupBy("name").agg(
        F.sum("n").alias("n"), F.sum("spent").alias("spent"), F.expr("sum(pu) div sum(pn)").alias("avg_unit"), F.min("min_unit").alias("min_unit"), F.max("max_unit").alias("max_unit"),
        F.sum("discounted").alias("discounted"), F.sum("saved").alias("saved"), names.alias("_names"),
    ).select("*", F.array_join("_names", ", ").alias("raw_names"), F.size("_names").alias("spellings")).drop("_names")


def linked_stats(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Of each raw key: purchases, the whole mean of the final price, the newest date."""
    return with_receipts(items, receipts).groupBy("raw_key").agg(F.count("*").alias("n"), F.expr("sum(price - discount) div count(*)").alias("mean_price"), F.max("purchased_at").alias("last_at"))


def category_bars(sums: DataFrame) -> DataFrame:
    """Category sums with the length of their bar: the share of the largest, between 0.01 and 1."""
    most = sums.agg(F.greatest(F.max("spent"), F.lit(1)).alias("most"))  # one row
    ratio = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("spent").cast("double") / F.col("most")))
    return sums.join(F.broadcast(most)).select("category", "spent", ratio.alias("ratio"))


def search(products: DataFrame, text: str, category: str | None = None, column: str = "name", top: int | None = None) -> DataFrame:
    """Rows whose column holds the text anywhere, whatever the case and marks, and that are of the category, if one is named."""
    found = products if category is None else products.where(F.col("category") == category)
    plain = lambda c: strip_diacritics(F.lower(c))
    found = found.where(F.contains(plain(F.col(column)), plain(F.lit(text))))
    return found if top is None else found.limit(top)


def import_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row of counters over an import's outcomes (seq, outcome, saved_id, warned, error)."""
    of = lambda kind: F.col("outcome") == kind
    return outcomes.agg(
        F.count("*").alias("total"), F.count_if(of("saved")).alias("saved"), F.count_if(of("duplicate")).alias("duplicates"), F.count_if(of("failed")).alias("failed"),
        F.count_if(of("saved") & F.col("warned")).alias("with_warnings"), F.max_by(F.when(of("saved"), F.col("saved_id")), F.when(of("saved"), F.col("seq"))).alias("last_saved_id"),
        F.max_by(F.when(of("failed"), F.col("error")), F.when(of("failed"), F.col("seq"))).alias("last_error"),
    )


#: Groups of more distinct values than an even share of MEDIAN_SHARES, and than MEDIAN_FEW, are narrowed down instead of sorted.
MEDIAN_SHARES, MEDIAN_FEW, MEDIAN_BINS = 10_000, 100_000, 256


def upper_median(df: DataFrame, keys: list[str], column: str, *, weight: str | None = None) -> DataFrame:
    """Of each group the element in the upper middle of the sorted values, nulls aside; equal values are one row with a count.
    With weight, a row stands for as many equal ones as that column says.

    Small groups are summed up in order. For the large ones, MEDIAN_SHARES of them at most, the range that holds the middle is
    narrowed down: all their values are counted in bins where they are, by tasks that know the groups' ranges, until one value
    is left. So no group's values meet in one task. The column is numeric; a group of nulls has a null.
    """
    n = F.count(column) if weight is None else F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col(weight))), F.lit(0))
    counted = df.groupBy(*keys, F.col(column).alias("_value")).agg(n.alias("_n"))
    kind = counted.schema["_value"].dataType.simpleString()
    sizes = counted.groupBy(*keys).agg(F.count("_value").alias("_distinct"), F.sum("_n").alias("_all"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    least = max(MEDIAN_FEW, (sizes.agg(F.sum("_distinct")).first()[0] or 0) // MEDIAN_SHARES)
    large = sizes.where(F.col("_distinct") > least).select(*keys, "_low", "_high", F.expr("_all div 2").alias("_skip")).collect()
    spark, names = df.sparkSession, [f"_k{i}" for i in range(len(keys))]
    same = " and ".join(f"`{k}` <=> {n}" for k, n in zip(keys, names)) or "true"
    schema = ", ".join([f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)] + [f"_low {kind}", f"_high {kind}", "_skip long"])
    ranges = lambda rows: F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))  # noqa: E731  MEDIAN_SHARES rows at most
    small = counted.join(ranges(large).select(*names), F.expr(same), "left_anti") if large else counted
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = small.withColumns({"_upto": upto, "_all": F.sum("_n").over(group)})
    found = passed.groupBy(*keys).agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("_value"))).alias("upper_median"))
    done = []
    while large:
        done += [r for r in large if r[-3] == r[-2]]
        if not (large := [r for r in large if r[-3] != r[-2]]):
            break
        width = F.col("_high").cast("double") / MEDIAN_BINS - F.col("_low").cast("double") / MEDIAN_BINS
        share = F.least(F.lit(MEDIAN_BINS - 1), F.floor((F.col("_value").cast("double") - F.col("_low").cast("double")) / width).cast("int"))
        # the least value has a bin of its own, so that every round narrows
        bin_ = F.when(F.col("_value") == F.col("_low"), -1).otherwise(F.coalesce(share, F.lit(0)))
        inside = counted.where("_value is not null").join(ranges(large), F.expr(f"{same} and _value between _low and _high")).select(*names, bin_.alias("_bin"), "_value", "_n", "_skip")
        bins = inside.groupBy(*names, "_bin", "_skip").agg(F.sum("_n").alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # MEDIAN_BINS + 1 rows of a group
        hit = bins.withColumn("_upto", upto).where("_upto > _skip and _upto - _n <= _skip")
        large = hit.select(*names, "_low", "_high", (F.col("_skip") - F.col("_upto") + F.col("_n")).alias("_skip")).collect()
    if not done:
        return found
    return found.unionByName(ranges(done).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_low").alias("upper_median")))
