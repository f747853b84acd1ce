"""The relations of the purchase model over the benchmark tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows take long: one of fewer splits than cores, so of few bytes, is dealt out to all of them."""
    return _dealt(table(spark, folder, name))


def _dealt(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages (page, text), dealt out, and what they are (doc_id: the page, id: the document's own). Every row is a page, also
    where ids are null or repeated: it is numbered by its place in the files, before rows are dealt."""
    own = table(spark, folder, "documents").withColumn("page", F.monotonically_increasing_id())
    return _dealt(own.select("page", "text")), own.select(F.col("page").alias("doc_id"), F.col("doc_id").alias("id"))


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as receipts: the market segment is the store, the nation the branch."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    found = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return found.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("store"), F.col("n_name").alias("branch"), at.alias("purchased_at"), cents("o_totalprice").alias("total"),
        F.floor(cents("o_totalprice") / 20).alias("total_discount"), at.alias("created_at"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("warning"),
    )


def item_id() -> Column:
    """An item's id: the four columns of lineitem that tell rows apart."""
    return F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as items; the part is the product."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    found = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return found.select(
        item_id().alias("id"), F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("position"),
        F.concat_ws(" ", "p_name", "p_brand").alias("raw_name"), F.col("l_partkey").cast("string").alias("raw_key"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.col("l_quantity").alias("quantity"), F.lit("ks").alias("unit"), cents("l_extendedprice").alias("price"), F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long").alias("discount"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).alias("catalog_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("image_url"),
    )


def mappings(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size <= 10")
    return parts.select(F.col("p_partkey").cast("string").alias("raw_key"), F.upper("p_name").alias("name"), F.lit("OSTATNI").alias("category"), F.concat(F.lit("img/"), F.col("p_brand")).alias("image_url"))


#: The same relations in DuckDB SQL.
SQL = """with receipts as (
    select o_orderkey as id, c_mktsegment as store, n_name as branch, epoch_ms(o_orderdate) as purchased_at, cast(round(o_totalprice * 100) as bigint) as total,
        cast(round(o_totalprice * 100) as bigint) // 20 as total_discount, epoch_ms(o_orderdate) as created_at, case when o_orderpriority = '1-URGENT' then o_orderpriority end as warning
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
), items as (
    select lpad(cast(l_orderkey as varchar), 12, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, l_orderkey as receipt_id, l_linenumber as position,
        p_name || ' ' || p_brand as raw_name, cast(l_partkey as varchar) as raw_key, p_name as name, p_type as category, l_quantity as quantity, 'ks' as unit,
        cast(round(l_extendedprice * 100) as bigint) as price, cast(round(l_extendedprice * l_discount * 100) as bigint) as discount,
        case when p_size > 40 then p_brand end as catalog_id, case when p_size % 2 = 0 then p_brand end as image_url
    from lineitem join part on l_partkey = p_partkey
), mappings as (
    select cast(p_partkey as varchar) as raw_key, upper(p_name) as name, 'OSTATNI' as category, 'img/' || p_brand as image_url from part where p_size <= 10
), bought as (
    select i.*, r.store, r.branch, r.purchased_at from items i join receipts r on i.receipt_id = r.id
)
"""
