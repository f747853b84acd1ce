"""Text exports: items as CSV for spreadsheets, and what nothing recognised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlark.functions.dates import from_millis
from paperlark.functions.money import format_money
from paperlark.functions.names import category_label

#: The header of the items, behind a byte order mark; the headings of the other export.
HEADER = chr(0xFEFF) + "datum;obchod;pobočka;položka (účtenka);název;kategorie;množství;jednotka;cena;sleva;zaplaceno"
UNMATCHED_TITLE = "# %s – nerozpoznané produkty (%d položek, %d kódů)"
TITLE = "Export"
UNMATCHED_FORMAT = "# Formát: obchod | název na účtence | počet nákupů"
CODES_TITLE = "# Čárové kódy"


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def item_lines(items: DataFrame) -> DataFrame:
    """One line for each item with its receipt's store, branch and date; line, and the order in which they belong."""
    money = lambda c: format_money(c, False)
    line = F.concat_ws(
        ";", F.coalesce(F.date_format(from_millis(F.col("purchased_at")), "yyyy-MM-dd HH:mm"), F.lit("")), *[_quoted(F.col(c)) for c in ("store", "branch", "raw_name", "name")], _quoted(category_label(F.col("category"))),
        F.replace(F.col("quantity").cast("string"), F.lit("."), F.lit(",")), F.col("unit"), money(F.col("price")), money(F.col("discount")), money(F.col("price") - F.col("discount")),
    )
    return items.select("purchased_at", "position", "id", line.alias("line"))


def write_items(items: DataFrame, path: str) -> None:
    """Sorted lines as text files; the first begins with the header. Several files in order, so no task holds all lines."""
    spark = items.sparkSession
    head = spark.createDataFrame([(HEADER,)], "line string").select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("purchased_at"), F.lit(0).alias("position"), F.lit(None).cast(items.schema["id"].dataType).alias("id"), "line")
    body = item_lines(items).select(F.lit(1).alias("part"), "purchased_at", "position", "id", "line")
    head.unionByName(body).orderBy("part", "purchased_at", "position", "id").select("line").write.text(path)


def unmatched_lines(items: DataFrame, codes: DataFrame, title: str = TITLE) -> DataFrame:
    """The export of unknown items (store, raw_name, n) and codes (code, scanned_at), title first: line, and its order (section, rank, k1, k2)."""
    counts = items.agg(F.count("*").alias("a")).join(F.broadcast(codes.agg(F.count("*").alias("b"))))  # two single rows
    codes_only = lambda line: F.when(F.col("b") > 0, line)
    told = ((0, F.format_string(UNMATCHED_TITLE, F.lit(title), "a", "b")), (1, F.lit(UNMATCHED_FORMAT)), (2, F.lit("")), (4, codes_only("")), (5, codes_only(CODES_TITLE)))
    head = lambda section, line: F.struct(F.lit(section).alias("section"), F.lit(0).cast("long").alias("rank"), F.lit("").alias("k1"), F.lit("").alias("k2"), line.alias("line"))
    heads = counts.select(F.explode(F.array(*[head(*x) for x in told])).alias("h")).select("h.*").where("line is not null")
    some = items.select(F.lit(3).alias("section"), (-F.col("n")).alias("rank"), F.col("store").alias("k1"), F.col("raw_name").alias("k2"), F.concat_ws(" | ", "store", "raw_name", F.col("n").cast("string")).alias("line"))
    rest = codes.select(F.lit(6).alias("section"), (-F.col("scanned_at")).alias("rank"), F.col("code").alias("k1"), F.lit("").alias("k2"), F.concat(F.lit("EAN | "), F.col("code")).alias("line"))
    return heads.unionByName(some).unionByName(rest)


def write_unmatched(items: DataFrame, codes: DataFrame, path: str, title: str = TITLE) -> None:
    unmatched_lines(items, codes, title).orderBy("section", "rank", "k1", "k2").select("line").write.text(path)
