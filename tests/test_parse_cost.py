"""How often the parser of receipts searches a line: expressions within arrays are not shared, so every copy of one is work."""

from pyspark.sql import functions as F

from paperlark.operators import receipts as R


def test_each_pattern_is_searched_once_a_group(spark):
    limit = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        parsed = R.parse_receipts(spark.createDataFrame([], "seq long, rows array<string>"))
        plan = parsed._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", limit)
    assert [plan.count(p) for p in (R.ITEM, R.DISCOUNT, R.QUANTITY, R.AFTER_DISCOUNT)] == [3, 2, 2, 1]


def test_letters_that_only_ignored_cases_join(spark):
    """Long s, dotless i and the Kelvin sign count as s, i and k in the patterns that ignore cases."""
    rows = ["Mléko 20,00 B", "2 k\u017f x 10,00", "\u017fleva -1,00", "Cena po \u017fleve 15,00", "Rohlík 3,00", "me\u007a\u0131\u017fouc", "Pivo 9,00", "\u017fuma 18,00", "\u212a PLATB\u011a 18,00"]
    got = R.parse_receipts(spark.createDataFrame([(1, rows)], "seq long, rows array<string>")).first()
    assert (got.total, got.subtotal, [(i["rawName"], i["quantity"], i["discount"]) for i in got["items"]]) == (1800, 1800, [("Mléko", 2.0, 500), ("Rohlík", 1.0, 0)])


def test_rows_are_put_in_their_normal_form(spark):
    from paperlark.functions.text import normalize_row, normalize_rows

    rows = ["1 , 2 , 3", "1, 2, 3", " - 5,00", "a  b", "a\tb", "×|—3 ,5", "10,00", "x", "", None, "00"]
    got = spark.createDataFrame([(rows,)], "rows array<string>").select(normalize_rows(F.col("rows")).alias("a"), F.transform("rows", normalize_row).alias("b")).first()
    assert got.a == got.b and got.a[6] == "10,00"
