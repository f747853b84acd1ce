"""What is costly is evaluated once a row: hosts' answers are parsed, and texts folded, once, however often later steps name them."""

from pyspark.sql import functions as F

from paperlark.functions import names
from paperlark.operators import flows
from paperlark.operators import ingest as I
from paperlark.sources import schemas


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_folded_once(spark):
    df = spark.createDataFrame([("Mléko a pivo",), ("nic",), (None,)], "t string").select(names.categorize(F.col("t")).alias("c"), names.categorize_tags(F.split("t", " "), F.col("t")).alias("d"))
    assert [(r.c, r.d) for r in df.collect()] == [("ALKOHOL", "ALKOHOL"), ("OSTATNI", "OSTATNI"), ("OSTATNI", "OSTATNI")]
    # once in the array and at most once more where the plan asks whether it is null; it was once a word
    assert 1 <= _plan(spark.range(1).select(names.categorize(F.col("id").cast("string")))).count("translate(") <= 2


def test_answers_are_parsed_once(spark):
    body = '{"status": 1, "product": {"product_name": " New ", "categories_tags": ["en:dairies"]}}'
    answers = spark.createDataFrame([("1", 0, "{oops"), ("2", 1, body), ("3", 0, None)], "code string, host_rank int, body string")
    empty = lambda schema: spark.createDataFrame([], schema)
    found = I.look_up(answers.select("code"), empty(schemas.PRODUCTS), empty(schemas.CATALOG_PRODUCTS), empty(schemas.CATALOG_EANS), I.read_answers(answers))
    assert sorted((r.code, r.source, r.name, r.category, r.offline) for r in found.collect()) == [("1", "unknown", None, None, True), ("2", "online", "New", "MLECNE", False), ("3", "unknown", None, None, False)]
    table = spark.range(3).selectExpr("cast(id as string) code", "0 host_rank", "cast(id as string) body")
    assert _plan(I.look_up(table.select("code"), empty(schemas.PRODUCTS), empty(schemas.CATALOG_PRODUCTS), empty(schemas.CATALOG_EANS), I.read_answers(table))).count("from_json(") <= 1


def test_codes_are_looked_up_once(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    codes = spark.createDataFrame([("1", 5), ("2", 5)], "code string, scanned_at long")
    products = spark.createDataFrame([("1", "P", None, None, "OSTATNI", None, None, None, "x", "k", 3)], schemas.PRODUCTS)
    online = spark.createDataFrame([("9", 0, 1, "n", "c")], "code string, host_rank int, status int, name string, category string")
    items = spark.createDataFrame([(1, 7, "k"), (2, 7, "other"), (3, 8, "k")], "id long, receipt_id long, raw_key string").selectExpr("*", "0 position", "raw_key raw_name", "raw_key name", "1d quantity", "5L price", "1L discount")
    receipts = spark.createDataFrame([(7, "s", "b", 1), (8, "s", "b", 2)], "id long, store string, branch string, purchased_at long")
    out = flows.scan_codes(codes, products, empty(schemas.UNKNOWN_CODES), empty(schemas.CATALOG_PRODUCTS), empty(schemas.CATALOG_EANS), online, items, receipts)
    assert sorted((r.barcode, r.id, r.final_price) for r in out["history"].collect()) == [("1", 1, 4), ("1", 3, 4)]
    assert [(r.code, r.scanned_at) for r in out["unknown"].collect()] == [("2", 5)]
    # results read what was found, and no lookup is part of their tasks
    assert _plan(out["unknown"]).count("Join") <= 2 and _plan(out["products"]).count("Join") == 0
