"""What has no query of its own: single rows, tile edges, shown dates and details, rows of slanted words, lookups with faults."""

import math
import random

from pyspark.sql import functions as F

from paperlark.functions.dates import shown_date
from paperlark.functions.text import item_detail
from paperlark.operators import flows
from paperlark.operators import ingest as I
from paperlark.operators.receipts import build_rows, own_lines
from paperlark.sources import schemas


def test_rows_by_key_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "'s' || id as store").write.parquet(str(tmp_path / "r"))
    found = schemas.by_id(schemas.read_table(spark, str(tmp_path / "r"), schemas.RECEIPTS), "id", 7)
    assert [(r.id, r.store, r.branch) for r in found.collect()] == [(7, "s7", None)]
    assert "EqualTo(id,7)" in found._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_read_once(spark):
    lines = spark.createDataFrame([(0.0, 10.0), (95.0, 105.0), (99.0, 103.0), (190.0, 211.0)], "top float, bottom float")
    tiles = [(F.lit(0.0), F.lit(100.0)), (F.lit(100.0), F.lit(200.0)), (F.lit(200.0), F.lit(300.0))]
    assert [sorted(r.top for r in own_lines(lines, *t).collect()) for t in tiles] == [[0.0], [95.0, 99.0], [190.0]]


def test_shown_dates(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    row = spark.createDataFrame([(1767225600000 + 3_900_000, None)], "a long, b long").select(shown_date(F.col("a")).alias("a"), shown_date(F.col("a"), True).alias("t"), shown_date(F.col("b")).alias("b")).first()
    assert tuple(row) == ("1. 1. 2026", "1. 1. 2026 01:05", "bez data")


def test_item_details(spark):
    rows = [("Mléko", "MLEKO", 2.0, "ks", 995, "Sleva", 100), ("Mléko", "Mléko", 1.0, "ks", 995, None, 0), ("Sýr", "syr", 0.5, "kg", None, "Akce", 50), ("A", "A", 3.0, "ks", None, "Kupón", 0)]
    df = spark.createDataFrame(rows, "name string, raw string, q double, unit string, price long, label string, off long")
    got = [r.d for r in df.select(item_detail(*[F.col(c) for c in ("name", "raw", "q", "unit", "price", "label", "off")]).alias("d")).collect()]
    assert got == ["MLEKO · 2 ks × 9,95 Kč/ks · Sleva −1,00 Kč", "", "syr · 0,500 kg · Akce −0,50 Kč", "3 ks"]


def test_slanted_words_make_the_same_rows(spark):
    rng, words, want = random.Random(9), [], []
    for doc, degrees in enumerate((0.0, 7.0, -12.0)):
        turn, rows = math.radians(degrees), []
        for line in range(12):
            texts = [f"w{line}x{k}" for k in range(rng.randrange(1, 5))]
            rows.append(" ".join(texts))
            for k, t in enumerate(texts):
                x, y = 100.0 + 150 * k, 60.0 + 40 * line + rng.uniform(-6, 6)
                cx, cy = x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)
                words.append((doc, rng.randrange(1 << 30), t, cx - 40, cy - 10, cx + 40, cy + 10, degrees))
        want.append(rows)
    words.append((0, 5, "flat", 1.0, 5.0, 9.0, 5.0, 0.0)), words.append((0, 6, "  ", 1.0, 5.0, 9.0, 15.0, 0.0))
    df = spark.createDataFrame(words, "doc_id int, seq long, text string, left float, top float, right float, bottom float, angle float")
    got = {r.doc_id: r.rows for r in build_rows(df).collect()}
    assert [got[d] for d in range(3)] == want


def test_forced_and_faulty_lookups(spark):
    products = spark.createDataFrame([("1", "Old", None, None, "OSTATNI", None, None, None, "Ručně", "k", 3)], schemas.PRODUCTS)
    catalog = spark.createDataFrame([("c:2", None, "Listed", "B", "1 l", "MLECNE", "i", None, None)], schemas.CATALOG_PRODUCTS)
    eans = spark.createDataFrame([("2", "c:2")], schemas.CATALOG_EANS)
    body = '{"status": 1, "product": {"product_name": " New ", "brands": "X", "nutriscore_grade": "a", "categories_tags": []}}'
    answers = spark.createDataFrame([("1", 0, None), ("1", 1, body), ("2", 0, body), ("3", 0, "{oops"), ("3", 1, body), ("4", 0, '{"status": 1}'), ("4", 1, '{"status": 1, "product": {"product_name": " "}}'), ("4", 2, "")], "code string, host_rank int, body string")
    codes = spark.createDataFrame([("1", True), ("2", False), ("3", False), ("4", False), ("5", True)], "code string, force_online boolean")
    got = {r.code: r for r in I.look_up(codes, products, catalog, eans, I.read_answers(answers)).collect()}
    assert (got["1"].name, got["1"].source, got["1"].linked_raw_key, got["1"].mark, got["1"].brand) == ("New", "online", "k", "Open Beauty Facts", "X")
    assert (got["2"].name, got["2"].source, got["2"].mark, got["2"].quantity) == ("Listed", "catalog", "Katalog", "1 l")
    assert (got["3"].source, got["3"].offline, got["5"].source, got["5"].offline) == ("unknown", True, "unknown", False)
    assert got["4"].source == "unknown"
    items = spark.createDataFrame([], schemas.ITEMS)
    receipts = spark.createDataFrame([], schemas.RECEIPTS)
    unknown = spark.createDataFrame([("2", 1), ("9", 1)], schemas.UNKNOWN_CODES)
    out = flows.scan_codes(codes.withColumn("scanned_at", F.lit(8).cast("long")), products, unknown, catalog, eans, I.read_answers(answers), items, receipts, now=11)
    saved = {r.barcode: (r.name, r.brand, r.quantity, r.image_url, r.nutriscore, r.source, r.linked_raw_key, r.updated_at) for r in out["products"].collect()}
    assert saved == {"1": ("New", "X", None, None, "a", "Open Beauty Facts", "k", 11), "2": ("Listed", "B", "1 l", "i", None, "Katalog", None, 11)}
    assert {(r.code, r.scanned_at) for r in out["unknown"].collect()} == {("9", 1), ("3", 8), ("4", 8), ("5", 8)}
