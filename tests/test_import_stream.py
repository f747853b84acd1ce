"""The streaming import against the batch import, document by document; replays, stored keys, and what a batch reads."""

import shutil

from pyspark.sql import functions as F

from paperlark.operators import analytics as A
from paperlark.operators import flows
from paperlark.sources import schemas
from paperlark.streaming import imports, saving

DOCS = "seq long, rows array<string>"


def receipt(k, name="Chléb", price="10,00"):
    return ["Lidl", f"{name} {price} B", "Mléko 5,00", f"K PLATBĚ: {'15,00' if price == '10,00' else '14,00'}", f"01.01.26 {10 + k // 60:02}:{k % 60:02}"]


def tables(spark):
    mappings = spark.createDataFrame([("chleb", "Chleba", "PECIVO", None)], schemas.MAPPINGS)
    catalog = spark.createDataFrame([("lidl:1", "Lidl", "Mléko plnotučné", "Tatra", "1 l", "MLECNE", "m.png", None, None)], schemas.CATALOG_PRODUCTS)
    aliases = spark.createDataFrame([("lidl", "Mléko", "lidl:1", 0)], "store string, alias string, product_id string, seq int")
    return mappings, catalog, aliases


def test_stream_equals_batch_import(spark, tmp_path):
    rows = [(1, receipt(1)), (2, receipt(2)), (3, receipt(1)), (4, None), (5, ["nic", "zde"]), (6, ["Lidl", "Rohlík 3,00"]), (7, ["Lidl", "Rohlík 3,00"]), (8, receipt(3, price="9,00")), (9, receipt(4)), (10, receipt(2))]
    none_r, none_i = spark.createDataFrame([], schemas.RECEIPTS), spark.createDataFrame([], schemas.ITEMS)
    stored = spark.createDataFrame([(77, "Lidl|2026-01-01T10:04|1500")], "id long, unique_key string")
    (tmp_path / "in").mkdir()
    stored.write.parquet(str(tmp_path / "stored"))
    for k in range(0, 10, 3):
        spark.createDataFrame(rows[k : k + 3], DOCS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    read = lambda: imports.watch_folder(spark, str(tmp_path / "in"), DOCS, files_at_once=1)
    run = lambda: saving.import_stream(read(), str(tmp_path / "out"), str(tmp_path / "state"), *tables(spark), import_id="i", stored=saving.stored_keys(spark, str(tmp_path / "stored")))
    query = run()
    query.awaitTermination()
    # a batch reads its own three documents, once for each of the plan's three branches, and in the first one the stored keys
    assert len(query.recentProgress) >= 4 and max(p["numInputRows"] for p in query.recentProgress) <= 3 * 3 + 1
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 4  # keys: three saved, one stored
    whole = flows.import_documents(spark.createDataFrame(rows, DOCS), I_append(none_r, stored), none_i, *tables(spark), import_id="i")
    outcomes = {r.seq: tuple(r) for r in whole["outcomes"].select("seq", "outcome", "saved_id", "warned", "error").collect()}
    assert {r.seq: tuple(r) for r in saving.saved(spark, str(tmp_path / "out"), "outcomes").select("seq", "outcome", "saved_id", "warned", "error").collect()} == outcomes
    assert outcomes[9][1:3] == ("duplicate", 77) and outcomes[3][2] == outcomes[1][2] and outcomes[6][2] != outcomes[7][2]
    counted = A.import_outcomes(whole["outcomes"]).first()
    assert (counted.total, counted.saved, counted.duplicates, counted.failed, counted.with_warnings) == (10, 5, 3, 2, 2)
    assert counted.last_error == "Na obrázku jsem nenašel účtenku (přečteno 2 řádků textu)" and outcomes[4][4] == "Obrázek se nepodařilo načíst"
    for name in ("receipts", "items"):
        want = whole[name].where("unique_key is distinct from 'Lidl|2026-01-01T10:04|1500'") if name == "receipts" else whole[name]
        got = saving.saved(spark, str(tmp_path / "out"), name)
        columns = sorted(set(got.columns))
        assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())), name
    named = {r.raw_name: (r.name, r.category, r.brand, r.catalog_id) for r in saving.saved(spark, str(tmp_path / "out"), "items").collect()}
    assert named["Chléb"][:2] == ("Chleba", "PECIVO") and named["Mléko"] == ("Mléko plnotučné", "MLECNE", "Tatra", "lidl:1")
    before = counts(spark, tmp_path)
    # a batch without outcomes does not count; batches that run again, as after a failure, replace themselves
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / "outcomes" / f"batch={last}")
    assert counts(spark, tmp_path)["outcomes"] < before["outcomes"]
    run().awaitTermination()
    assert counts(spark, tmp_path) == before


def I_append(receipts, stored):
    return receipts.unionByName(stored, allowMissingColumns=True)


def counts(spark, tmp_path):
    return {n: saving.saved(spark, str(tmp_path / "out"), n).count() for n in ("receipts", "items", "outcomes")}


def test_two_imports_share_no_ids(spark):
    none_r, none_i = spark.createDataFrame([], schemas.RECEIPTS), spark.createDataFrame([], schemas.ITEMS)
    docs = spark.createDataFrame([(0, ["Lidl", "Rohlík 3,00"])], DOCS)
    first = flows.import_documents(docs, none_r, none_i, *tables(spark))
    second = flows.import_documents(docs, first["receipts"], first["items"], *tables(spark))
    assert second["receipts"].select("id").distinct().count() == 2 and second["items"].select("id").distinct().count() == 2
    assert second["items"].select("receipt_id").distinct().count() == 2
