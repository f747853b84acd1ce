"""Catalog files, exports, schema versions, and saving batch by batch."""

import json

from paperlark.operators import ingest as I
from paperlark.operators.receipts import parse_receipts
from paperlark.sources import catalog, exports, schemas
from paperlark.streaming import imports


def test_catalog(spark, tmp_path):
    lines = ["", "// note", "{broken", json.dumps({"id": "1"}), json.dumps({"id": "1", "name": "Mléko", "store": "Lidl", "category": "MLECNE", "eans": ["00123", "x1"], "aliases": [" Mleko "]}), json.dumps({"id": "1", "name": "Mléko plné", "category": "?", "eans": ["00123"]})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    found = catalog.read_catalog(spark, str(tmp_path))
    assert [(r.product_id, r.name, r.category) for r in found["products"].collect()] == [("a:1", "Mléko plné", "OSTATNI")]
    assert [r.ean for r in found["eans"].collect()] == ["00123"]
    assert [(r.store, r.alias) for r in found["aliases"].collect()] == [("lidl", "Mleko")]


def test_files_by_name_whatever_their_size(spark, tmp_path):
    one = lambda k, **more: json.dumps({"id": str(k), "name": f"n{k}", "store": " Lidl ", "category": " mlecne ", "eans": ["77"], "aliases": ["same"], **more})
    for turn, (small, large) in enumerate((("a", "b"), ("b", "a"))):
        folder = tmp_path / str(turn)
        folder.mkdir()
        (folder / f"{small}.jsonl").write_text(one(1))
        (folder / f"{large}.jsonl").write_text("\n".join(one(k) for k in range(60)))
        found = catalog.read_catalog(spark, str(folder))
        last = "b:1" if small == "b" else "b:59"
        assert [tuple(r) for r in found["eans"].collect()] == [("77", last)] and [tuple(r) for r in found["aliases"].collect()] == [("lidl", "same", last)]
        row = found["products"].where("product_id = 'b:1'").first()
        assert (row.store, row.category) == ("Lidl", "MLECNE")


def test_lines_of_one_file_in_many_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"id": "1", "name": f"n{k:05}", "eans": ["5"]}) for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = catalog.read_catalog(spark, str(tmp_path))
        assert [r.name for r in found["products"].collect()] == ["n02999"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_words(spark, tmp_path):
    (tmp_path / "r1.tsv").write_text('1\t2\t3\t4\tahoj "x\n')
    (r,) = catalog.read_words(spark, str(tmp_path)).collect()
    assert (r.doc_id, r.text, r.right) == ("r1", 'ahoj "x', 3.0)


def test_item_export_bytes(spark, tmp_path):
    items = spark.createDataFrame([("a", None, 0, 'Obchod "U"', None, "raw", "Mléko", "MLECNE", 1.0, "ks", 123456, 6)], "id string, purchased_at long, position int, store string, branch string, raw_name string, name string, category string, quantity double, unit string, price long, discount long")
    exports.write_items(items, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*"))).decode()
    head, line = text.strip("\n").split("\n")
    assert head == exports.HEADER and head[0] == "﻿"
    assert line == ';"Obchod ""U""";"";"raw";"Mléko";"Mléčné výrobky a sýry";1,0;ks;1 234,56;0,06;1 234,50'


def test_old_schema_reads_as_null(spark, tmp_path):
    spark.createDataFrame([("k", "n", "c")], "raw_key string, name string, category string").write.parquet(str(tmp_path / "m"))
    assert schemas.read_table(spark, str(tmp_path / "m"), schemas.MAPPINGS).first().image_url is None


def test_batches_save_each_key_once(spark, tmp_path):
    rows = [(1, "k1", ["Lidl", "Chléb 10,00", "CELKEM 10,00", "01.01.26 10:00"]), (2, "k1", ["Lidl", "Chléb 10,00", "CELKEM 10,00", "01.01.26 10:00"]), (3, None, ["nic"])]
    df = spark.createDataFrame(rows, "seq long, tag string, rows array<string>")
    (tmp_path / "in").mkdir()
    df.write.parquet(str(tmp_path / "in" / "one"))
    for turn in range(2):
        stream = imports.watch_folder(spark, str(tmp_path / "in"), "seq long, tag string, rows array<string>")
        imports.save_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), parse_receipts).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 1
        df.withColumn("seq", df.seq + 10).write.mode("overwrite").parquet(str(tmp_path / "in" / "two"))


def test_reparse_keeps_what_is_not_read_again(spark):
    columns = "id long, store string, branch string, purchased_at long, total long, total_discount long, payment string, unique_key string, warning string, receipt_number string"
    stored = spark.createDataFrame([(1, "A", "b", 5, 10, 1, "Karta", "k", "w", "77"), (2, "Z", None, None, 1, 0, None, None, None, None)], columns)
    new = spark.createDataFrame([(1, "B", None, None, 20, 0, None, None, None, None)], columns)
    got = {r.id: tuple(r)[1:] for r in I.reparse(stored, new).collect()}
    assert got[1] == ("B", "b", 5, 20, 0, "Karta", "k", None, "77") and got[2][0] == "Z"
