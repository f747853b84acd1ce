"""Rows of words as rows against the rows built from a document's array, on overlapping, slanted and tied words."""

import random

import pytest

from paperlark.operators import analytics as A
from paperlark.operators.receipts import build_rows
from paperlark.operators.row_lines import row_lines


@pytest.mark.parametrize("batch", [10_000, 3])
def test_random_words(spark, monkeypatch, batch):
    monkeypatch.setattr(A, "MEDIAN_FEW", 5)
    rng, words = random.Random(batch), []
    for doc in range(40):
        slant = rng.choice([0.0, 3.0, -8.0])
        for k in range(rng.randrange(0, 60)):
            x, y, h = rng.randrange(0, 300), rng.uniform(0, 40 if doc % 2 else 400), rng.choice([8.0, 10.0, 11.0, 30.0, 0.0, None])
            words.append((doc, k, rng.choice(["a", "word", "longer", " x ", "", None, "é"]), float(x), y, x + 20.0, None if h is None else y + h, slant + rng.choice([0.0, 0.5, -0.25])))
    rng.shuffle(words)
    df = spark.createDataFrame(words, "doc_id int, seq long, text string, left float, top float, right float, bottom float, angle float")
    want = {r.doc_id: r.rows for r in build_rows(df).collect() if r.rows}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = row_lines(df)
        got = {}
        for r in found.orderBy("doc_id", "line_no").collect():
            got.setdefault(r.doc_id, []).append(r.line)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # words of one row that tie in x may stand in either order
    assert {d: [sorted(x.split()) for x in rows] for d, rows in got.items()} == {d: [sorted(x.split()) for x in rows] for d, rows in want.items()}
