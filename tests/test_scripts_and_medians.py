"""Marks of every script, medians of large groups, and the receipts of lines as a query."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperlark.functions.text import strip_diacritics
from paperlark.operators import analytics as A


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def test_every_sign_of_every_plane(spark):
    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(4)
    texts = ["a".join(signs[k : k + 100]) for k in range(0, len(signs), 100)] + ["", "Příliš žluťoučký kůň", "가각힣 한글", "ো\U0001d15e", "ß"]
    texts += ["".join(rng.choice(["e", "́", "각", "क", "़", "\U0001d15e", "ß", " "]) for _ in range(20)) for _ in range(50)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", strip_diacritics(F.col("t")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: plain(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("kind", ["long", "double", "int"])
def test_large_groups_are_narrowed_down(spark, monkeypatch, kind):
    monkeypatch.setattr(A, "MEDIAN_FEW", 20), monkeypatch.setattr(A, "MEDIAN_BINS", 8)
    rng = random.Random(2)
    draw = {"long": lambda: rng.choice([rng.randrange(-50, 10**12), 7, -(2**62)]), "double": lambda: rng.choice([rng.gauss(0, 1e9), rng.gauss(0, 1e-9), 0.5]), "int": lambda: rng.randrange(-(2**31), 2**31)}[kind]
    rows = [(rng.choice(["hot", "hot", None, f"g{rng.randrange(40)}"]), rng.randrange(2), draw() if rng.random() < 0.9 else None) for _ in range(3000)] + [("nulls", 0, None)]
    got = {(r.a, r.b): r.upper_median for r in A.upper_median(spark.createDataFrame(rows, f"a string, b int, v {kind}"), ["a", "b"], "v").collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).extend([] if v is None else [v])
    assert got == {k: sorted(v)[len(v) // 2] if v else None for k, v in groups.items()}
