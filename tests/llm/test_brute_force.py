"""Classifiers, features and pipeline stages against plain versions."""

import math
import random
import re

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperlark.llm import png_media
from paperlark.llm.common import crc_fold
from paperlark.llm.components import stars
from paperlark.llm.minhash import near_duplicates
from paperlark.llm.qda import fit_quality, score_quality, statistics
from paperlark.llm.toxicity import Grams, fit_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(crc_fold("doc_id") != 0)
    return docs, labels, docs.toPandas(), labels.toPandas()


def test_quality_is_the_explicit_density(spark, corpus):
    docs, labels, texts, marks = corpus
    got = score_quality(docs, fit_quality(docs, labels), score_col="q").select("doc_id", "q").toPandas().set_index("doc_id").q
    x = {i: np.array(statistics(t or "")) for i, t in zip(texts.doc_id, texts.text)}
    own = [np.array([x[i] for i, q in zip(marks.doc_id, marks.quality) if q == k and i in x]) for k in (0, 1)]
    d = len(own[0][0])
    spread = [sum(np.outer(v - o.mean(axis=0), v - o.mean(axis=0)) for v in o) for o in own]
    pooled = (spread[0] + spread[1]) / (len(own[0]) + len(own[1]) - 2)
    logs = []
    for o, s in zip(own, spread):
        cov = 0.9 * s / (len(o) - 1) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + np.eye(d) * max(1e-6, 1e-3 * np.trace(pooled) / d)
        inverse, log_det = np.linalg.inv(cov), math.log(np.linalg.det(cov))
        share = math.log((len(o) + 0.5) / (len(own[0]) + len(own[1]) + 1))
        logs.append({i: 0.5 * (-0.5 * ((v - o.mean(axis=0)) @ inverse @ (v - o.mean(axis=0)) + log_det)) + share for i, v in x.items()})
    for i in x:
        gap = logs[1][i] - logs[0][i]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-gap)) if gap > -700 else 0, abs=1e-6)


def plain_grams(text, orders=(4, 6), bits=20):
    points, out, full = [ord(c) + 1 for c in f" {text.lower()} "], set(), (1 << 64) - 1
    for n in orders:
        for i in range(len(points) - n + 1):
            h = points[i] * 0x9E3779B97F4A7C15 & full
            for p in points[i + 1 : i + n]:
                h = ((h ^ h >> 29) * 0xFF51AFD7ED558CCD + p * 0x9E3779B97F4A7C15) & full
            out.add(((h ^ h >> 32) * 0x9E3779B97F4A7C15 & full) >> 64 - bits)
    return out


def test_grams():
    seen = np.zeros(1 << 20, "int32")
    for text in ("", "a", "abc", "The quick brown fox", "Σας 🙂 日本語" * 9, "aaaaaaaaaaaa"):
        found = Grams().of(text, seen).tolist()
        assert len(found) == len(set(found)) and set(found) == plain_grams(text)


def test_toxicity_is_the_optimum_over_scaled_features(corpus):
    docs, labels, texts, marks = corpus
    grams, penalty = Grams(orders=(4,), bits=12), 1e-2
    model = fit_toxicity(docs, labels, grams=grams, penalty=penalty)
    told = dict(zip(texts.doc_id, texts.text))
    rows = [(plain_grams(told[i] or "", (4,), 12), y) for i, y in zip(marks.doc_id, marks.toxic) if i in told and y in (0, 1)]
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    counts = np.zeros((2, 1 << 12))
    for g, y in rows:
        counts[y][list(g)] += 1
    ratio = np.log((counts[1] + 1) / (n1 + 2)) - np.log((counts[0] + 1) / (n0 + 2))
    ratio[(np.abs(ratio) < 1) | (counts.sum(axis=0) <= 1)] = 0
    assert not model.weights[ratio == 0].any() and model.weights.any()
    x = np.array([[ratio[k] if k in g else 0.0 for k in np.flatnonzero(ratio)] for g, _ in rows])
    y = np.array([y for _, y in rows], float)
    w = model.weights[ratio != 0] / ratio[ratio != 0]

    def loss(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - y * z).mean() + penalty / 2 * w @ w

    best, b, step = np.zeros(len(w)), 0.0, 1.0  # plain gradient descent
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(x @ best + b)))
        g, gb = x.T @ (p - y) / len(y) + penalty * best, (p - y).mean()
        while loss(best - step * g, b - step * gb) > loss(best, b) - step / 2 * (g @ g + gb * gb) and step > 1e-9:
            step /= 2
        best, b, step = best - step * g, b - step * gb, step * 1.5
    assert loss(w, model.bias) == pytest.approx(loss(best, b), abs=2e-4)
    assert np.abs((1 / (1 + np.exp(-(x @ w + model.bias)))) - (1 / (1 + np.exp(-(x @ best + b))))).max() < 0.05


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 2048, 2500, 30_000])
def test_feature_is_the_cosine_sums(n):
    random.seed(n)
    payload = bytes(random.randrange(32, 127) for _ in range(n))
    payload += bytes(-n % 64 if n else 64)
    image = np.frombuffer(payload, "uint8").reshape(-1, 64)
    h, w = image.shape
    pick = lambda k, of: range(k * of // 32, max((k + 1) * of // 32, k * of // 32 + 1))
    small = [[float(np.mean([[image[r][c] for c in pick(j, w)] for r in pick(i, h)])) for j in range(32)] for i in range(32)]
    cosine = lambda u, k: math.cos(math.pi / 32 * (k + 0.5) * u) * math.sqrt(2 / 32)
    low = [round(sum(small[i][j] * cosine(u, i) * cosine(v, j) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    low[0] = 0.0
    middle = sorted(low[1:])[31]
    bits = "".join("1" if x > middle else "0" for x in low)
    assert png_media.cosine_hash(png_media.decode(png_media.encode(payload))).hex() == f"{int(bits, 2):016x}"


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent):
    """rows: (id, text); equal ids are one node."""
    label = {i: i for i, _ in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return {i: find(i) for i in label}


def test_pipeline_stages(spark, corpus):
    docs, labels, texts, marks = corpus
    stages = dict(corpus_pipeline.STAGES)
    told = dict(zip(texts.doc_id, texts.text))
    model = fit_toxicity(docs, labels)
    clean = {i for i, s in zip(told, model.scores([t or "" for t in told.values()])) if s < 0.5}
    out = stages["toxicity"](spark, docs, FOLDER)
    rows = out.toPandas()
    assert out.columns == docs.columns and set(rows.doc_id) == clean and len(rows) == len(texts[texts.doc_id.isin(clean)])
    qda = fit_quality(out, labels)
    good = {i for i, s in zip(clean, qda.scores(np.array([statistics(told[i] or "") for i in clean]))) if s >= 0.3}
    second = stages["quality"](spark, out, FOLDER)
    assert second.columns == docs.columns and {r.doc_id for r in second.select("doc_id").collect()} == good
    kept = {i for i, c in components([(i, told[i]) for i in good], 80).items() if i == c}
    third = spark.createDataFrame(stages["near_duplicates"](spark, second, FOLDER).toPandas(), docs.schema)
    assert {r.doc_id for r in third.select("doc_id").collect()} == kept
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, third, FOLDER).toPandas().sort_values(["sequence_id", "offset"])
    sizes = {i: len(library.encode(told[i] or "", add_special_tokens=False).ids) + 1 for i in kept}
    assert pieces.groupby("doc_id").length.sum().to_dict() == sizes
    assert (pieces.groupby("sequence_id").length.cumsum() - pieces.length == pieces.offset).all() and pieces.groupby("sequence_id").length.sum().iloc[:-1].eq(2048).all()


def test_stages_of_odd_tables(spark, corpus):
    docs, *_ = corpus
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "word " * 30_000), (10**6 + 4, "one two three four five six"), (10**6 + 4, "one two three four five six"), (10**6 + 4, "a b c d e f")]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    own = ("score", "_score", "size", "statistics", "id", "kept")  # columns with the names that operators use
    both = docs.select("doc_id", "text").union(extra).select("*", *[F.lit(c).alias(c) for c in own])
    wanted = {i for i, c in components([(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()], 80).items() if i == c}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, FOLDER)
        assert out.columns == both.columns
        rows = out.toPandas()
        assert all((rows[c] == c).all() for c in own)
        if name == "near_duplicates":
            assert set(rows.doc_id) == wanted and (rows.doc_id == 10**6 + 4).sum() == 3
        assert stage(spark, both.where("doc_id < 0"), FOLDER).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, both, FOLDER).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in both.select("doc_id").collect()} and packed[packed.doc_id == 10**6].length.tolist() == [1]
    assert corpus_pipeline.STAGES[-1][1](spark, both.where("doc_id < 0"), FOLDER).count() == 0


def test_an_id_with_several_texts_joins_their_classes(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (2, text(2)), (2, text(3)), (2, text(3)), (3, text(3)), (4, text(2)), (5, text(5)), (5, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows) and got.groupby("doc_id").component_id.first().to_dict() == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5}


def test_stars_of_a_hub_and_of_nothing(spark):
    hub = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(5000).cast("long").alias("b")).union(spark.range(1, 200).select((F.col("id") + 6000).alias("a"), (F.col("id") + 6001).alias("b")))
    got = {r.a: r.b for r in stars(hub).collect()}
    assert got == {**{i: 1 for i in [*range(2, 3000), 5000]}, **{6000 + i: 6001 for i in range(2, 201)}}
    assert stars(hub.where("a < 0")).count() == 0 and stars(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
