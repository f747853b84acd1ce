"""Faults that were found once: caches that forget inside a slice, files that stay open, rows of one id."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paperlark.llm import bpe, kneser_ney, packing
from paperlark.llm.voronoi import Params, top_products
from paperlark.llm.words import word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    own = Tokenizer.from_file(PATH)
    own.no_truncation(), own.no_padding()
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture()
def small_caches(monkeypatch):
    for module, name in ((bpe, "CACHED"), (packing, "LIBRARY_CACHED")):
        monkeypatch.setattr(module, name, 50)


def test_more_chunks_than_the_cache_holds(small_caches):
    many = " ".join(f"w{i}x. {i}" for i in range(3000))
    texts = ["hello there", many, "a <|endoftext|> b", "hello again. hello", many[::-1], "<|startoftext|>hello", "hello there"]
    words = packing.LibraryWords(PATH)
    for _ in range(2):
        assert [x.tolist() for x in words.encode_all(texts)] == library_ids(texts)
    assert [bpe.WordBPE(PATH).encode(t).tolist() for t in texts] == library_ids(texts)


def test_packing_of_many_chunks_and_special_strings(spark):
    many = " ".join(f"{chr(97 + i % 26)}{i:x}q" for i in range(250_000))
    texts = [many, "a <|endoftext|> b", "hello there", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = dict(enumerate(len(x) + 1 for x in library_ids([t or "" for t in texts])))
    for pieces in (packing.pack(docs, PATH), corpus_pipeline.packing(spark, docs, "")):
        assert {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_few_files_are_open_at_a_time(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = kneser_ney.fit(df, tokens_per_shard=100)
    assert model.pair_shards == 302
    monkeypatch.setattr(kneser_ney, "MAPPED", 20)
    before = len(os.listdir("/proc/self/fd"))
    log, _ = kneser_ney.log_probabilities(model, *(lambda h, n: (np.insert(h, np.cumsum(n), kneser_ney.END), n + 1))(*word_hashes([t for _, t in rows])))
    assert len(kneser_ney.files(model).open) <= 20 and len(os.listdir("/proc/self/fd")) <= before + 40
    assert float(log.sum()) == pytest.approx(kneser_ney.score(df, model).agg(F.sum("score")).first()[0])


def test_rows_of_one_id_are_all_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(5, [1.0, 0.0]), (5, [3.0, 0.0]), (5, [3.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, -1.0]), (100, [0.5, 0.0]), (7, [])]
    rows += [(int(i), [float(x) for x in rng.normal(size=2)]) for i in rng.integers(0, 60, 300)] + [(200, [float(x) for x in rng.normal(size=2)]) for _ in range(30)]
    kinds = {(i, tuple(np.floor(1024 * np.pad(np.array(v, "float32").astype("float64"), (0, 2 - len(v)))).astype("int64").tolist())) for i, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for params in (Params(), Params(pivots=4, query_block=2, data_block=60)):
        got = top_products(df, F.col("vec_id") % 100 == 0, 10, params=params).toPandas()
        for q in (0, 100, 200):
            best = sorted((-(a * x + b * y), i) for j, (a, b) in kinds if j == q for i, (x, y) in kinds if i != q)[:10]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(zip(-mine.score, mine.vec_id)) == best and list(mine["rank"]) == list(range(1, 11))
    first = top_products(spark.createDataFrame([(5, [1.0, 0.0]), (5, [3.0, 0.0]), (100, [1.0, 0.0])], df.schema), F.col("vec_id") == 100).collect()
    assert [(r.vec_id, r.score) for r in first] == [(5, 3145728), (5, 1048576)]
