"""The llm operators against brute force, exact round trips and libraries, with null, empty, long, tied and repeated rows."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperlark.llm import kneser_ney, png_media
from paperlark.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip
from paperlark.llm.bpe import load as load_bpe
from paperlark.llm.components import stars
from paperlark.llm.minhash import Params, near_duplicates
from paperlark.llm.packing import load as load_words
from paperlark.llm.packing import pack
from paperlark.llm.png_media import media_table
from paperlark.llm.qda import fit_quality, score_quality
from paperlark.llm.sharding import minimax_shards
from paperlark.llm.token_counts import load as load_counts
from paperlark.llm.token_counts import token_counts
from paperlark.llm.toxicity import fit_toxicity, score_toxicity
from paperlark.llm.voronoi import Params as Cells
from paperlark.llm.voronoi import top_products

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello's WORLD 123", "x" * 5000, "a b " * 3000, "same text here for all of us", "same text here for all of us", "Σας ὈΔΥΣΣΕΎΣ İ é", "<|endoftext|> in  text", "日本語 🙂\n\nnew\tline"]


@pytest.fixture(scope="module")
def docs(spark):
    # the extra columns have names that the operators use themselves
    rows = [(i, t, "s", 1.0, b"x") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "s", 1.0, b"x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, size double, ids binary").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def edge_texts(n=400):
    random.seed(1)
    signs = "ab ▁\n'sΣé1<|>endoftext́ tre.,!#"
    return ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(n)] + [t or "" for t in TEXTS]


def test_bpe_equals_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    library, own, words = Tokenizer.from_file(BPE), load_bpe(BPE), load_words(BPE)
    texts = edge_texts()
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.encode(t).tolist() for t in texts] == expected
    assert [x.tolist() for x in words.encode_all(texts)] == expected
    assert [own.decode(ids) for ids in expected] == [library.decode(ids, skip_special_tokens=False) for ids in expected]
    got = bpe_decode(bpe_encode(docs, BPE), BPE, ids_col="_ids").toPandas()
    assert all(r.decoded == own.decode(own.encode(r.text or "").tolist()) for r in got.itertuples(index=False))
    assert bpe_round_trip(docs, BPE).count() == len(TEXTS) + 1 and bpe_round_trip(none, BPE).count() == 0


def test_token_counts_equal_the_library(docs, none):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), load_counts(PIECES)
    for t in edge_texts():
        assert own(t) == len(library.encode(t))
    got = token_counts(docs, PIECES, limit=100).toPandas()
    assert all(r.n_tokens == len(library.encode(TEXTS[r.doc_id] or "")) and r.over_limit == (r.n_tokens > 100) for r in got.itertuples())
    assert token_counts(none, PIECES).count() == 0


@pytest.mark.parametrize("filters", [(f,) for f in png_media.FILTERS] + [tuple(png_media.FILTERS), ("none", "sub", "up")])
@pytest.mark.parametrize("rows", [1, 2, 40])
def test_png_round_trip(filters, rows):
    payload = np.random.default_rng(rows).integers(0, 256, rows * 64, dtype="uint8").tobytes()
    stored = png_media.encode(payload, 64, filters)
    assert png_media.decode(stored).tobytes() == payload
    for broken in (stored[:-1], stored[:40] + b"\0" + stored[41:], stored + b"x", b"", stored[8:]):
        with pytest.raises(png_media.BadImage):
            png_media.decode(broken)


def test_media_table(docs, none):
    got = media_table(docs).toPandas()
    for r in got.itertuples():
        data = (TEXTS[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.error is None and len(r.feature) == 16
    assert got.groupby("payload_sha256").feature.nunique().max() == 1 and media_table(none).count() == 0


def test_packing(docs, none):
    got = pack(docs, BPE, length=100).toPandas()
    own = load_bpe(BPE)
    ids = {i: np.append(own.encode(t or ""), np.uint32(1)).astype("<u4") for i, t in enumerate(TEXTS)}
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.length.sum() == sum(map(len, ids.values())) + len(ids[6])
    assert (got.groupby("sequence_id").length.sum().iloc[:-1] == 100).all() and pack(none, BPE).count() == 0


@pytest.mark.parametrize("blocks", [2, 2048])
def test_sharding_is_the_greedy_minimax(spark, docs, none, blocks):
    random.seed(blocks)
    rows = [(i, "t%d" % random.randint(0, 60) * random.randint(1, 4)) for i in range(400)] + [(400, None), (401, "")]
    got = minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7, blocks=blocks).toPandas()
    key = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    size = collections.Counter()
    for _, t in rows:
        size[key(t)] += len((t or "").encode()) + 1
    ends = list(np.cumsum([size[k] for k in sorted(size)]))

    def walk(capacity):
        at, cuts = 0, []
        for _ in range(7):
            i = bisect.bisect_right(ends, at + capacity) - 1
            if i < 0 or ends[i] <= at:
                return None
            at = ends[i]
            cuts.append(at)
            if at == ends[-1]:
                return cuts
        return None

    best = next(c for c in range(1, ends[-1] + 1) if walk(c))
    shard = dict(zip(sorted(size), (bisect.bisect_left(walk(best), e) for e in ends)))
    texts = dict(rows)
    assert all(shard[key(texts[r.doc_id])] == r.shard for r in got.itertuples()) and set(got.capacity) == {best}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert minimax_shards(docs).count() == len(TEXTS) + 1 and minimax_shards(none).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("params", [Params(), Params(small=2, block=4)])
def test_near_duplicates(spark, docs, none, params):
    random.seed(3)
    vocabulary = ["w%d" % i for i in range(500)]
    rows = [(100, None), (101, ""), (102, "one two"), (103, "One  two"), (104, "one two three four five six")]
    for base in range(6):
        text = [random.choice(vocabulary) for _ in range(120)]
        for copy in range(12):
            new = list(text)
            for _ in range(random.choice((0, 1, 1, 2, 3, 5))):
                new[random.randrange(len(new))] = random.choice(vocabulary)
            rows.append((1000 + base * 20 + copy, " ".join(new)))
    random.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=params).toPandas().set_index("doc_id")
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {i: find(i) for i in sets} == got.component_id.to_dict()
    assert all(got.n_shingles[i] == len(sets[i]) and got.kept[i] == (find(i) == i) for i in sets)
    assert near_duplicates(docs).count() == len(TEXTS) + 1 and near_duplicates(none).count() == 0


def test_stars_of_a_long_chain(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {tuple(r) for r in stars(chain).collect()} == {(i, 0) for i in range(1, 60)}


def test_top_products(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, None]), (903, [2.0]), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    known = {i: np.floor(1024 * np.pad(np.array(v, "float32").astype("float64"), (0, 8 - len(v)))).astype("int64") for i, v in rows if i < 900 or i == 903}
    for params in (Cells(), Cells(pivots=4, query_block=2, data_block=60)):
        got = top_products(df, F.col("vec_id") % 100 == 0, 10, params=params).toPandas()
        for q in (0, 100, 200, 300):
            best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:10]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(zip(-mine.score, mine.vec_id)) == best and list(mine["rank"]) == list(range(1, 11))
    assert top_products(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_kneser_ney_equals_the_formula(spark, docs, none):
    random.seed(5)
    rows = [(i, " ".join(random.choice("a b c d e f g the The x1".split()) for _ in range(random.randint(0, 30)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("doc_id % 3 <> 0")
    got = kneser_ney.score(df, kneser_ney.fit(train, tokens_per_shard=10, flush=50)).toPandas().set_index("doc_id")
    tokens = {i: [*words(t), "</s>"] for i, t in rows}
    own = [tokens[i] for i in tokens if i % 3]
    c = collections.Counter(w for t in own for w in t)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for t in own for p in zip(["<s>", *t], t))
    after = collections.Counter(w for _, w in pairs)
    total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (x, _), k in pairs.items():
        total[x] += k
        kinds[x][min(k, 3) - 1] += 1

    def discounts(counts):
        return kneser_ney._discounts(np.array([sum(k == j for k in counts.values()) for j in (1, 2, 3, 4)]))

    d1, d2, k = discounts(after), discounts(pairs), sum(after.values())
    spare = sum(d1[min(x, 3) - 1] for x in after.values()) / k
    one = lambda w: (max(after[w] - d1[min(after[w], 3) - 1], 0) / k if after[w] else 0) + spare / (v + 1)

    def two(x, w):
        if not total[x]:
            return one(w)
        m = pairs[x, w]
        return (max(m - d2[min(m, 3) - 1], 0) / total[x] if m else 0) + sum(a * b for a, b in zip(d2, kinds[x])) / total[x] * one(w)

    assert abs(sum(two("a", w) for w in c) + two("a", "never seen") - 1) < 1e-9
    for i, t in tokens.items():
        assert got.score[i] == pytest.approx(sum(math.log10(two(x, w)) for x, w in zip(["<s>", *t], t)))
        assert got.base_score[i] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert (got.n_tokens[i], got.n_known[i], got.train_tokens[i]) == (len(t), sum(w in c for w in t), n)
    assert kneser_ney.score(docs, kneser_ney.fit(none)).count() == len(TEXTS) + 1


def test_classifiers(spark, docs, none):
    folder = "/root/testdata/sf0.01"
    all_, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tox = fit_toxicity(all_, labels.where(~held))
    qda = fit_quality(all_, labels.where(~held))
    got = score_quality(score_toxicity(all_.join(labels, "doc_id").where(held), tox, score_col="t"), qda, score_col="q").toPandas()
    assert ((got.t >= 0.5) == (got.toxic == 1)).mean() > 0.9 and ((got.q >= 0.3) == (got.quality == 1)).mean() > 0.95
    assert not ((got.t >= 0.5) & (got.toxic == 0)).mean() > 0.03
    for model, scored in ((tox, score_toxicity), (qda, score_quality)):
        made = scored(docs, model).toPandas()  # docs has a column score already
        assert made["_score"].between(0, 1).all() and list(made["score"].unique()) == ["s"] and scored(none, model).count() == 0
    assert set(score_toxicity(docs, fit_toxicity(none, labels)).toPandas()["_score"]) == {0.5}
    nothing = fit_quality(none, labels)
    assert set(score_quality(docs, nothing).toPandas()["_score"]) == {0.5}
    assert isinstance(pd.Series(dtype=float), pd.Series)
