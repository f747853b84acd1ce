"""An interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays that workers map into memory.

Tokens are words, A to Z in lower case, and one end after each text; a start stands before the first as context only.

1. Words. Each task sums up its words' 64-bit hashes and deals the sorted runs, (hash, count), to shards by the hash's
   leading bits. A shard's runs are merged and written as one file: the sorted hashes, then the counts. A word's place in
   the row of all files is its number.
2. Pairs. Each task sums up its pairs of numbers (context << 32 | word) and deals the runs to shards by the context,
   those of very frequent contexts by the word too, so no shard grows with one word. Merged shards are files again.
3. What the pairs say of each number: as a context, the total and how many kinds occur once, twice and more often; as a word,
   after how many contexts it occurs. These sums are dealt by ranges of numbers and written as arrays.
4. Scoring. Texts' distinct words and pairs are looked up in the mapped files by binary search, in sorted order.

The driver receives one row for each shard: sizes, totals and counts of counts, from which the discounts come. Files are
written to the shared folder under a name of their own and then renamed, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import os
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import bounded, shared_path, slices, whole
from paperlark.llm.words import mix, word_hashes

END = np.uint64(0x2545F4914F6CDD1D)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view("uint8").reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "uint8").reshape(-1, n).T).view(kind).ravel()


def pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of 64-bit keys with 32-bit counts: differences of the upper halves, lower halves and counts, deflated."""
    upper, lower = (keys >> _32).astype("<u4"), (keys & _LOW).astype("<u4")
    return zlib.compress(_planes(np.diff(upper, prepend=np.uint32(0)).astype("<u4")) + _planes(lower) + _planes(counts.astype("<u4")), 1)


def unpack_run(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    upper, lower, counts = (_unplanes(raw[4 * i * n : 4 * (i + 1) * n], "<u4", n) for i in range(3))
    return (np.cumsum(upper, dtype="uint64") << _32) | lower, counts


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, "int64")
    return k[first], np.add.reduceat(c.astype("uint64"), first) if len(first) else c.astype("uint64")


def _write(path: str, *arrays: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        for a in arrays:
            f.write(a.tobytes())
    os.replace(own, path)


@dataclass
class Model:
    path: str
    word_bits: int = 6
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, "int64"))
    tokens: int = 0
    pair_shards: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, "uint64"))
    range_shards: int = 1
    discounts: tuple[tuple[float, float, float], tuple[float, float, float]] = ((0.5, 1.0, 1.5), (0.5, 1.0, 1.5))
    kinds: int = 0
    spare: float = 0.0

    @property
    def words(self) -> int:
        return int(self.starts[-1])

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        v = keys >> _32
        out = v * np.uint64(self.pair_shards) // np.uint64(self.words + 1)
        if len(self.hot):
            hot = np.isin(v, self.hot)
            out[hot] = (out[hot] + mix(keys[hot] & _LOW)) % np.uint64(self.pair_shards)
        return out.astype("int64")

    def range_of(self, shard: int) -> tuple[int, int]:
        n = self.words + 1
        return -(-shard * n // self.range_shards), -(-(shard + 1) * n // self.range_shards)


#: Files that a worker holds mapped; the ones used longest ago go first.
MAPPED = 400
#: A bound of the words whose pairs are dealt by the second word too; their numbers go to each task.
HOT_WORDS = 1_000_000


def _place(path: str, kind: str, shard: int) -> str:
    """Where a shard's file is: at most 4096 in a folder."""
    return f"{path}/{kind}/{shard >> 12:06d}/{shard:09d}"


class Files:
    """The mapped files of a model, a bounded number at a time and one mapping each."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()

    def arrays(self, kind: str, shard: int, n: int | None, *types: str) -> list[np.ndarray]:
        if (kind, shard) in self.open:
            self.open.move_to_end((kind, shard))
            return self.open[kind, shard]
        path = _place(self.model.path, kind, shard)
        data = np.memmap(path, "uint8", "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, "uint8")
        n = len(data) // sum(np.dtype(t).itemsize for t in types) if n is None else n if len(data) else 0
        at, out = 0, []
        for t in types:
            out.append(data[at : at + n * np.dtype(t).itemsize].view(t))
            at += n * np.dtype(t).itemsize
        self.open[kind, shard] = out
        if len(self.open) > MAPPED:
            self.open.popitem(last=False)  # unmapped, and its descriptor closed, when no array is left
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted distinct hashes, their numbers (-1: unknown) and counts."""
        m = self.model
        shard = (hashes >> np.uint64(64 - m.word_bits)).astype("int64")
        ids, counts = np.full(len(hashes), -1, "int64"), np.zeros(len(hashes), "int64")
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            known, number = self.arrays("words", int(s), None, "<u8", "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                found = known[at] == hashes[a:b]
                ids[a:b] = np.where(found, at + m.starts[s], -1)
                counts[a:b] = np.where(found, number[at].astype("int64"), 0)
        return ids, counts

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted distinct pairs, their counts."""
        shard, out = self.model.pair_shard(keys), np.zeros(len(keys), "int64")
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            some = order[a:b]
            known, number = self.arrays("pairs", int(shard[some[0]]), None, "<u8", "<u4")
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)
                out[some] = np.where(known[at] == keys[some], number[at], 0)
        return out

    def said(self, ids: np.ndarray) -> np.ndarray:
        """Of sorted distinct numbers, the columns total, kinds, once, twice (as context) and contexts (as word)."""
        m, out = self.model, np.zeros((5, len(ids)), "int64")
        shard = ids * m.range_shards // (m.words + 1)
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            low, high = m.range_of(int(s))
            columns = self.arrays("numbers", int(s), high - low, "<u8", "<u4", "<u4", "<u4", "<u4")
            for i, c in enumerate(columns):
                out[i, a:b] = c[ids[a:b] - low] if len(c) else 0
        return out


@lru_cache(2)
def _files(path: str) -> dict:
    return {}


def files(model: Model) -> Files:
    kept = _files(model.path)
    key = (model.tokens, model.pair_shards, model.kinds)
    if key not in kept:
        kept.clear()
        kept[key] = Files(model)
    return kept[key]


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with all tokens of their texts, the end after each, and the number of tokens of each text."""
    for some in slices(batches, column):
        h, n = word_hashes(some.column(column).to_pylist())
        yield some, np.insert(h, np.cumsum(n), END), n + 1


def _runs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A run for each shard; keys are sorted within each."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    edges = np.flatnonzero(np.diff(shard, prepend=-1))
    packed = [(int(shard[a]), pack_run(keys[a:b], counts[a:b])) for a, b in zip(edges, [*edges[1:], len(keys)])]
    if packed:
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in packed], pa.int32()), pa.array([r for _, r in packed], pa.binary())], names=["shard", "run"])


def _count(keys_of: Callable, shard_of: Callable, flush: int):
    """Task: sum up the keys of texts, and give them out in runs whenever there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out():
            k, c = merge(keys, counts)
            keys.clear(), counts.clear()
            yield from _runs(shard_of(k), k, c)

        for _, h, n in _texts(batches):
            k, c = np.unique(keys_of(h, n), return_counts=True)
            keys.append(k), counts.append(c)
            held += len(k)
            if held >= flush:
                yield from out()
                held = 0
        if held:
            yield from out()

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows sorted by shard -> each shard with its rows' other columns."""
    now, rows = None, []
    for batch in batches:
        shards, rest = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
        for s, *row in zip(shards, *rest):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append(row)
    if rows:
        yield now, rows


def _merged(rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
    runs = [unpack_run(r) for (r,) in rows]
    return merge([k for k, _ in runs], [c for _, c in runs])


def _grouped(runs: DataFrame, parts: int) -> DataFrame:
    return runs.repartition(parts, "shard").sortWithinPartitions("shard")


def _discounts(t: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys counted 1, 2, 3 and 4 times; fixed ones where these do not give any."""
    usual = (0.5, 1.0, 1.5)
    if t[0] <= 0 or t[1] <= 0 or t[2] <= 0:
        return usual
    y = t[0] / (t[0] + 2 * t[1])
    made = [(k + 1) - (k + 2) * y * t[k + 1] / t[k] for k in range(3)]
    return tuple(float(d) if 0 < d <= k + 1 else usual[k] for k, d in enumerate(made))


def fit(train: DataFrame, *, text_col: str = "text", tokens_per_shard: int = 1_000_000, flush: int = 4_000_000) -> Model:
    """Count the model of the texts of train; a null text is an empty one, which still has its end. An empty table gives a
    model that knows no word."""
    spark = train.sparkSession
    model = Model(shared_path(spark, "kneser-ney"))
    texts = bounded(train).select(whole(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # shards of words hold some 256 MB of text each, so that a task merges runs of bounded size
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model.word_bits = min(16, max(6, (size >> 28).bit_length()))
    bits, path = model.word_bits, model.path
    runs = texts.mapInArrow(_count(lambda h, n: h, lambda k: (k >> np.uint64(64 - bits)).astype("int64"), flush), "shard int, run binary")

    def write_words(batches):
        for shard, rows in _by_shard(batches):
            k, c = _merged(rows)
            _write(_place(path, "words", shard), k.astype("<u8"), c.astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["shard", "n", "tokens"])

    found = _grouped(runs, parts).mapInArrow(write_words, "shard int, n long, tokens long").collect()
    sizes = np.zeros(1 << bits, "int64")
    for r in found:
        sizes[r.shard] = r.n
    model.starts, model.tokens = np.concatenate(([0], np.cumsum(sizes))), sum(r.tokens for r in found)
    if not model.tokens:
        return model
    if model.words >= (1 << 32) - 1:
        raise ValueError("pairs hold 32-bit numbers of words")
    model.pair_shards = max(1 << 6, -(-model.tokens // tokens_per_shard))
    least = max(model.tokens // model.pair_shards, model.tokens // HOT_WORDS)

    def frequent(batches):
        """The numbers of the words that make up more than an even shard: fewer than there are shards."""
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                _, counts = files(model).arrays("words", shard, None, "<u8", "<u8")
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > least) + model.starts[shard])], names=["n"])

    shards = spark.range(0, 1 << bits, 1, min(1 << bits, parts)).where(F.col("id").isin([r.shard for r in found]) if len(found) < 1 << bits else F.lit(True))
    model.hot = np.array(sorted([model.words, *(r.n for r in shards.mapInArrow(frequent, "n long").collect())]), "uint64")

    def pair_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        kinds, at = np.unique(h, return_inverse=True)
        ids = files(model).numbers(kinds)[0][at].astype("uint64")
        before = np.roll(ids, 1)
        before[np.cumsum(n) - n] = model.words
        return (before << _32) | ids

    pairs = texts.mapInArrow(_count(pair_keys, model.pair_shard, flush), "shard int, run binary")
    model.range_shards = max(1 << 6, -(-model.words // tokens_per_shard))

    def write_pairs(batches):
        wide = model.words + 1
        for shard, rows in _by_shard(batches):
            k, c = _merged(rows)
            _write(_place(path, "pairs", shard), k.astype("<u8"), np.minimum(c, 0xFFFFFFFF).astype("<u4"))
            v, w = (k >> _32).astype("int64"), (k & _LOW).astype("int64")
            first = np.flatnonzero(np.diff(v, prepend=-1))
            columns = [c, np.ones(len(c), "int64"), *((c == i).astype("int64") for i in range(1, 5))]
            told = np.stack([v[first], *(np.add.reduceat(x.astype("int64"), first) for x in columns)])
            words, times = np.unique(w, return_counts=True)
            for kind, ids, data in ((0, told[0], told), (1, words, np.stack([words, times]))):
                to = ids * model.range_shards // wide
                edges = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(ids)]):
                    cut = data[:, a:b].astype("<i8")
                    cut[0] = np.diff(cut[0], prepend=0)
                    yield pa.RecordBatch.from_arrays([pa.array([int(to[a])], pa.int32()), pa.array([kind], pa.int32()), pa.array([zlib.compress(_planes(cut.reshape(-1)), 1)], pa.binary())], names=["shard", "kind", "data"])

    def write_numbers(batches):
        for shard, rows in _by_shard(batches):
            low, high = model.range_of(shard)
            context, word = np.zeros((6, high - low), "int64"), np.zeros(high - low, "int64")
            for kind, data in rows:
                raw = zlib.decompress(data)
                cut = _unplanes(raw, "<i8", len(raw) // 8).reshape(2 if kind else 7, -1)
                ids = np.cumsum(cut[0]) - low
                if kind:
                    word[ids] += cut[1]
                else:
                    context[:, ids] += cut[1:]
            _write(_place(path, "numbers", shard), context[0].astype("<u8"), *(x.astype("<u4") for x in (context[1], context[2], context[3], word)))
            times = [int((word == i).sum()) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([pa.array([[*context[2:].sum(axis=1).tolist(), *times, int(word.sum()), int((word > 0).sum())]])], names=["sums"])

    said = _grouped(_grouped(pairs, parts).mapInArrow(write_pairs, "shard int, kind int, data binary"), parts)
    sums = np.array([r.sums for r in said.mapInArrow(write_numbers, "sums array<long>").collect()]).sum(axis=0)
    model.discounts = (_discounts(sums[4:8]), _discounts(sums[0:4]))
    model.kinds = int(sums[8])
    d = model.discounts[0]
    model.spare = (d[0] * sums[4] + d[1] * sums[5] + d[2] * (sums[9] - sums[4] - sums[5])) / model.kinds
    return model


def _cut_by(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)


def log_probabilities(model: Model, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, the log10 probability after the one before, and its count in the training texts."""
    kinds, at = np.unique(h, return_inverse=True)
    if not model.tokens:
        return np.zeros(len(h)), np.zeros(len(h), "int64")
    f = files(model)
    ids, counts = f.numbers(kinds)
    known = np.flatnonzero(ids >= 0)
    said = np.zeros((5, len(kinds)), "int64")
    said[:, known] = f.said(ids[known])
    start = f.said(np.array([model.words]))
    one = (_cut_by(model.discounts[0], said[4]) / model.kinds + model.spare / (model.words + 1))[at]
    first = np.cumsum(n) - n
    total, types, once, twice = (np.roll(x[at], 1) for x in said[:4])
    for column, x in zip((total, types, once, twice), start[:4, 0]):
        column[first] = x
    now = ids[at]
    before = np.roll(now, 1)
    before[first] = model.words
    seen = np.flatnonzero((now >= 0) & (before >= 0) & (total > 0))
    keys, back = np.unique((before[seen].astype("uint64") << _32) | now[seen].astype("uint64"), return_inverse=True)
    pair = np.zeros(len(h), "int64")
    pair[seen] = f.pairs(keys)[back]
    d = model.discounts[1]
    held = np.maximum(total, 1)
    rest = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * (types - once - twice)) / held, 1.0)
    return np.log10(np.where(total > 0, _cut_by(d, pair) / held, 0.0) + rest * one), counts[at]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score (log10, add-half word shares) and score (log10, the model's).

    The end of a text counts as a token, so null and empty texts have one. Unknown words share one spare probability.
    Perplexity is 10 ** (-score / n_tokens). Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, h, n in _texts(batches, 1):
            log, c = log_probabilities(model, h, n)
            text = np.repeat(np.arange(len(n)), n)
            base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            sums = [np.bincount(text, x, len(n)) for x in (c > 0, base, log)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(n.astype("int64")), pa.array(sums[0].astype("int64")), pa.array(np.full(len(n), model.tokens)), pa.array(sums[1]), pa.array(sums[2])],
                names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    slim = bounded(docs).select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
