"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct runs of five words. Equal sets are one class, and only classes are compared.

Sketch: in round i every element is thrown into one of t bins with a value that starts with i; a bin keeps its least
value. Rounds go on until all bins are filled; from round t on every element goes to bin i - t, so 2 t rounds always fill
all. Two sketches agree in a bin with the chance of the sets' Jaccard similarity. ``bands`` bands of ``rows`` bins are
hashed to buckets; with 40 bands of 6, a pair of similarity 0.85 shares no bucket with chance (1 - 0.85^6)^40 < 1e-8.

Buckets of up to ``small`` classes are compared pair by pair. Larger ones that share members make one group, whose
members are dealt to blocks of bounded size; each pair of blocks is one task, which finds the intersections between the two
(within the one, for a block with itself) by products of incidence matrices and gives out one row for each member that is
linked at all, never the pairs. Members leave before by
an exact bound: runs of words that no other member of any group has cannot be shared, and whoever has too many of them
reaches no set of the sizes at hand. Comparing a group of g classes takes g * g / (2 * block ** 2) small tasks.

Every link is confirmed on the full sets. Components come from alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import bounded, cut, slices, whole
from paperlark.llm.components import stars
from paperlark.llm.words import BASE, mix, runs, word_hashes

_COLUMNS = 2048


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 85
    bands: int = 40
    rows: int = 6
    small: int = 8
    block: int = 512
    block_elements: int = 500_000
    broadcast_ids: int = 2_000_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def sketch(elements: np.ndarray, of: np.ndarray, n: int, t: int) -> np.ndarray:
    """The n sketches, t 64-bit values each, of the sets whose elements are given; of: the set of each element."""
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, unset, "uint64")
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix(elements ^ np.uint64((i + 1) * BASE & 0xFFFFFFFFFFFFFFFF))
        bin_ = (h >> np.uint64(44)) % np.uint64(t) if i < t else np.uint64(i - t)
        np.minimum.at(out, of * t + bin_.astype("int64") if i < t else of * t + (i - t), (np.uint64(i) << np.uint64(52)) | (mix(h) >> np.uint64(12)))
        open_ = (out.reshape(n, t) == unset).any(axis=1)
        keep = open_[of]
        if not keep.all():
            elements, of = elements[keep], of[keep]
    return out.reshape(n, t)


def _sets(texts: list[str], words: int) -> list[np.ndarray]:
    h, n = word_hashes(texts)
    ends = np.cumsum(n)
    return [np.unique(runs(h[a:b], words)) for a, b in zip(ends - n, ends)]


def _prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; sums, so that equal sets have equal ones."""
    return int(mix(s).sum(dtype="uint64").view("int64")), int(mix(s ^ np.uint64(BASE)).sum(dtype="uint64").view("int64"))


def _describe(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = _sets(some.column(1).to_pylist(), p.words)
            sizes = np.array([len(s) for s in sets])
            filled = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), p.bands), "uint64")
            if len(filled):
                made = sketch(np.concatenate([sets[i] for i in filled]), np.repeat(np.arange(len(filled)), sizes[filled]), len(filled), p.bins)
                made = made.reshape(len(filled), p.bands, p.rows)
                k = np.broadcast_to(np.arange(p.bands, dtype="uint64") + np.uint64(1), made.shape[:2])
                for r in range(p.rows):
                    k = mix(k * np.uint64(BASE) + made[:, :, r])
                keys[filled] = k
            prints = [_prints(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(sizes.astype("int64")), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([x.tobytes() if m else None for x, m in zip(keys, sizes)], pa.binary())],
                names=["id", "n", "f1", "f2", "keys"],
            )

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, keys -> one row for each bucket of the node."""
    for batch in batches:
        keys = [np.frombuffer(x, "int64") for x in batch.column(1).to_pylist()]
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, "int64")])), batch.column(0).take(pa.array(at))], names=["key", "node"])


def _full_sets(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = _sets(some.column(1).to_pylist(), p.words)
            prints = [_prints(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "n", "f1", "f2", "elements"],
            )

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, elements -> one row for each element, cut to 32 bits: more may look shared than are, never fewer."""
    for batch in batches:
        for node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            e = np.frombuffer(x, "uint64").astype("uint32").view("int32")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), node)), pa.array(e)], names=["node", "e"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    """Two blocks of sets (or one, with itself) -> the stars of the links between them, by products of incidence matrices."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("second")
        node = rows["node"].to_numpy()
        first = int((~rows["second"].to_numpy(zero_copy_only=False)).sum())
        sets = [np.frombuffer(x.as_buffer(), "uint64") for x in rows["elements"]]
        size, n = np.array([len(s) for s in sets]), len(sets)
        kinds, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of, shared = np.repeat(np.arange(n), size), times > 1
        if first < n:  # between two blocks: only what occurs in both
            shared &= np.bincount(at[of < first], minlength=len(kinds)) < times
            shared &= np.bincount(at[of >= first], minlength=len(kinds)) < times
            left, right = slice(0, first), slice(first, n)
        else:
            left = right = slice(0, n)
        column, ok = np.cumsum(shared) - 1, shared[at]
        of, at = of[ok], column[at[ok]]
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        common = np.zeros((left.stop - left.start, right.stop - right.start), "float32")
        for low in range(0, int(shared.sum()), _COLUMNS):
            a, b = np.searchsorted(at, [low, low + _COLUMNS])
            here = np.zeros((n, _COLUMNS), "float32")
            here[of[a:b], at[a:b] - low] = 1
            common += here[left] @ here[right].T
        linked = 100 * common >= percent * (size[left, None] + size[None, right] - common)
        label = np.arange(n)
        while True:  # the smallest number within reach; jumping makes the steps few
            new = label.copy()
            new[left] = np.minimum(new[left], np.where(linked, new[None, right], n).min(axis=1, initial=n))
            new[right] = np.minimum(new[right], np.where(linked, new[left, None], n).min(axis=0, initial=n))
            new = new[new]
            if (new == label).all():
                break
            label = new
        least = np.full(n, np.iinfo("int64").max)
        np.minimum.at(least, label, node)
        to = least[label]
        keep = to != node
        return pa.table([pa.array(node[keep]), pa.array(to[keep])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id and kept.

    Texts whose sets have 100 * intersection >= percent * union are linked; component_id is the smallest id that links
    lead to, kept says that it is the row's own. Texts of fewer words than ``words`` have one run of all of them; null
    texts and those without words have none and are linked with nothing. Rows with equal ids are one node: they are
    kept, or not, together. Ids are whole numbers; a row with a null id has component null and is kept. Other columns
    of docs are ignored; an empty table gives no rows.
    """
    p = params
    slim = bounded(docs).select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    all_ = cut(slim.mapInArrow(_describe(p), "id long, n long, f1 long, f2 long, keys binary"))
    some = all_.where("n > 0 and id is not null")
    classes = cut(some.groupBy("f1", "f2", "n").agg(F.min("id").alias("node"), F.first("keys").alias("keys")))
    # an id with several texts is one node: it joins the classes of all of them
    repeated = cut(some.groupBy("id").agg(F.count("*").alias("k"), F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("k > 1"))
    own = repeated.where("x <> y").select("id")
    joined = some.join(own, "id").join(classes.select("f1", "f2", "node"), ["f1", "f2"]).select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    spread = classes.select("node", "keys").mapInArrow(_spread, "key long, node long")
    shared = spread.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("k")).where("low < high").select("key", "k")
    members = cut(spread.join(shared, "key").select("key", "node", "k"))
    nodes = cut(members.groupBy("node").agg(F.max("k").alias("k")))
    wanted = nodes.select(F.col("node").alias("id"))
    if nodes.count() <= p.broadcast_ids:
        wanted = F.broadcast(wanted)  # else texts are shuffled to the ids
    sets = slim.join(wanted, "id", "left_semi").mapInArrow(_full_sets(p), "node long, n long, f1 long, f2 long, elements binary")
    if not repeated.isEmpty():  # of their rows, one with the class's text
        again = sets.join(repeated.select(F.col("id").alias("node")), "node", "left_semi").join(classes.select("f1", "f2", "node"), ["f1", "f2", "node"])
        again = again.groupBy("node", "n", "f1", "f2").agg(F.first("elements").alias("elements"))
        sets = sets.join(repeated.select(F.col("id").alias("node")), "node", "left_anti").unionByName(again)
    sets = cut(sets.select("node", "n", "elements"))
    sized = cut(members.join(sets.select("node", "n"), "node").select("key", "node", "k", "n"))

    def reaches(n: Column, m: Column, common: Column) -> Column:
        """Whether sets of n and m elements with so many in common at most may be linked."""
        return 100 * common >= p.percent * (n + m - common)

    def confirmed(pairs: DataFrame) -> DataFrame:
        some = pairs.distinct()
        a = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        b = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        return some.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_confirm(p.percent), "a long, b long")

    def few_sent(told: DataFrame) -> DataFrame:
        """told, cut; broadcast where it has no more rows than broadcast_ids, so that a large group's members stay where they are."""
        told = cut(told)
        return F.broadcast(told) if told.count() <= p.broadcast_ids else told

    few = sized.where(F.col("k") <= p.small)
    left, right = few.select("key", F.col("node").alias("a"), F.col("n").alias("na")), few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    fits = reaches(F.col("na"), F.col("nb"), F.least("na", "nb"))
    links = stars(confirmed(left.join(right, "key").where(F.col("a") < F.col("b")).where(fits).select("a", "b")).union(joined))

    large = sized.where(F.col("k") > p.small)
    if not large.isEmpty():
        # buckets that share members make one group
        bundles = stars(large.join(large.groupBy("key").agg(F.min("node").alias("low")), "key").select(F.col("node").alias("a"), F.col("low").alias("b")).where("a <> b"))
        inside = large.select("node").distinct().join(bundles.select(F.col("a").alias("node"), F.col("b").alias("bundle")), "node", "left").withColumn("bundle", F.coalesce("bundle", "node"))
        full = sets.join(inside, "node")
        spoken = full.select("node", "elements").mapInArrow(_elements, "node long, e int")
        alone = spoken.groupBy("e").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
        # of a member with n elements, e of them shared with anyone: the largest set that it may be linked with
        e = F.col("n") - F.coalesce("alone", F.lit(0))
        cap = F.floor(e * 100 / p.percent).cast("long") + e - F.col("n")
        full = cut(full.join(alone, "node", "left").select("node", "bundle", "n", "elements", cap.alias("cap")))
        for _ in range(2):
            # who fits with nobody of the group leaves; each may make others leave
            sizes = few_sent(full.groupBy(F.col("bundle").alias("_bundle"), F.col("n").alias("m")).agg(F.max("cap").alias("most")))
            full = full.join(sizes, (F.col("bundle") == F.col("_bundle")) & (F.col("m") <= F.col("cap")) & (F.col("n") <= F.col("most")), "left_semi")
        counts = full.groupBy("bundle").agg(F.ceil(F.greatest(F.count("*") / p.block, F.sum("n") / p.block_elements)).cast("int").alias("blocks"))
        dealt = full.join(few_sent(counts), "bundle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("bundle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "elements")
        found = dealt.groupBy("bundle", "i", "j").applyInArrow(_compare(p.percent), "a long, b long")
        links = stars(links.union(found))
    label = classes.select("f1", "f2", "node").join(links.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("f1", "f2", F.coalesce("label", "node").alias("label"))
    linked = all_.where("n > 0 and id is not null").select("id", "n", "f1", "f2").join(label, ["f1", "f2"]).select("id", "n", "label")
    apart = all_.where("n = 0 or id is null").select("id", "n", F.col("id").alias("label"))
    out = linked.unionByName(apart)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), (F.col("label").eqNullSafe(F.col("id"))).alias("kept"))
