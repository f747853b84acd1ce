"""Text rows from positioned words, for documents of any length: words stay rows until the line that they stand in is whole.

First pass: each document's slant and usual height, upper medians by counts; heights and angles are counted together, once, and the
counts are written to the shared folder. Second pass: words are shuffled once, by document, and sorted by turned height; a stream of
Arrow batches cuts them into rows. A word joins the row before it if it lies within half a usual height of that row's running mean;
as heights only grow, a row that is too far above once is so for good, and so one row is open at a time, and rows come top to bottom.
What the stream holds is the words of the open row. Rows that lie within the reach of their first word, most of them, are cut by whole
arrays; only in others the mean runs word by word.

Blank words and those without height count for nothing; nulls in places are 0; words that tie in height are taken in the order of seq,
and words of a row that tie in x in the order of height.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.operators.analytics import upper_median
from paperlark.sources.shared import kept

PLACES = ("left", "top", "right", "bottom", "angle")
#: What a word is blank by, and what is cut off its ends.
BLANKS = " \t\n\x0b\f\r"
#: Words that a task sorts, on average.
TASK_WORDS = 2_000_000
_LARGEST = float(np.finfo(np.float32).max)


def turned_words(words: DataFrame, blanks: str = BLANKS, told_of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """words(doc_id, seq, text, left, top, right, bottom, angle) -> doc_id, seq, text, x, y, near: turned by the document's slant, in
    single precision, with half its usual height, each document's in one partition; and the documents (doc_id, usual), of which
    those without a usable word have a null. The columns of told_of besides its doc_id follow in both."""
    more = [c for c in told_of.columns if c != "doc_id"] if told_of is not None else []
    single = lambda c: c.cast("float")
    within = lambda c: F.greatest(F.least(c, single(F.lit(_LARGEST))), single(F.lit(-_LARGEST)))
    place = lambda c: within(F.coalesce(F.nanvl(single(F.col(c)), single(F.lit(0))), single(F.lit(0)))).alias(c)
    placed = words.select("doc_id", "seq", "text", *map(place, PLACES))
    height = single(F.col("bottom") - F.col("top"))
    usable = F.coalesce((F.trim("text", F.lit(blanks)) != "") & (height > 0), F.lit(False))
    sizes = placed.select("doc_id", F.when(usable, height).alias("h"), F.when(usable & (F.char_length("text") >= 4), F.col("angle")).alias("a"))
    sizes = kept(sizes.groupBy("doc_id", "h", "a").agg(F.count("*").alias("n")))
    slants = upper_median(sizes, ["doc_id"], "a", weight="n").select(F.col("doc_id").alias("_d"), F.col("upper_median").alias("slant"))
    usual = upper_median(sizes, ["doc_id"], "h", weight="n").withColumnRenamed("upper_median", "usual")
    docs = usual.join(slants, F.expr("doc_id <=> _d")).drop("_d")
    if told_of is not None:
        docs = docs.join(told_of.withColumnRenamed("doc_id", "_d"), F.expr("doc_id <=> _d"), "left")
    docs = kept(docs.select("doc_id", "usual", "slant", *more))
    turn = F.radians(-F.coalesce("slant", F.lit(0.0)).cast("double"))
    told = docs.select(F.col("doc_id").alias("_d"), single(F.col("usual") * single(F.lit(0.5))).alias("near"), single(F.cos(turn)).alias("c"), single(F.sin(turn)).alias("s"), *more)
    # words of no document are one document: the join does not find them
    none = told.where("_d is null").select("near", "c", "s").first() or (None, None, None)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_WORDS + 1)
    two = single(F.lit(2))
    cx, cy = single((F.col("left") + F.col("right")) / two), single((F.col("top") + F.col("bottom")) / two)
    dealt = placed.where(usable).select("doc_id", "seq", F.trim("text", F.lit(blanks)).alias("text"), cx.alias("cx"), cy.alias("cy")).repartition(parts, "doc_id")
    # the documents of a partition are looked up in a map, so that the words are sorted only once
    found = dealt.join(told.hint("shuffle_hash"), F.col("doc_id") == F.col("_d"), "left")
    near, c, s = (F.coalesce(F.col(k), single(F.lit(v))) for k, v in zip(("near", "c", "s"), none))
    x, y = single(F.col("cx") * c) - single(F.col("cy") * s), single(F.col("cx") * s) + single(F.col("cy") * c)
    return found.select("doc_id", "seq", "text", single(x).alias("x"), single(y).alias("y"), near.alias("near"), *more), docs.select("doc_id", "usual", *more)


def _joining(ys: np.ndarray, near: np.float32, total: float, n: int) -> tuple[int, float, int]:
    """How many words join a row of n words with this sum of heights, one after the other, and what sum and number it has then."""
    mean = np.float32(total / n)
    for k, y in enumerate(ys):
        if not y - mean <= near:
            return k, total, n
        total, n = total + float(y), n + 1
        mean = np.float32(total / n)
    return len(ys), total, n


def _starts(ys: np.ndarray, near: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where rows begin among words by document and height; cut: words too far below the one before them, or of another document."""
    firsts = np.flatnonzero(cut)
    ends, more = np.append(firsts[1:], len(ys)), []
    # a mean lies between the first and the last word: all that are within reach of the first one are in its row
    wide = np.flatnonzero(~(ys[ends - 1] - ys[firsts] <= near[firsts]))
    for a, b in zip(firsts[wide].tolist(), ends[wide].tolist()):
        while (a := a + 1 + _joining(ys[a + 1 : b], near[a], float(ys[a]), 1)[0]) < b:
            more.append(a)
    return np.sort(np.concatenate([firsts, more])).astype(np.int64)


def _lines(texts: pa.Array, xs: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The lines of rows of words that begin at starts, each row's words from left to right."""
    order = np.lexsort((xs, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(xs))))))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(xs)), pa.int32()), texts.take(pa.array(order))), " ").cast(pa.string())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by document and height -> doc_id, line_no, line and what else is told of a document, in order."""
    names, open_ = ["doc_id", "line_no", "line"], None  # the open row: document and what is told of it, number, first height, sum, words, all near the first; texts, xs

    def closed() -> pa.RecordBatch:
        line = _lines(pa.concat_arrays(open_[6]), np.concatenate(open_[7]), np.zeros(1, np.int64))
        return pa.RecordBatch.from_arrays([open_[0][0], pa.array([open_[1]], pa.int32()), line, *open_[0][1:]], names)

    for batch in batches:
        if not (n := batch.num_rows):
            continue
        docs, texts, others = batch.column(0), batch.column(2), batch.columns[6:]
        names[3:] = batch.schema.names[6:]
        xs, ys, near = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5))
        ends = pc.run_end_encode(docs).run_ends.to_numpy()
        other = np.zeros(n, bool)
        other[ends[:-1]] = True
        other[0] = open_ is None or open_[0][0][0].as_py() != docs[0].as_py()
        at, number = 0, 0
        if open_ is not None:
            if not other[0]:
                own = ys[: ends[0]]
                if open_[5]:
                    reached = own - open_[2] <= near[0]
                    at = len(own) if reached.all() else int(reached.argmin())
                    open_[3], open_[4] = open_[3] + float(own[:at].sum(dtype="float64")), open_[4] + at
                if at < len(own):
                    more, open_[3], open_[4] = _joining(own[at:], near[0], open_[3], open_[4])
                    at, open_[5] = at + more, open_[5] and not more
                number = open_[1] + 1
                open_[6].append(texts.slice(0, at))
                open_[7].append(xs[:at])
            if at == n:
                continue
            yield closed()
        cut = other[at:].copy()
        cut[0] = True
        cut[1:] |= ~(np.diff(ys[at:]) <= near[at + 1 :])
        starts = _starts(ys[at:], near[at:], cut) + at
        # rows are numbered from 0 in each document; the first ones may go on with the last batch's
        nth, begins = np.arange(len(starts)), other[starts]
        numbers = nth - np.maximum.accumulate(np.where(begins, nth, 0)) + np.where(np.cumsum(begins) == 0, number, 0)
        last = int(starts[-1])
        if last > at:
            firsts = starts[:-1]
            lines = _lines(texts.slice(at, last - at), xs[at:last], firsts - at)
            doc, *of = (c.take(pa.array(firsts)) for c in (docs, *others))
            yield pa.RecordBatch.from_arrays([doc, pa.array(numbers[:-1], pa.int32()), lines, *of], names)
        own = ys[last:]
        open_ = [[c.slice(last, 1) for c in (docs, *others)], int(numbers[-1]), own[0], float(own.sum(dtype="float64")), n - last, bool(own[-1] - own[0] <= near[last]), [texts.slice(last)], [xs[last:]]]
    if open_ is not None:
        yield closed()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by document and height -> doc_id, rows and what else is told of it: a document's lines, all of them."""
    doc, lines = None, []
    for batch in _cut(batches):
        told = pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:]], ["doc_id", *batch.schema.names[3:]])
        firsts = np.flatnonzero(batch.column(1).to_numpy() == 0)
        to = int(firsts[0]) if len(firsts) else batch.num_rows
        lines.append(batch.column(2).slice(0, to))
        if not len(firsts):
            continue
        ends = np.append(firsts[1:], batch.num_rows)
        if doc is not None:
            yield _listed(doc, [0], pa.concat_arrays(lines))
        if len(firsts) > 1:
            yield _listed(told.take(pa.array(firsts[:-1])), firsts[:-1] - to, batch.column(2).slice(to, int(firsts[-1]) - to))
        doc, lines = told.slice(int(firsts[-1]), 1), [batch.column(2).slice(int(firsts[-1]))]
    if doc is not None:
        yield _listed(doc, [0], pa.concat_arrays(lines))


def _listed(docs: pa.RecordBatch, firsts: list[int] | np.ndarray, lines: pa.Array) -> pa.RecordBatch:
    rows = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(lines)), pa.int32()), lines)
    return pa.RecordBatch.from_arrays([docs.column(0), rows, *docs.columns[1:]], ["doc_id", "rows", *docs.schema.names[1:]])


def _schema(words: DataFrame, made: str, turned: DataFrame) -> str:
    return ", ".join([f"doc_id {words.schema['doc_id'].dataType.simpleString()}", made, *[f"`{f.name}` {f.dataType.simpleString()}" for f in turned.schema.fields[6:]]])


def row_lines(words: DataFrame, told_of: DataFrame | None = None) -> DataFrame:
    """words(doc_id, seq, text, left, top, right, bottom, angle) -> doc_id, line_no, line: the rows of each document, top to bottom.
    told_of: one row a doc_id, whose other columns come with the lines."""
    turned, _ = turned_words(words, told_of=told_of)
    return turned.sortWithinPartitions("doc_id", "y", "seq").mapInArrow(_cut, _schema(words, "line_no int, line string", turned))


def row_arrays(words: DataFrame, blanks: str = BLANKS, told_of: DataFrame | None = None) -> DataFrame:
    """words(doc_id, seq, text, left, top, right, bottom, angle) -> doc_id, rows: each document's rows as one array, top to bottom; an
    empty one where no word counts. told_of: one row a doc_id, whose other columns come with the rows."""
    turned, docs = turned_words(words, blanks, told_of)
    found = turned.sortWithinPartitions("doc_id", "y", "seq").mapInArrow(_whole, _schema(words, "rows array<string>", turned))
    return found.unionByName(docs.where("usual is null").withColumn("rows", F.array().cast("array<string>")).drop("usual"))
