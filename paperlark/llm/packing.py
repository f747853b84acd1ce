"""Concatenate and cut: all documents' tokens end to end, cut into sequences of one fixed length.

Pass one tokenizes each partition and writes, in the shared folder, one record for each document with its ids, its
partition and its offset there; the partitions' totals, one number each, are then summed up to global offsets. Pass two
adds the offsets and cuts each document at the multiples of the sequence length. A document that crosses one leaves
a record on either side. No rows are shuffled, and a document's ids are read back, never tokenized twice.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.llm.bpe import END, WordBPE
from paperlark.llm.common import bounded, shared_dir, slices, whole

#: Chunks, and words of letters, whose ids a worker keeps: some 200 bytes each.
LIBRARY_CACHED = 150_000
#: Fixed value: signs that are neither letters, digits, spaces nor the beginning of a contraction.
MARKS = ".,;:!?#$%&*|()[]\""
#: Partitions whose bases, some 16 bytes each, are broadcast; beyond it they are joined.
BROADCAST_PARTS = 1_000_000


class LibraryWords(WordBPE):
    """The ids that the tokenizers library gives, asked for once a chunk between white spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(path)
        self.cached = LIBRARY_CACHED
        self.library = Tokenizer.from_file(path)
        self.last = np.zeros(max(self.strings) + 1, bool)
        self.last[[i for s, i in self.ids.items() if s.endswith(END)]] = True
        self.library.no_truncation(), self.library.no_padding()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the library is asked once for all chunks that are new. Nothing is forgotten before the last text is done."""
        known = self.chunks
        if len(known) > self.cached:
            known.clear()
        cut = [None if "<" in t and self.split.search(t) else self.chunks_of(t) for t in texts]
        self.learn({c for chunks in cut if chunks for c in chunks if c not in known})
        return [self.encode_known(t) if chunks is None else np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4") for t, chunks in zip(texts, cut)]

    def learn(self, new: set[str]) -> None:
        """Ask the library for new chunks. A word of letters and the marks after it are apart in any text, so both are asked
        for on their own: the words many at once, as each one's last id, and no other, ends a word."""
        known, pieces = self.chunks, self.pieces
        if len(pieces) > self.cached:
            pieces.clear()
        ends = {c: len(c.rstrip(MARKS)) for c in new}
        ends = {c: n for c, n in ends.items() if c[:n].isalpha()}
        words = [*{c[:n] for c, n in ends.items() if c[:n] not in pieces}]
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            if len(at) != len(group) + 1:
                raise ValueError("the vocabulary does not mark the ends of words")
            pieces.update(zip(group, [data[x:y] for x, y in zip(at, at[1:])]))
        rest = [*{c[n:] for c, n in ends.items() if c[n:] not in known and n < len(c)} | {c for c in new if c not in ends}]
        for c, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            known[c] = np.array(e.ids, "<u4").tobytes()
        for c, n in ends.items():
            known[c] = pieces[c[:n]] if n == len(c) else pieces[c[:n]] + known[c[n:]]

    def chunk(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def load(path: str) -> LibraryWords:
    return LibraryWords(path)


def _tokenize(path: str, end_id: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, at = load(path), TaskContext.get().partitionId(), 0
        words.cached = cached
        kind = np.dtype("<u2") if len(words.ids) + len(words.special) <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
        for some in slices(batches, rows=512, size=2 << 20):  # memory holds few documents' ids at a time
            ids = [np.append(x, np.uint32(end_id)).astype(kind) for x in words.encode_all(some.column(1).to_pylist())]
            sizes = np.array([len(x) for x in ids], "int64")
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(np.full(len(ids), part, "int32")), pa.array(starts), pa.array(sizes), pa.array(np.full(len(ids), kind.itemsize, "int32")), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["id", "part", "start", "doc_tokens", "width", "ids"],
            )

    return run


def _cut(length: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            col = dict(zip(batch.schema.names, batch.columns))
            starts, sizes = col["start"].to_numpy(), col["doc_tokens"].to_numpy()
            first, last = starts // length, (starts + sizes - 1) // length
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            low, high = np.maximum(seq * length, starts[row]), np.minimum((seq + 1) * length, (starts + sizes)[row])
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(col["ids"].to_pylist(), col["width"].to_pylist())]
            crc = [zlib.crc32(ids[r][a:b].tobytes()) for r, a, b in zip(row.tolist(), (low - starts[row]).tolist(), (high - starts[row]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [col["id"].take(pa.array(row)), *map(pa.array, (low - starts[row], high - low, np.array(crc, "int64"), sizes[row], seq, low - seq * length))],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str, *, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cached: int = LIBRARY_CACHED) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's ids are those of the tokenizers library with the file at path, then end_id; null and empty texts have
    that one id. start counts the document's ids before the piece, offset the sequence's. Only the last sequence of all
    may be shorter than length. Repeated rows are packed each; an empty table gives no rows. Other columns of docs are
    ignored. cached bounds the chunks and words whose ids a worker keeps. What pass one writes goes to the shared folder of ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    slim = bounded(docs).select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    written = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    slim.mapInArrow(_tokenize(path, end_id, cached), f"id {kind}, part int, start long, doc_tokens long, width int, ids binary").write.option("compression", "zstd").parquet(written)
    tokens = spark.read.schema(f"id {kind}, part int, start long, doc_tokens long, width int, ids binary").parquet(written)
    bases, at = [], 0
    for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect():
        bases.append((r.part, at))
        at += r.n
    base = spark.createDataFrame(bases, "part int, base long")
    placed = tokens.join(F.broadcast(base) if len(bases) <= BROADCAST_PARTS else base, "part")
    return placed.select("id", (F.col("start") + F.col("base")).alias("start"), "doc_tokens", "width", "ids").mapInArrow(
        _cut(length), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ).withColumnRenamed("id", id_col)
