"""Exact top-k inner products by a Voronoi kNN join.

A bounded number of vectors serve as pivots; every vector, query or not, belongs to the cell of its nearest pivot. What
is gathered of the cells is small: of queries their number and their largest distance u to the pivot p, of data the k + 1
vectors nearest to the pivot. A query q of a cell and a vector s differ from p by no more than u|s| in their product:

    <p, s> - u|s|  <=  <q, s>  <=  <p, s> + u|s|.

So the (k + 1)-th largest lower bound among the gathered vectors is a threshold that the k best of every query of the cell
reach, its own row left out, and only vectors whose upper bound reaches it are needed there. Neighbouring cells with few
queries make a group, and a vector that several of its cells need is sent to it once. Groups are solved
locally, in blocks of bounded size: a group's queries and the vectors sent to it are dealt to as many blocks as their
numbers need, so that one cell with a third of all rows, or one vector repeated in a third of them, is no large task.
Products are whole numbers, so ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlark.llm.common import cut


@dataclass(frozen=True)
class Params:
    pivots: int = 64
    query_block: int = 1024
    data_block: int = 40_000


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    cells = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(cells), "<i8").reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of rows, exact: by doubles where these hold every partial sum, else by 64-bit whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), "int64")
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return (a.astype("float64") @ b.astype("float64").T).astype("int64")
    return a @ b.T


def _cells(pivots: np.ndarray):
    dim, p = pivots.shape[1], pivots.astype("float64")
    own = (p * p).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype("float64")
            nearest = (own - 2 * x @ p.T).argmin(axis=1)
            away = np.sqrt(((x - p[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype("int32")), pa.array(away)], names=["id", "v", "query", "cell", "away"])

    return run


def _groups(pivots: np.ndarray, counts: list[int], most: int) -> np.ndarray:
    """The group of each cell: from one pivot to the nearest left, cells join until a group holds ``most`` queries."""
    p, way = pivots.astype("float64"), [0]
    while len(way) < len(counts):
        rest = [i for i in range(len(counts)) if i not in way]
        way.append(min(rest, key=lambda i: float(((p[i] - p[way[-1]]) ** 2).sum())))
    out, now, held = np.zeros(len(counts), "int64"), -1, most
    for i in way:
        if held + counts[i] > most:
            now, held = now + 1, 0
        out[i], held = now, held + counts[i]
    return out


def _sent(pivots: np.ndarray, cells: list[int], groups: np.ndarray, reach: np.ndarray, least: np.ndarray):
    """Rows (cell, id, v), cell being a group's number, for each group with a cell that the vector may be a result in."""
    dim, p = pivots.shape[1], pivots[cells]
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.diff(groups[order], prepend=-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                some = batch.slice(first, 2000)
                x = _matrix(some.column(1), dim)
                size = np.sqrt((x.astype("float64") ** 2).sum(axis=1))
                most = _products(x, p) + size[:, None] * reach[None, :]
                needed = most * (1 + 1e-12) + 1e-6 + np.abs(most) * 1e-9 >= least[None, :]
                row, k = np.nonzero(np.logical_or.reduceat(needed[:, order], starts, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(k.astype("int32")), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], names=["cell", "id", "v"])

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, params: Params = Params()) -> DataFrame:
    """query_id, rank (from 1), id_col and score of each query's k largest products with other rows, ties to smaller ids.

    Components x become floor(scale * x). Vectors that are null or hold null or infinite components or NaN, and rows without
    an id, take no part; shorter and empty ones count as ended by zeros. Rows of one id and equal vectors count once; of one id
    and different vectors each is a candidate of the other ids' queries, and as queries they are ranked together under their
    id. Fewer than k other rows give fewer results; an empty table none. Products must fit in 64 bits.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("w"), is_query.alias("query"))
        .groupBy("id", "w").agg(F.max("query").alias("query"))
    )
    rows = cut(rows)
    dim, n = rows.agg(F.max(F.size("w")), F.count("*")).first()
    dim = max(1, dim or 0)
    out = f"query_id long, rank int, {id_col} long, score long"
    if not n:
        return spark.createDataFrame([], out)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.pad(np.array(x, "<i8"), (0, dim - len(x))).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["id", "v", "query"])

    rows = rows.mapInArrow(packed, "id long, v binary, query boolean")
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(params.pivots).select("v").collect()
    pivots = np.unique(_matrix([bytes(r.v) for r in picked], dim), axis=0)
    dealt = cut(rows.mapInArrow(_cells(pivots), "id long, v binary, query boolean, cell int, away double"))
    asked = dealt.where("query").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("u")).orderBy("cell").collect()
    if not asked:
        return spark.createDataFrame([], out)
    near = Window.partitionBy("cell").orderBy("away", "id")
    one = dealt.groupBy("cell", "id").agg(F.min(F.struct("away", "v")).alias("m")).select("cell", "id", "m.away", "m.v")
    known = one.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1).select("id", "v").collect()
    known = {r.id: bytes(r.v) for r in known}  # one of each id: of k + 1 ids k are not the query's own
    known = _matrix([*known.values()], dim)
    cells, reach = [r.cell for r in asked], np.array([r.u for r in asked]) * (1 + 1e-9)
    low = _products(pivots[cells], known) - reach[:, None] * np.sqrt((known.astype("float64") ** 2).sum(axis=1))[None, :] * (1 + 1e-9)
    least = np.sort(low, axis=1)[:, -(k + 1)] if len(known) > k else np.full(len(cells), -np.inf)

    groups = _groups(pivots[cells], [r.n for r in asked], params.query_block)
    sent = dealt.select("id", "v").mapInArrow(_sent(pivots, cells, groups, reach, least), "cell int, id long, v binary")
    blocks = max(1, -(-n // params.data_block))
    held = np.bincount(groups, [r.n for r in asked]).astype("int64")
    lookup = lambda kv: F.create_map(*[F.lit(int(x)) for pair in kv for x in pair])[F.col("cell")]
    group, count = lookup(zip(cells, groups)), lookup(enumerate(-(-held // params.query_block)))
    # queries go to every block of data of their group, data to every block of queries: both numbers are few
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    queries = dealt.where("query").withColumn("cell", group).select("cell", F.col("id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("id"), count).cast("int").alias("qb")).withColumn("db", each(F.lit(blocks)))
    data = sent.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qb", each(count))

    def solve(ask: pa.Table, told: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not ask.num_rows or not told.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        q, x = _matrix(ask["q"].combine_chunks(), dim), _matrix(told["v"].combine_chunks(), dim)
        qid, xid = ask["query_id"].to_numpy(), told["id"].to_numpy()
        order = np.argsort(xid, kind="stable")
        xid, x, found = xid[order], x[order], []
        for first in range(0, len(q), 64):
            scores = _products(q[first : first + 64], x)
            for i, s in zip(qid[first : first + 64], scores):
                other = xid != i
                s, ids = s[other], xid[other]
                if len(s) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    some = np.flatnonzero(s >= edge)
                    s, ids = s[some], ids[some]
                best = np.argsort(-s, kind="stable")[:k]
                found.append((np.full(len(best), i), ids[best], s[best]))
        return pa.table([np.concatenate([f[c] for f in found]) for c in range(3)], names=names)

    solved = queries.groupBy("cell", "qb", "db").cogroup(data.groupBy("cell", "qb", "db")).applyInArrow(solve, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
