"""Toxicity from character n-grams: a linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are its distinct lower-cased character n-grams of the given orders, hashed to ``2 ** bits`` numbers.
Each has the log ratio of its smoothed share among toxic and among other training texts; the classifier is a logistic
regression on the present features times that ratio, with an L2 penalty. Both are learned on at most ``sample``
labelled rows, picked by a hash of their id. Features whose ratio is under ``least_ratio`` weigh nothing.

The weights, one number a feature, are sent to the workers, which score whole texts independently: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import bounded, fresh, whole

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Grams:
    orders: tuple[int, ...] = (4, 6)
    bits: int = 20

    def of(self, text: str, seen: np.ndarray) -> np.ndarray:
        """The numbers of the distinct n-grams of a text. seen: scratch of 2 ** bits int32, of any content."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype("uint64") + np.uint64(1)
        out, rolled = [], points * _STEP
        shift = np.uint64(64 - self.bits)
        for n in range(2, max(self.orders) + 1):
            if len(points) < n:
                break
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * _MIX + points[n - 1 :] * _STEP
            if n in self.orders:
                out.append(((rolled ^ (rolled >> np.uint64(32))) * _STEP >> shift).astype("int32"))
        if not out:
            return np.empty(0, "int32")
        found = np.concatenate(out)
        place = np.arange(len(found), dtype="int32")
        seen[found] = place
        return found[seen[found] == place]


@dataclass
class ToxicityModel:
    grams: Grams
    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        seen = np.zeros(len(self.weights), "int32")
        return _sigmoid(np.array([float(self.weights[self.grams.of(t, seen)].sum(dtype="float64")) for t in texts], "float64") + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_logistic(rows: np.ndarray, features: np.ndarray, values: np.ndarray, y: np.ndarray, penalty: float, steps: int = 100, memory: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias of least penalised log loss on a bounded sparse sample, by limited-memory BFGS.

    rows, features: of each nonzero; values: of each feature number, the value where it is present."""
    n, d = len(y), len(values)
    x = values[features]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, x * w[features], n) + w[d]
        gap = (_sigmoid(z) - y) / n
        slope = np.append(np.bincount(features, x * gap[rows], d) + penalty * w[:d], gap.sum())
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean() + penalty / 2 * (w[:d] @ w[:d])), slope

    w, pairs = np.zeros(d + 1), []
    f, g = loss(w)
    for _ in range(steps):
        way, dots = -g, []
        for s, v, r in reversed(pairs):
            dots.append(r * (s @ way))
            way = way - dots[-1] * v
        if pairs:
            s, v, _ = pairs[-1]
            way = way * ((s @ v) / (v @ v))
        for (s, v, r), a in zip(pairs, reversed(dots)):
            way = way + s * (a - r * (v @ way))
        step = 1.0 if pairs else 1.0 / max(1.0, float(np.linalg.norm(g)))
        while step > 1e-10:
            new = w + step * way
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * step * (g @ way):
                break
            step /= 2
        else:
            break
        s, v = new - w, g_new - g
        done = f - f_new <= 1e-7 * max(f, 1e-12)
        w, f, g = new, f_new, g_new
        if s @ v > 1e-12:
            pairs = [*pairs, (s, v, 1 / (s @ v))][-memory:]
        if done:
            break
    return w[:d], float(w[d])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample: int = 12_000, grams: Grams = Grams(), least_ratio: float = 1.0, smooth: float = 1.0, penalty: float = 1e-5, steps: int = 100) -> ToxicityModel:
    """Learn from the texts of docs that labels (id_col, label_col) marks 0 or 1; other labels are left out, a null text counts as empty.

    At most ``sample`` labels are used: those with the smallest hash of their id. So what the driver fits on is bounded.
    Without texts of both labels every text gets the share of label 1 (0.5 without any).
    """
    spark = docs.sparkSession
    ids = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id", "y").limit(sample)  # so few rows may be broadcast
    rows = bounded(docs).select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(ids), "id").select("text", "y")
    rows = rows.repartition(max(2, min(64, sample // 500))).persist()
    size = 1 << grams.bits
    try:
        seen_by = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n0, n1 = seen_by.get(0, 0), seen_by.get(1, 0)
        if not n0 or not n1:
            share = (n1 + 0.5) / (n0 + n1 + 1)
            return ToxicityModel(grams, np.zeros(size, "float32"), float(np.log(share / (1 - share))))

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, found = np.zeros(size, "int32"), np.zeros((2, size), "int32")
            for frame in frames:
                for text, y in zip(frame.text, frame.y):
                    found[y][grams.of(text, seen)] += 1
            some = np.flatnonzero(found.any(axis=0))
            yield pd.DataFrame({"g": some, "n0": found[0][some], "n1": found[1][some]})

        # one row for each feature, 2 ** bits at most
        counts = rows.mapInPandas(count, "g int, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 > 1").toArrow()
        p, q = counts["n1"].to_numpy() + smooth, counts["n0"].to_numpy() + smooth
        ratio = np.zeros(size, "float32")
        ratio[counts["g"].to_numpy()] = np.log(p / (n1 + 2 * smooth)) - np.log(q / (n0 + 2 * smooth))
        ratio[np.abs(ratio) < least_ratio] = 0
        told = spark.sparkContext.broadcast(ratio)

        def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = np.zeros(size, "int32")
            for frame in frames:
                for text, y in zip(frame.text, frame.y):
                    some = grams.of(text, seen)
                    some = some[told.value[some] != 0]
                    yield pd.DataFrame({"y": [y], "g": [some.astype("<i4").tobytes()]})

        sparse = rows.mapInPandas(pick, "y int, g binary").toArrow()
    finally:
        rows.unpersist()
    ids = [np.frombuffer(g, "<i4") for g in sparse["g"].to_pylist()]
    nonzero = np.concatenate([*ids, np.empty(0, "int32")])
    used, dense = np.unique(nonzero, return_inverse=True)
    at = np.repeat(np.arange(len(ids)), [len(g) for g in ids])
    w, bias = fit_logistic(at, dense, ratio[used].astype("float64"), sparse["y"].to_numpy().astype("float64"), penalty, steps)
    weights = np.zeros(size, "float32")
    weights[used] = w * ratio[used]
    return ToxicityModel(grams, weights, float(bias))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, score_col (renamed with underscores where docs has one): 0 to 1, higher is likelier toxic.

    Null texts score as empty ones. Repeated rows stay; an empty table stays empty.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(told.value.scores(text))

    return bounded(docs).withColumn(fresh(docs, score_col), score(whole(text_col)))
