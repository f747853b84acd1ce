"""Text quality by regularised quadratic discriminant analysis over transformed document statistics.

Statistics of the whole text (lengths, shares of kinds of signs, repetition) are brought nearer to normal ones by
logarithms and logits. Spark sums, for each class, the count, the statistics and their products over the labelled training
rows, ``sample`` of them at most, picked by a hash of their id; from these few numbers the driver makes each class's mean
and covariance, shrunk to the pooled covariance and then to its diagonal, and their Cholesky factors. A score is the logistic
of the difference of the two log densities (Mahalanobis distances by the cached factors, forward substitution for all rows of
a batch at once; log determinants; class shares), tempered.

Scoring is independent by row and fitting sends the sampled ids to the documents: there is no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlark.llm.common import bounded, fresh, whole

#: Names of the statistics, in the order of the vector.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "spaces", "marks", "symbols", "beyond_ascii",
    "distinct_words", "repeated_neighbours", "top_word", "log_lines", "line_bytes", "distinct_lines", "sentence_ends", "word_spread", "line_marks", "byte_entropy",
)
_UPPER, _DIGIT, _SPACE, _MARK = (np.isin(np.arange(256), np.frombuffer(s, "uint8")) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-"))
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", "uint8")) | _UPPER
_BEYOND = np.arange(256) >= 128
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _MARK | _BEYOND)


def _logit(hits: float, of: float) -> float:
    """Log odds of a share, held off from 0 and 1 alike for short and long texts."""
    share = (hits + 0.02 * 50) / (of + 50) if of else 0.02
    return float(np.log(share / (1 - min(share, 0.999))))


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, "uint8"), minlength=256)
    n = len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    k, m = len(words), len(lines)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), "int32", k) if k else np.zeros(1, "int32")
    neighbours = sum(map(str.__eq__, words, words[1:]))
    share = counts[counts > 0] / max(n, 1)
    total = lambda kind: int(counts[kind].sum())
    return [
        np.log1p(n), np.log1p(k), float(np.log1p(sizes.mean())), float(np.log1p(sizes.max())),
        _logit(total(_UPPER), n), _logit(total(_DIGIT), n), _logit(total(_SPACE), n), _logit(total(_MARK), n), _logit(total(_SYMBOL), n), _logit(total(_BEYOND), n),
        float(np.log((len(tally) + 1) / (k + 1))), _logit(neighbours, k), _logit(max(tally.values(), default=0), k),
        np.log1p(m), float(np.log1p(n / max(m, 1))), float(np.log((len({*lines}) + 1) / (m + 1))),
        _logit(int(counts[46] + counts[33] + counts[63]), k), float(np.log1p(sizes.std())), _logit(int(counts[124] + counts[60] + counts[62] + counts[123] + counts[125]), n),
        float(-(share * np.log(share)).sum()),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(text: pd.Series) -> pd.Series:
    """Column of texts -> column of vectors of STATISTICS."""
    return pd.Series([statistics(t) for t in text], dtype=object)


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """z with factor @ z = right, factor being lower triangular."""
    z = np.empty_like(right)
    for i in range(len(factor)):
        z[i] = (right[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class QDA:
    """Class means, lower Cholesky factors of the class covariances, their log determinants and the class shares."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_shares: np.ndarray
    tempered: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of each row of statistics, the probability of class 1."""
        if not len(x):
            return np.zeros(0)
        log_density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = forward(factor, (x - mean).T)
            log_density.append(-0.5 * ((z * z).sum(axis=0) + log_det))
        gap = self.tempered * (log_density[1] - log_density[0]) + self.log_shares[1] - self.log_shares[0]
        return 0.5 * (1 + np.tanh(gap / 2))


def make_qda(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float, to_diagonal: float, tempered: float) -> QDA:
    """From each class's count, sum and sum of products."""
    d = sums.shape[1]
    means = sums / np.maximum(counts, 1)[:, None]
    spread = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = spread.sum(axis=0) / max(counts.sum() - 2, 1)
    floor = np.eye(d) * max(1e-6, 1e-3 * float(np.trace(pooled)) / d)
    factors, log_dets = [], []
    for k in range(2):
        own = (1 - to_pooled) * spread[k] / max(counts[k] - 1, 1) + to_pooled * pooled
        own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(own)) + floor
        factors.append(np.linalg.cholesky(own))
        log_dets.append(2 * float(np.log(np.diag(factors[-1])).sum()))
    shares = (counts + 0.5) / (counts.sum() + 1)
    return QDA(means, np.array(factors), np.array(log_dets), np.log(shares), tempered)


def stacked(vectors: pd.Series) -> np.ndarray:
    """A batch's vectors as rows of a matrix."""
    return np.array(vectors.tolist(), "float64").reshape(-1, len(STATISTICS))


def of_texts(texts: pd.Series) -> np.ndarray:
    """The vectors of STATISTICS of a batch's texts as rows of a matrix."""
    return np.array([statistics(t) for t in texts], "float64").reshape(-1, len(STATISTICS))


def fit_qda(labelled: DataFrame, *, vector_col: str = "statistics", label_col: str = "quality", vectors: Callable[[pd.Series], np.ndarray] = stacked, to_pooled: float = 0.1, to_diagonal: float = 0.05, tempered: float = 0.5) -> QDA | None:
    """Learn from rows with a vector and a label 0 or 1, all of them; other labels and null ones are left out.

    vectors makes the matrix of a batch of vector_col, which may hold texts (of_texts). None where a class has no rows: then
    there is nothing to tell apart.
    """
    d = len(STATISTICS)

    def gather(frames):
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for frame in frames:
            x, y = vectors(frame.x), frame.y.to_numpy()
            for k in range(2):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                p[k] += own.T @ own
        if n.sum():
            yield pd.DataFrame({"k": np.arange(2 * (1 + d + d * d)), "v": np.concatenate([n, s.ravel(), p.ravel()])})

    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(vector_col).alias("x"), F.col(label_col).cast("int").alias("y"))
    found = rows.mapInPandas(gather, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 * (1 + d + d * d))
    flat[found.k.to_numpy()] = found.v.to_numpy()
    n = flat[:2]
    if not n.all():
        return None
    return make_qda(n, flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), to_pooled, to_diagonal, tempered)


def quality_score(vector: Column, model: QDA | None, spark) -> Column:
    """Score of a column of statistics; 0.5 everywhere without a model."""
    if model is None:
        return F.lit(0.5)
    told = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(told.value.scores(stacked(x)))

    return score(vector)


def with_statistics(docs: DataFrame, *, text_col: str = "text", vector_col: str = "statistics") -> DataFrame:
    """docs with one more column, vector_col (renamed with underscores where docs has one). A null text counts as empty."""
    return bounded(docs).withColumn(fresh(docs, vector_col), statistics_udf(whole(text_col)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, **shrinkage: float) -> QDA | None:
    """Learn from the texts of docs that labels (id_col, label_col) marks 0 or 1; other labels are left out, a null text counts as empty.

    At most ``sample`` labels are used: those with the smallest hash of their id. None where a class has no rows.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("id"), "id", "label").limit(sample)  # so few rows may be broadcast
    rows = bounded(docs).select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(marks), "id")
    # statistics and sums in one pass: of two, each task would take two workers, and an executor keeps its workers to the end
    return fit_qda(rows, vector_col="text", label_col="label", vectors=of_texts, **shrinkage)


def score_quality(docs: DataFrame, model: QDA | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, score_col (renamed with underscores where docs has one): 0 to 1, higher is likelier label 1.

    Null texts score as empty ones, every text 0.5 without a model. Repeated rows stay; an empty table stays empty.
    """
    return bounded(docs).withColumn(fresh(docs, score_col), quality_score(statistics_udf(whole(text_col)), model, docs.sparkSession))
