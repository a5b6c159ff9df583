"""Quality classifier: naive Bayes support vectors.

Indicators of byte trigrams are scaled by the classes' log-count ratio; a linear hinge-loss model is fitted to them by dual
coordinate descent and drawn towards its mean weight; a logistic curve on its margins gives the score.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` in expectation, by a hash of the id). Every document is
scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .grams import SIZE, trigram_codes

SAMPLE = 6000
EPOCHS, C, BETA, ALPHA = 8, 1.0, 0.5, 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def nbsvm(rows: list[np.ndarray], y: np.ndarray, seed: int = 8) -> tuple[np.ndarray, float, float]:
    """Weights of the indicators, and slope and offset of the logistic curve. y is 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        p = (float(y.sum()) + 1) / (len(y) + 2)
        return np.zeros(SIZE), 1.0, float(np.log(p / (1 - p)))
    count = np.full((2, SIZE), ALPHA)
    for idx, label in zip(rows, y, strict=True):
        count[label, idx] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    scaled = [ratio[idx] / np.sqrt(max(1, len(idx))) for idx in rows]
    square = [float(x @ x) + 1 for x in scaled]
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    upper = C / (2 * share[y])  # both classes weigh alike
    alpha, w, bias, rng = np.zeros(len(y)), np.zeros(SIZE), 0.0, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            x, idx = scaled[i], rows[i]
            grad = sign[i] * (float(w[idx] @ x) + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[idx] += step * x
                bias += step
                alpha[i] = new
    mean = np.abs(w).sum() / SIZE
    weights = ((1 - BETA) * mean * np.sign(w) + BETA * w) * ratio
    margin = np.array([weights[idx].sum() / np.sqrt(max(1, len(idx))) for idx in rows])
    slope, offset = logistic_fit(margin, y)
    return weights, slope, offset


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for the slope and offset, with targets kept off 0 and 1 and a little damping."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin / max(float(np.abs(margin).max()), 1e-12), np.ones(len(y))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (goal - p) - 1e-3 * beta)
        beta += step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / max(float(np.abs(margin).max()), 1e-12)), float(beta[1])


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idx = pa.array((np.unique(trigram_codes(t.as_py())) for t in batch.column(1)), pa.list_(pa.int32()))
        yield pa.record_batch([batch.column(0), idx], names=["y", "idx"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """Fitted on labelled rows that aren't held out; rows with null ids or labels are left out, and of several labels of a
    document the mean decides (half: 1)."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    n = max(1, known.count())
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample)
    drawn = drawn.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    got = docs.select("doc_id", "text").join(drawn, "doc_id").select("y", "text").mapInArrow(_indicators, "y int, idx array<int>").toArrow()
    rows, y = got.column("idx").to_pylist(), np.array(got.column("y").to_pylist(), dtype=np.int64)
    order = sorted(range(len(y)), key=lambda i: (rows[i], y[i]))  # however the rows came
    return nbsvm([np.array(rows[i], dtype=np.int32) for i in order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    A null or empty text has the score of a text without known trigrams. Null ids aren't held out. Repeated rows stay. With no
    labels the score is 0.5, with one class only that class's smoothed share. Other columns of ``docs`` are left out.
    """
    weights, slope, offset = fit(bounded_batches(docs), labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            idx = np.unique(trigram_codes(t))
            out[i] = w[idx].sum(dtype=np.float64) / np.sqrt(max(1, len(idx)))
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * out + offset, -35, 35))))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
