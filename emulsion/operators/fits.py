"""Least-squares fits: sums of products come from one grouped aggregate, only a 4 x 4 system is solved on the driver.

Outliers are dropped by an exact quantile of the error between rounds; each round is one pass over the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import luma709, rgb, unit
from .scratch import dropped, settled
from .stats import norm, quantile


def moments(df: DataFrame, x: list[Column], y: list[Column], times: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of x x' and x y', and the number of rows; a row counts ``times``."""
    total = lambda c: F.sum(c if times is None else c * times)
    cells = [total(a * b) for i, a in enumerate(x) for b in x[i:]] + [total(a * b) for a in x for b in y]
    row = df.agg(F.count(F.lit(1)) if times is None else F.sum(times), *cells).first()
    n, v = row[0] or 0, [float(z or 0.0) for z in row[1:]]
    k = len(x)
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = v[: k * (k + 1) // 2]
    xx = xx + np.triu(xx, 1).T
    return xx, np.array(v[k * (k + 1) // 2 :]).reshape(k, len(y)), n


def _all(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _applied(x: list[Column], m: np.ndarray) -> list[Column]:
    return [sum((x[i] * float(m[i, j]) for i in range(1, len(x))), x[0] * float(m[0, j])) for j in range(m.shape[1])]


def colour_matrix(df: DataFrame, source: list[str], target: list[str], rounds: int = 4) -> np.ndarray:
    """(4, 3): three rows of the matrix and the offset, fitted ``rounds`` times without the worst 12 percent of the round before.

    Equal rows become one with their number, in the only pass over ``df``; the rounds read those. Pixels have few levels, so they
    are far fewer, and never more.
    """
    tests = [F.col(c) > 0.002 for c in source + target] + [F.col(c) < 0.985 for c in target]
    every = settled(df.groupBy(*source, *target).agg(F.count(F.lit(1)).alias("_n")))
    valid = every.filter(_all(*tests))
    if (valid.agg(F.sum("_n")).first()[0] or 0) < 32:
        valid = every
    x = [F.col(c) for c in source] + [F.lit(1.0)]
    y = [F.col(c) for c in target]
    kept = valid
    m = np.zeros((4, 3))
    for _ in range(rounds):
        xx, xy, n = moments(kept, x, y, F.col("_n"))
        if n < 32:
            break
        m = np.linalg.lstsq(xx, xy, rcond=None)[0]
        error = norm(*(unit(p) - t for p, t in zip(_applied(x, m), y, strict=True)))
        limit = valid.agg(F.percentile(error, F.lit(0.88), F.col("_n"))).first()[0]
        kept = valid.filter(error <= limit)
    dropped(every)
    return m


def camera_matrix(df: DataFrame, source: list[str], target: list[str]) -> np.ndarray:
    """(3, 3) without an offset, on pixels that neither side clips; identity where it can't be told."""
    valid = df.filter(_all(*(F.col(c) > 0.005 for c in source + target), *(F.col(c) < 0.98 for c in source + target)))
    xx, xy, n = moments(valid, [F.col(c) for c in source], [F.col(c) for c in target])
    if n < 32 or np.linalg.matrix_rank(xx) < 3:
        return np.eye(3)
    return np.linalg.solve(xx, xy)


def density_matrix(df: DataFrame, source: list[str], target: list[str], prior: np.ndarray | None = None, ridge: float = 2500.0, rounds: int = 5) -> np.ndarray:
    """(3, 3) with rows of sum one, drawn to ``prior``; stops when the same rows are kept as in the round before."""
    prior = np.eye(3) if prior is None else prior
    x = [F.col(c) for c in source]
    kept, m, last = df, prior.copy(), None
    luma = lambda p: luma709(rgb()) if p is None else p[0] * 0.2126 + p[1] * 0.7152 + p[2] * 0.0722
    for _ in range(rounds):
        xx, xy, n = moments(kept, x, [F.col(c) for c in target])
        if n < 128:
            break
        left = np.block([[xx + np.eye(3) * ridge, np.ones((3, 1))], [np.ones((1, 3)), np.zeros((1, 1))]])
        for row in range(3):
            m[row] = np.linalg.solve(left, np.append(xy[:, row] + prior[row] * ridge, 1.0))[:3]
        p = [F.greatest(v, F.lit(0.0)) for v in _applied(x, m.T)]
        t = [F.col(c) for c in target]
        error = norm(*((a - luma(p)) - (b - luma(t)) for a, b in zip(p, t, strict=True)))
        limit = df.agg(quantile(error, 0.88)).first()[0]
        kept = df.filter(error <= limit)
        now = tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*source, *target).cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    total = m.sum(axis=1, keepdims=True)
    return m / np.where(np.abs(total) < 1e-6, 1.0, total)


def gains_through_origin(df: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """gain: the slope through the origin over unclipped rows; over all but dark rows if those are fewer than 32; else 1."""
    s, d = F.col(source), F.col(target)
    clear, bright = (s > 0.015) & (s < 0.985) & (d > 0) & (d < 1), s > 0.015
    slope = lambda w: F.sum(F.when(w, s * d)) / F.nullif(F.sum(F.when(w, s * s)), F.lit(0.0))
    return df.groupBy(*keys).agg(F.coalesce(F.when(F.count_if(clear) >= 32, slope(clear)).when(F.count_if(bright) >= 32, slope(bright)), F.lit(1.0)).alias("gain"))
