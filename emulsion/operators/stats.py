"""Robust statistics of groups of pixels, exact and in one shuffle.

Each takes a relation with columns r, g, b and the names of its keys (frame, tile, band). A step whose limit depends on a
statistic of the step before is a window over the keys, so a chain of such steps deals the pixels out once; a group is a frame
or less, of bounded size. Casts and neutral gains, whose chains have a dozen of such steps, take a group at a time in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import RGB, clip, finite, luma601, luma709, rgb, unit


#: A value at a quantile of its own group counts as within it, however the last bit was rounded.
SLACK = 1e-12


def on(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``stats`` put beside each row of its group; keys may be null."""
    renamed = stats.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(renamed, match, "left").drop(*(f"_{k}" for k in keys))


def beside(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of each row's group put beside it."""
    w = Window.partitionBy(*keys)
    return df.withColumns({n: a.over(w) for n, a in aggregates.items()})


def quantile(c: Column, q: float) -> Column:
    """Exact, linear between neighbours."""
    return F.percentile(c, F.lit(q))


def fused(df: DataFrame, **asked: tuple[Column, Column, Column]) -> DataFrame:
    """``df`` plus a * b + c of each three columns, rounded once: the product's and the sum's own errors are added last."""
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    df = df.withColumns({f"_{p}_{n}": x for n, t in asked.items() for p, x in zip("abc", t, strict=True)})
    col = lambda p, n: F.col(f"_{p}_{n}")
    df = df.withColumns({f"_p_{n}": col("a", n) * col("b", n) for n in asked} | {f"_x_{n}": split(col("a", n)) for n in asked} | {f"_y_{n}": split(col("b", n)) for n in asked})
    df = df.withColumns({f"_s_{n}": col("p", n) + col("c", n) for n in asked} | {
        f"_e_{n}": ((col("x", n) * col("y", n) - col("p", n)) + col("x", n) * (col("b", n) - col("y", n)) + (col("a", n) - col("x", n)) * col("y", n)) + (col("a", n) - col("x", n)) * (col("b", n) - col("y", n)) for n in asked
    })
    df = df.withColumns({f"_z_{n}": col("s", n) - col("p", n) for n in asked})
    out = {n: col("s", n) + (((col("p", n) - (col("s", n) - col("z", n))) + (col("c", n) - col("z", n))) + col("e", n)) for n in asked}
    return df.withColumns(out).drop(*(f"_{p}_{n}" for p in "abcpxysez" for n in asked))


def with_quantiles(df: DataFrame, keys: list[str], **asked: tuple[Column, float]) -> DataFrame:
    """``df`` with quantiles of each row's group put beside it, for limits that rows of the group are held against.

    Between neighbours in order a quantile is low * (1 - d) + high * d. Spark rounds both products, and takes the value itself
    where the neighbours are equal; the SQL engine rounds one product and the sum (a fused multiply-add). The results may differ in the
    last bit, and where many rows have the limit's value, they fall on its other side. So the neighbours are looked up (they are
    Spark's quantile itself, if its place in order says so, or the values next to it) and weighed as SQL does.
    """
    df = beside(df, keys, **{n: quantile(c, q) for n, (c, q) in asked.items()}, **{f"_n_{n}": F.count(c) for n, (c, _) in asked.items()})
    sides = {}
    for n, (c, _) in asked.items():
        less, more = c < F.col(n), c > F.col(n)
        sides |= {f"_u_{n}": F.count_if(less), f"_o_{n}": F.count_if(more), f"_l_{n}": F.max(F.when(less, c)), f"_h_{n}": F.min(F.when(more, c))}
    df = beside(df, keys, **sides)
    df = df.withColumns({f"_at_{n}": (F.col(f"_n_{n}") - 1) * F.lit(float(q)) for n, (_, q) in asked.items()})
    terms = {}
    for n in asked:
        v, under, upto, at = F.col(n), F.col(f"_u_{n}"), F.col(f"_n_{n}") - F.col(f"_o_{n}"), F.col(f"_at_{n}")
        k = F.floor(at)
        low = F.when((under <= k) & (k < upto), v).otherwise(F.col(f"_l_{n}"))
        high = F.when((under <= k + 1) & (k + 1 < upto), v).otherwise(F.coalesce(f"_h_{n}", v))
        terms[n] = (low, 1.0 - (at - k), high * (at - k))
    return fused(df, **terms).drop(*(f"_{p}_{n}" for p in ("n", "u", "o", "l", "h", "at") for n in asked))


def norm(*c: Column) -> Column:
    return F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))


def exposure_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """p05 to p95 of the luma and the clipped fractions; rows whose luma isn't finite are left out, an empty group has zeros."""
    luma = luma601(rgb())
    good = ~F.isnan(luma) & (F.abs(luma) != float("inf"))
    v = F.when(good, luma)
    out = df.groupBy(*keys).agg(
        F.percentile(v, F.array(*(F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q"),
        F.avg((v <= 0.01).cast("double")).alias("shadow_clip"),
        F.avg((v >= 0.99).cast("double")).alias("highlight_clip"),
    )
    zero = F.lit(0.0)
    named = {n: F.coalesce(F.get("q", i), zero) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))}
    return out.select(*keys, *(c.alias(n) for n, c in named.items()), F.coalesce("shadow_clip", zero).alias("shadow_clip"), F.coalesce("highlight_clip", zero).alias("highlight_clip"))


def exposure_class() -> Column:
    """Of exposure_metrics' columns."""
    span = F.col("p75") - F.col("p25")
    extreme = (F.col("shadow_clip") >= 0.12) | (F.col("highlight_clip") >= 0.07) | (F.col("p50") <= 0.10) | (F.col("p95") <= 0.35) | (F.col("p50") >= 0.90) | (F.col("p95") >= 0.992) | (span <= 0.045)
    low = (F.col("p50") <= 0.18) | ((F.col("p50") <= 0.22) & (F.col("p95") <= 0.68))
    return F.when(extreme, "extreme protected").when(low, "low-light salvageable").otherwise("normal")


def exposure_usable() -> Column:
    """Fit to set a roll's baseline."""
    span = F.col("p75") - F.col("p25")
    return ~((F.col("shadow_clip") >= 0.10) | (F.col("highlight_clip") >= 0.06) | (F.col("p50") <= 0.10) | (F.col("p50") >= 0.88) | (F.col("p95") <= 0.35) | (F.col("p95") >= 0.992) | (span <= 0.045))


def with_tone(df: DataFrame) -> DataFrame:
    """luma, hi, lo, sat and spread (the farthest channel from the luma) beside r, g, b."""
    p = rgb()
    luma, hi, lo = luma601(p), F.greatest(*p), F.least(*p)
    return df.withColumns({
        "luma": luma, "hi": hi, "lo": lo, "sat": (hi - lo) / F.greatest(hi, F.lit(1e-6)),
        "spread": F.greatest(*(F.abs(c - luma) for c in p)),
    })


def clean_pixels(luma: tuple[float, float], lo: float, hi: float) -> Column:
    return (F.col("luma") >= luma[0]) & (F.col("luma") <= luma[1]) & (F.col("lo") >= lo) & (F.col("hi") <= hi)


def neutral(df: DataFrame, keys: list[str], clean: Column) -> DataFrame:
    """``df`` (with_tone) plus clean and neutral: the clean pixels of little colour, by the first of three limits that 64 keep.

    Fewer than 16 clean pixels give none. The third limit, on the spread, holds whatever it keeps.
    """
    df = df.withColumn("clean", clean)
    own = F.when(F.col("clean"), F.col("sat"))
    df = with_quantiles(df, keys, sat_a=(own, 0.35), sat_b=(own, 0.55), spread_q=(F.when(F.col("clean"), F.col("spread")), 0.30))
    df = beside(df, keys, n_clean=F.count_if("clean"))
    df = df.withColumn("limit_1", F.least(F.lit(0.30), F.greatest(F.lit(0.055), F.col("sat_a"))))
    df = df.withColumn("limit_2", F.least(F.lit(0.42), F.greatest("limit_1", "sat_b"))).withColumn("limit_3", F.least(F.lit(0.14), F.greatest(F.lit(0.045), F.col("spread_q"))))
    df = beside(df, keys, n_1=F.count_if(F.col("clean") & (F.col("sat") <= F.col("limit_1"))), n_2=F.count_if(F.col("clean") & (F.col("sat") <= F.col("limit_2"))))
    chosen = F.when(F.col("n_1") >= 64, F.col("sat") <= F.col("limit_1")).when(F.col("n_2") >= 64, F.col("sat") <= F.col("limit_2")).otherwise(F.col("spread") <= F.col("limit_3"))
    return df.withColumn("neutral", F.col("clean") & (F.col("n_clean") >= 16) & F.coalesce(chosen, F.lit(False))).drop("limit_1", "limit_2", "limit_3", "n_1", "n_2", "sat_a", "sat_b", "spread_q")


def medians(df: DataFrame, keys: list[str], where: Column, **columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.median(F.when(where, c)).alias(n) for n, c in columns.items()))


def trimmed(df: DataFrame, keys: list[str], chosen: str, q: float, least_before: int, least_after: int, columns: dict[str, Column]) -> DataFrame:
    """``chosen`` without the rows farthest from the median of ``columns``, where enough rows are chosen and left."""
    df = beside(df, keys, **{f"_m_{n}": F.median(F.when(F.col(chosen), c)) for n, c in columns.items()})
    df = df.withColumn("_away", norm(*(c - F.col(f"_m_{n}") for n, c in columns.items())))
    df = with_quantiles(df, keys, _limit=(F.when(F.col(chosen), F.col("_away")), q))
    df = beside(df, keys, _n=F.count_if(chosen), _kept=F.count_if(F.col(chosen) & (F.col("_away") <= F.col("_limit"))))
    trims = (F.col("_n") >= least_before) & (F.col("_kept") >= least_after)
    out = df.withColumn(chosen, F.col(chosen) & (~trims | (F.col("_away") <= F.col("_limit"))))
    return out.drop("_away", "_n", "_limit", "_kept", *(f"_m_{n}" for n in columns))


def by_group(df: DataFrame, keys: list[str], out: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, float | None]]) -> DataFrame:
    """A row a group: keys and ``out`` (a schema), what ``work`` tells of the group's r, g, b; nulls reach it as NaN."""
    chosen = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in "rgb"))
    kinds = ", ".join(f"`{n}` {kind}" for n, kind in chosen.dtypes if n in keys)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        told = work(*(table[c].to_numpy() for c in "rgb"))
        return pa.table({n: pa.array([k.as_py()], k.type) for n, k in zip(keys, key, strict=True)} | typed(told))

    return chosen.groupBy(*keys).applyInArrow(run, f"{kinds}, {out}")


def typed(told: dict[str, float | None]) -> dict[str, pa.Array]:
    """A row of longs and doubles for Arrow."""
    return {n: pa.array([v], pa.int64() if isinstance(v, int) else pa.float64()) for n, v in told.items()}


def quantile_of(v: np.ndarray, q: float) -> float:
    """One of ``with_quantiles``, in numpy: low * (1 - d) + high * d with the last product and the sum rounded once."""
    s, at = np.sort(v), (len(v) - 1) * q
    k = int(at)
    a, b = float(s[k]), 1.0 - (at - k)
    c = float(s[min(k + 1, len(s) - 1)]) * (at - k)
    x, y = a * 134217729.0 - (a * 134217729.0 - a), b * 134217729.0 - (b * 134217729.0 - b)
    p = a * b
    total = p + c
    error = ((x * y - p) + x * (b - y) + (a - x) * y) + (a - x) * (b - y)
    z = total - p
    return total + (((p - (total - z)) + (c - z)) + error)


def median_of(v: np.ndarray) -> float | None:
    """Spark's median, the halves of the two in the middle; null without values."""
    if not len(v):
        return None
    s = np.sort(v)
    return float(s[(len(s) - 1) // 2]) * 0.5 + float(s[len(s) // 2]) * 0.5


def clean_tones(r: np.ndarray, g: np.ndarray, b: np.ndarray, luma: tuple[float, float], least: float, most: float) -> dict[str, np.ndarray]:
    """``with_tone`` and ``clean_pixels`` in numpy: r, g, b, luma, sat and spread of the clean pixels."""
    y, hi, lo = r * 0.299 + g * 0.587 + b * 0.114, np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    clean = (y >= luma[0]) & (y <= luma[1]) & (lo >= least) & (hi <= most)
    r, g, b, y, hi, lo = (x[clean] for x in (r, g, b, y, hi, lo))
    spread = np.maximum(np.maximum(np.abs(r - y), np.abs(g - y)), np.abs(b - y))
    return {"r": r, "g": g, "b": b, "luma": y, "sat": (hi - lo) / np.maximum(hi, 1e-6), "spread": spread}


def neutral_of(sat: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """``neutral`` in numpy, of the clean pixels alone."""
    if len(sat) < 16:
        return np.zeros(len(sat), bool)
    limit = min(0.30, max(0.055, quantile_of(sat, 0.35)))
    first = sat <= limit
    if first.sum() >= 64:
        return first
    second = sat <= min(0.42, max(limit, quantile_of(sat, 0.55)))
    if second.sum() >= 64:
        return second
    return spread <= min(0.14, max(0.045, quantile_of(spread, 0.30)))


def trimmed_of(values: list[np.ndarray], q: float, least_before: int, least_after: int) -> np.ndarray:
    """``trimmed`` in numpy: which of the chosen rows stay."""
    if len(values[0]) < least_before:
        return np.ones(len(values[0]), bool)
    off = [v - median_of(v) for v in values]
    away = np.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    kept = away <= quantile_of(away, q)
    return kept if kept.sum() >= least_after else np.ones(len(away), bool)


EXPOSURE = "p05 double, p25 double, p50 double, p75 double, p95 double, shadow_clip double, highlight_clip double"


def exposure_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """EXPOSURE: ``exposure_metrics`` in numpy, weighed between neighbours as Spark's percentile does."""
    y = r * 0.299 + g * 0.587 + b * 0.114
    y = np.sort(y[np.isfinite(y)])
    names = [part.split()[0] for part in EXPOSURE.split(", ")]
    if not len(y):
        return dict.fromkeys(names, 0.0)
    out = []
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        at = (len(y) - 1) * q
        low, high = math.floor(at), math.ceil(at)
        x, z = float(y[low]), float(y[high])
        out.append(x if x == z else (high - at) * x + (at - low) * z)
    return dict(zip(names, [*out, int((y <= 0.01).sum()) / len(y), int((y >= 0.99).sum()) / len(y)], strict=True))


CAST = "sampled long, n_used long, sat_median double, r double, g double, b double"


def cast_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, float | None]:
    """CAST: the pixels, the neutral ones (or else the clean ones), and medians of their saturation and of what parts them from their luma."""
    p = clean_tones(r, g, b, (0.08, 0.94), 0.01, 0.985)
    used = neutral_of(p["sat"], p["spread"])
    if used.sum() < 16:
        used = np.full(len(used), len(used) >= 16)
    res = [p[c][used] - p["luma"][used] for c in "rgb"]
    kept = trimmed_of(res, 0.85, 32, 16)
    return {"sampled": len(r), "n_used": int(used.sum()), "sat_median": median_of(p["sat"][used]), **{n: median_of(v[kept]) for n, v in zip("rgb", res, strict=True)}}


def magnitude_told(m: dict[str, float | None]) -> float:
    """cast_metrics' magnitude of what ``cast_of`` tells."""
    if m["r"] is None:
        return 0.0
    luma = m["r"] * 0.299 + m["g"] * 0.587 + m["b"] * 0.114
    x, y, z = (m[c] - luma for c in "rgb")
    return math.sqrt(x * x + y * y + z * z)


def magnitude_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> float:
    """cast_metrics' magnitude alone."""
    return magnitude_told(cast_of(r, g, b))


def cast_columns() -> dict[str, Column]:
    """cast_metrics' columns of those of CAST."""
    luma = luma601(rgb())
    c = [F.coalesce(F.col(x) - luma, F.lit(0.0)) for x in "rgb"]
    return {
        "magnitude": norm(*c), **{f"cast_{n}": x for n, x in zip("rgb", c, strict=True)}, "neutral_fraction": F.col("n_used") / F.greatest(F.col("sampled"), F.lit(1)),
        "neutral_pixels": F.col("n_used"), "sampled": F.col("sampled"), "sat_median": F.coalesce("sat_median", F.lit(0.0)),
    }


GAINS = "n long, pixels long, r double, g double, b double, target double"


def gains_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, float | None]:
    """GAINS: the neutral pixels, all pixels, and medians of the neutral ones that lie together."""
    p = clean_tones(r, g, b, (0.06, 0.96), 0.006, 0.992)
    used = neutral_of(p["sat"], p["spread"])
    chosen = [p[c][used] for c in ("r", "g", "b", "luma")]
    kept = trimmed_of(chosen[:3], 0.80, 128, 96)
    return {"n": int(used.sum()), "pixels": len(r), **{n: median_of(v[kept]) for n, v in zip(("r", "g", "b", "target"), chosen, strict=True)}}


def gains_told(m: dict[str, float | None]) -> list[float] | None:
    """neutral_gains' gains of what ``gains_of`` tells, or none."""
    if m["n"] < 96 or m["pixels"] < 64 or m["target"] <= 1e-6 or min(m["r"], m["g"], m["b"]) <= 1e-6:
        return None
    return [m["target"] / m[c] for c in "rgb"]


def gain_columns() -> dict[str, Column]:
    """neutral_gains' columns of those of GAINS."""
    good = (F.col("n") >= 96) & (F.col("pixels") >= 64) & (F.col("target") > 1e-6) & (F.least("r", "g", "b") > 1e-6)
    return {"n": F.col("n"), **{f"gain_{c}": F.when(good, F.col("target") / F.when(F.col(c) > 1e-6, F.col(c))) for c in "rgb"}}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def cast_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """How far the neutral pixels are from grey: magnitude, cast_r, cast_g, cast_b, neutral_fraction, neutral_pixels, sampled, sat_median."""
    return by_group(df, keys, CAST, cast_of).select(*keys, *_named(cast_columns()))


def neutral_gains(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gains that make the neutral pixels grey: gain_r, gain_g, gain_b before normalising, and n; null where there are too few."""
    return by_group(df, keys, GAINS, gains_of).select(*keys, *_named(gain_columns()))


def luma_histogram(df: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """keys, bin, n for every bin of [0, 1], empty ones too; the last bin is closed."""
    luma = luma709(rgb().map(unit))
    counts = df.groupBy(*keys, F.least(F.floor(luma * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def bounded_log(c: Column) -> Column:
    return F.log10(clip(finite(c, 1e-6, 1.0, 1e-6), 1e-6, 1.0))


def bounds(log: Column, percent: float = 0.02) -> Column:
    """An aggregate: the lower and the upper bound of a logarithm; ``percent`` is in percent, 0.02 being 2 in 10,000."""
    q = min(max(percent, 0.00001), 1.0) / 100.0
    return F.percentile(log, F.array(F.lit(q), F.lit(1.0 - q)))


def between_bounds(log: Column, low: Column, high: Column) -> Column:
    span = high - low
    return unit((log - low) / F.when(F.abs(span) < 1e-6, 1e-6).otherwise(span))


def log_bounds(df: DataFrame, keys: list[str], percent: float = 0.02) -> DataFrame:
    """floor_ and ceil_ of each channel's logarithm."""
    both = df.groupBy(*keys).agg(*(bounds(bounded_log(F.col(c)), percent).alias(c) for c in "rgb"))
    return both.select(*keys, *(F.get(c, 0).alias(f"floor_{c}") for c in "rgb"), *(F.get(c, 1).alias(f"ceil_{c}") for c in "rgb"))


def normalised_log(df: DataFrame, keys: list[str], bounds_: DataFrame) -> DataFrame:
    """r, g, b as logarithms between the bounds, clipped to [0, 1]; a span of nothing counts as 1e-6."""
    j = on(df, bounds_, keys)
    return j.withColumns({c: between_bounds(bounded_log(F.col(c)), F.col(f"floor_{c}"), F.col(f"ceil_{c}")) for c in "rgb"}).drop(*(f"{x}_{c}" for x in ("floor", "ceil") for c in "rgb"))


def white_balance_sample(df: DataFrame, keys: list[str], luma: Column, band: tuple[float, float], inside: tuple[float, float], chroma_q: float | None) -> DataFrame:
    """``df`` plus sampled: rows of middle luma, then unclipped ones, then those of little colour; each step if 128 rows stay."""
    df = df.withColumn("_luma", luma)
    df = beside(df, keys, _qa=quantile(F.col("_luma"), band[0]), _qb=quantile(F.col("_luma"), band[1]))
    df = df.withColumn("sampled", (F.col("_luma") >= F.col("_qa") - SLACK) & (F.col("_luma") <= F.col("_qb") + SLACK))
    p = rgb()
    within = (F.least(*p) > inside[0]) & (F.greatest(*p) < inside[1])

    def step(df: DataFrame, keep: Column, fallback: Column) -> DataFrame:
        return beside(df, keys, _keep=F.count_if(keep)).withColumn("sampled", F.when(F.col("_keep") >= 128, keep).otherwise(fallback)).drop("_keep")

    df = step(df, F.col("sampled"), F.lit(True))
    df = step(df, F.col("sampled") & within, F.col("sampled"))
    if chroma_q is not None:
        df = df.withColumn("_chroma", F.greatest(*p) - F.least(*p))
        df = beside(df, keys, _lim=quantile(F.when(F.col("sampled"), F.col("_chroma")), chroma_q))
        df = step(df, F.col("sampled") & (F.col("_chroma") <= F.col("_lim") + SLACK), F.col("sampled")).drop("_chroma", "_lim")
    return df.drop("_luma", "_qa", "_qb")


def log_sample(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` of normalised logarithms plus sampled: what tells their balance."""
    q = rgb().map(lambda c: 1.0 - unit(c))
    return white_balance_sample(df, keys, luma709(q), (0.22, 0.78), (0.04, 0.96), 0.45)


def offsets_of(m: RGB, strength: float) -> dict[str, Column]:
    """offset_r, offset_g and offset_b of mean zero that bring medians together."""
    mean = (m.r + m.g + m.b) / 3.0
    return {f"offset_{n}": clip((mean - x) * min(max(strength, 0.0), 1.0), -0.04, 0.04) for n, x in zip("rgb", m, strict=True)}


def auto_offsets(df: DataFrame, keys: list[str], strength: float = 0.65) -> DataFrame:
    """Offsets of mean zero that bring the medians of a log sample together: offset_r, offset_g, offset_b."""
    s = log_sample(df, keys)
    m = medians(s, keys, F.col("sampled"), r=unit(F.col("r")), g=unit(F.col("g")), b=unit(F.col("b")))
    return m.select(*keys, *(c.alias(n) for n, c in offsets_of(rgb(), strength).items()))


def grey_gains(df: DataFrame, keys: list[str], strength: float = 0.65) -> DataFrame:
    """Gains towards the grey of the sample's medians, each in [0.5, 2] and mixed with 1 by ``strength``."""
    s = white_balance_sample(df, keys, luma709(rgb()), (0.12, 0.88), (0.02, 0.98), 0.55)
    m = medians(s, keys, F.col("sampled"), r=F.col("r"), g=F.col("g"), b=F.col("b"))
    m = m.select(*keys, *(F.greatest(F.col(c), F.lit(1e-5)).alias(c) for c in "rgb"))
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    return m.select(*keys, *((1.0 + (clip(grey / F.col(c), 0.5, 2.0) - 1.0) * strength).alias(f"gain_{c}") for c in "rgb"))


def finite_quantile(c: Column, q: float) -> Column:
    return quantile(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c), q)


def anchor_of(middle: Column) -> Column:
    """The tone anchor from the 55th percentile of the luma: in [0.32, 0.62]; 0.46 without finite luma."""
    return F.coalesce(clip(middle, 0.32, 0.62), F.lit(0.46))


def tone_anchor(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(anchor_of(finite_quantile(luma709(rgb()), 0.55)).alias("anchor"))


def display_stretch(df: DataFrame, keys: list[str]) -> DataFrame:
    """r, g, b as 8-bit values, stretched between the 0.5th and 99.5th percentile of all channels together."""
    pooled = df.select(*keys, F.explode(F.array("r", "g", "b")).alias("v")).groupBy(*keys).agg(F.percentile("v", F.array(F.lit(0.005), F.lit(0.995))).alias("_q"))
    j = on(df, pooled, keys)
    low, high = F.get("_q", 0), F.get("_q", 1)
    scaled = lambda c: unit((F.col(c) - low) / F.greatest(high - low, F.lit(1e-6)))
    return j.withColumns({c: F.floor(F.pow(scaled(c), F.lit(1 / 2.2)) * 255 + 0.5).cast("int") for c in "rgb"}).drop("_q")


def channel_stretch(df: DataFrame, keys: list[str], low: float = 0.001, high: float = 0.998) -> DataFrame:
    """Each channel between two of its own percentiles as 0 to 1; a flat one is only clipped."""
    df = beside(df, keys, **{f"_q{n}": F.percentile(n, F.array(F.lit(low), F.lit(high))) for n in "rgb"})
    lo, hi = (lambda n: F.get(f"_q{n}", 0)), (lambda n: F.get(f"_q{n}", 1))
    out = {n: unit(F.when(hi(n) <= lo(n) + 1e-6, F.col(n)).otherwise((F.col(n) - lo(n)) / (hi(n) - lo(n)))) for n in "rgb"}
    return df.withColumns(out).drop(*(f"_q{n}" for n in "rgb"))


# Bands of luma from narrow to all, the least number of pixels in one; limits of saturation and the least it keeps.
REFERENCE_BANDS, REFERENCE_BAND_LEAST = ((0.08, 0.88), (0.04, 0.94)), 64
REFERENCE_QUANTILES, REFERENCE_FLOOR, REFERENCE_LEAST = (0.28, 0.45), 0.08, 32


def reference_neutrals(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` plus neutral: pixels of middle luma and little saturation, by the first band and limit that leave enough."""
    luma = luma709(rgb())
    df = df.withColumns({"_l": luma, "_s": (F.greatest(*rgb()) - F.least(*rgb())) / F.greatest(luma, F.lit(1e-4))})
    bands = [(F.col("_l") > a) & (F.col("_l") < b) for a, b in REFERENCE_BANDS]
    df = beside(df, keys, **{f"_n{i}": F.count_if(b) for i, b in enumerate(bands)})
    mid = F.when(F.col("_n0") >= REFERENCE_BAND_LEAST, bands[0]).when(F.col("_n1") >= REFERENCE_BAND_LEAST, bands[1]).otherwise(F.lit(True))
    df = df.withColumn("_mid", mid)
    own = F.when(F.col("_mid"), F.col("_s"))
    df = beside(df, keys, _c0=quantile(own, REFERENCE_QUANTILES[0]), _c1=quantile(own, REFERENCE_QUANTILES[1]))
    first = F.col("_mid") & (F.col("_s") <= F.greatest("_c0", F.lit(REFERENCE_FLOOR)) + SLACK)
    df = beside(df.withColumn("_first", first), keys, _kept=F.count_if("_first"))
    out = F.when(F.col("_kept") >= REFERENCE_LEAST, F.col("_first")).otherwise(F.col("_mid") & (F.col("_s") <= F.col("_c1") + SLACK))
    return df.withColumn("neutral", out).drop("_l", "_s", "_n0", "_n1", "_mid", "_c0", "_c1", "_first", "_kept")


def error_stats(df: DataFrame, keys: list[str], predicted: list[str], reference: list[str]) -> DataFrame:
    """rmse, mae and p95 of the clipped prediction's error over all channels."""
    delta = F.explode(F.array(*(unit(F.col(a)) - F.col(b) for a, b in zip(predicted, reference, strict=True)))).alias("d")
    each = df.select(*keys, delta)
    return each.groupBy(*keys).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg(F.abs("d")).alias("mae"), quantile(F.abs(F.col("d")), 0.95).alias("p95_abs"))
