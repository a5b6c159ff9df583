"""What a correction does to a picture's regions: drift of their chroma, noise of the shadows, and how far to hold it back.

A raster has frame_id, y, x, r, g, b and the corrected ar, ag, ab, all 0 to 1. A frame's regions are one explode and one
aggregate by frame and region; nothing is gathered per frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import RGB, clip, luma601, rgb
from . import stats

# Regions in their order, with the limits of drift and chroma, least pixels and least share; their warnings.
REGIONS = (
    ("sky", "highlight sky tint drift", 0.028, 0.010, 96, 0.06),
    ("foliage", "foliage hue drift", 0.040, 0.015, 128, 0.0),
    ("red", "skin/red object hue drift", 0.040, 0.015, 128, 0.0),
    ("shadow", "shadow color noise", 0.0, 0.0, 128, 0.0),
)
NOISE_SLACK, NOISE_SCALE = 0.018, 0.06
LEAST_RISK, LEAST_PIXELS = 0.30, 128
#: Actions that leave the picture as it is.
UNTOUCHED = ("none", "protected", "review", "skip-extreme")


# What tells the regions apart: luma, place, a channel over another, saturation.
SKY = {"luma": (0.62, 0.97), "down": 0.72, "over red": 1.01, "over green": 0.97, "sat": (0.035, 0.32)}
FOLIAGE = {"over red": 1.04, "over blue": 1.08, "luma": 0.12, "sat": 0.18}
RED = {"over green": 1.08, "over blue": 1.15, "luma": 0.16, "sat": 0.28}
SHADOW = (0.025, 0.22)


def region_tests(down: Column) -> dict[str, Column]:
    """Of stats.with_tone's columns; ``down`` is how far down the frame a pixel is, 0 to 1."""
    r, g, b, luma, sat = (F.col(n) for n in ("r", "g", "b", "luma", "sat"))
    return {
        "sky": luma.between(*SKY["luma"]) & (down <= SKY["down"]) & (b >= r * SKY["over red"]) & (b >= g * SKY["over green"]) & sat.between(*SKY["sat"]),
        "foliage": (g > r * FOLIAGE["over red"]) & (g > b * FOLIAGE["over blue"]) & (luma >= FOLIAGE["luma"]) & (sat >= FOLIAGE["sat"]),
        "red": (r > g * RED["over green"]) & (r > b * RED["over blue"]) & (luma >= RED["luma"]) & (sat >= RED["sat"]),
        "shadow": luma.between(*SHADOW),
    }


def _flat(p: RGB) -> RGB:
    luma = luma601(p)
    return p.map(lambda c: c - luma)


def side_effects(raster: DataFrame) -> DataFrame:
    """frame_id, risk, warning: the region that the correction harms most, the first on ties; 0 and empty where none is harmed.

    Frames of under 128 pixels, regions of too few pixels and risks under 0.30 count as unharmed.
    """
    key = ["frame_id", "region"]
    p = stats.beside(stats.with_tone(raster), ["frame_id"], _h=F.max("y"), _all=F.count(F.lit(1)))
    p = p.withColumn("after_luma", luma601(rgb("ar", "ag", "ab")))
    tests = region_tests(F.col("y") / F.greatest(F.col("_h"), F.lit(1)))
    regions = F.array_compact(F.array(*(F.when(t, F.lit(i)) for i, t in enumerate(tests.values()))))
    residual = {f"b_{n}": F.col(n) - F.col("luma") for n in "rgb"} | {f"a_{n}": F.col(f"a{n}") - F.col("after_luma") for n in "rgb"}
    m = p.filter(F.col("_all") >= LEAST_PIXELS).select("frame_id", "_all", F.explode(regions).alias("region"), *(c.alias(n) for n, c in residual.items()))
    m = stats.beside(m, key, **{f"m{n}": F.median(n) for n in residual})
    away = {s: stats.norm(*(F.col(f"{s}_{n}") - F.col(f"m{s}_{n}") for n in "rgb")) for s in "ba"}
    g = m.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("_all").alias("all"), *(F.first(f"m{n}").alias(n) for n in residual), *(F.median(c).alias(f"noise_{s}") for s, c in away.items()))
    limits = F.get(F.array(*(F.struct(F.lit(w).alias("warning"), F.lit(d).alias("drift"), F.lit(c).alias("chroma"), F.lit(n).alias("n"), F.lit(s).alias("share")) for _, w, d, c, n, s in REGIONS)), F.col("region"))
    g = g.withColumn("lim", limits).filter((F.col("n") >= F.col("lim.n")) & (F.col("n") / F.col("all") >= F.col("lim.share")))
    before, after = _flat(rgb("b_r", "b_g", "b_b")), _flat(rgb("a_r", "a_g", "a_b"))
    g = g.withColumns({"size_b": stats.norm(*before), "size_a": stats.norm(*after), "drift": stats.norm(*(x - y for x, y in zip(after, before, strict=True)))})
    grown = F.greatest(F.lit(0.0), (F.col("size_a") - F.col("size_b")) / F.greatest(F.col("lim.chroma") * 2.5, F.lit(1e-6)))
    drifted = clip(0.55 * grown + 0.45 * F.col("drift") / F.greatest(F.col("lim.drift") * 2.0, F.lit(1e-6)), 0.0, 1.0)
    harmed = (F.col("size_a") > F.col("size_b") + F.col("lim.chroma")) | (F.col("drift") > F.col("lim.drift"))
    louder = F.col("noise_a") - F.col("noise_b")
    noisy = F.when(louder > NOISE_SLACK, F.least(F.lit(1.0), louder / NOISE_SCALE)).otherwise(0.0)
    risk = F.when(F.col("region") == len(REGIONS) - 1, noisy).otherwise(F.when(harmed, drifted).otherwise(0.0))
    g = g.withColumn("risk", risk).filter(F.col("risk") >= LEAST_RISK)
    worst = g.groupBy("frame_id").agg(F.max(F.struct(F.round("risk", 9).alias("k"), (-F.col("region")).alias("o"), "risk", F.col("lim.warning").alias("warning"))).alias("w"))
    every = raster.select("frame_id").distinct()
    out = stats.on(every, worst, ["frame_id"])
    return out.select("frame_id", F.coalesce("w.risk", F.lit(0.0)).alias("risk"), F.coalesce("w.warning", F.lit("")).alias("warning"))


def chosen_strength(tried: DataFrame) -> DataFrame:
    """Of a frame's tried strengths of highlight protection (frame_id, pos, strength, before, after, warning), the one to take.

    The first in order that leaves no warning and hardly more cast than before; if none does, what a walk through them keeps: the
    first, until one is without a warning where the kept one has one, or has less cast under the same warning.
    """
    fine = (F.col("warning") == "") & (F.col("after") <= F.col("before") + F.greatest(F.lit(0.003), F.col("before") * 0.08))
    rows = F.array_sort(F.collect_list(F.struct("pos", "strength", "after", "warning", fine.alias("fine"))))
    better = lambda kept, x: ((x["warning"] == "") & (kept["warning"] != "")) | ((x["warning"] == kept["warning"]) & (x["after"] < kept["after"]))
    walk = lambda kept, x: F.when(kept["fine"], kept).when(x["fine"] | better(kept, x), x).otherwise(kept)
    d = tried.groupBy("frame_id").agg(rows.alias("_rows"))
    kept = F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))), F.get("_rows", 0), walk)
    return d.withColumn("_kept", kept).select("frame_id", "_kept.strength", "_kept.after", "_kept.warning")
