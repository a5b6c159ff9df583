"""Roll analysis as one plan over pixels, frames and rolls.

``pixels`` (frame_id, r, g, b) give a row a frame; frames (frame_id, roll_id) give a row a roll; and frames joined with their
roll give a plan a frame. What a frame would look like under other gains is measured for all alternatives at once, in the group of
its pixels, and under its own neutral gains where these are found: pixels are shuffled once for all that needs no roll. Only the
frame and roll tables, rows of some numbers, are kept between the steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import RGB, clip, log_gain, num, rgb, unit_luma_gains
from ..operators import ordered, relate, stats
from ..operators.scratch import settled
from ..operators.stats import norm, on

FULL = 65535.0
IDENTITY = ("none", "protected", "review", "skip-extreme")


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    return df.select(*(F.round(n, places).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes))


def binary_round(c: Column, places: int) -> Column:
    """Half to even by the number itself, not by its shortest decimal text: 0.5055 is below the middle and gives 0.505, as in SQL."""
    return F.rint(c * float(10**places)) / float(10**places)


def gains_of(prefix: str) -> RGB:
    return rgb(f"{prefix}_r", f"{prefix}_g", f"{prefix}_b")


def logs(p: RGB) -> RGB:
    return unit_luma_gains(p).map(log_gain)


def from_logs(p: RGB) -> RGB:
    return unit_luma_gains(p.map(F.exp))


def times(p: RGB, k: Column | float) -> RGB:
    return p.map(lambda c: c * num(k))


def named(p: RGB, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{n}": c for n, c in zip("rgb", p, strict=True)}


def dealt(pixels: DataFrame) -> DataFrame:
    """Pixels by frame."""
    return pixels.select("frame_id", "r", "g", "b").repartition("frame_id")


def unit_luma(gains: list[float]) -> list[float]:
    """``unit_luma_gains`` of three numbers."""
    r, g, b = (min(max(k, 0.05), 20.0) for k in gains)
    luma = max(r * 0.299 + g * 0.587 + b * 0.114, 1e-6)
    return [r / luma, g / luma, b / luma]


def drawn_in(gains: list[float], most: float) -> list[float]:
    """Gains of unit luma, their logarithms no longer than ``most``."""
    x, y, z = (math.log(min(max(k, 0.05), 20.0)) for k in unit_luma(gains))
    size = math.sqrt(x * x + y * y + z * z)
    k = most / max(size, 1e-6) if size > most else 1.0
    return unit_luma([math.exp(v * k) for v in (x, y, z)])


def applied(full: np.ndarray, gain: np.ndarray | float) -> np.ndarray:
    """A channel, in steps of FULL, under a gain (or each of several): in whole steps again, from 0 to 1."""
    return np.rint(np.clip(np.multiply.outer(full, gain).ravel(), 0.0, FULL)) / FULL


MEASURED = f"{stats.EXPOSURE}, {stats.CAST}, cand_r double, cand_g double, cand_b double, after_cand double"


def measured(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, float | None]:
    """MEASURED: a frame's exposure and cast, its neutral candidate's gains and the cast that these leave; null where it has none."""
    cast = stats.cast_of(r, g, b)
    out = stats.exposure_of(r, g, b) | cast | dict.fromkeys(("cand_r", "cand_g", "cand_b", "after_cand"))
    gains = stats.gains_told(stats.gains_of(r, g, b))
    if gains is not None:
        gains = drawn_in(gains, 0.90 if stats.magnitude_told(cast) >= 0.04 else 0.62)
        after = stats.magnitude_of(*(applied(c * FULL, k) for c, k in zip((r, g, b), gains, strict=True)))
        out |= {"cand_r": gains[0], "cand_g": gains[1], "cand_b": gains[2], "after_cand": after}
    return out


def cast_after(pixels: DataFrame, work: DataFrame, alternatives: dict[str, RGB]) -> DataFrame:
    """frame_id and, for each alternative, after_<name>: the cast left when the gains are applied on whole steps of FULL.

    A frame's pixels and its gains meet as one group, where the alternatives are tried one after another: none is a row.
    """
    names = list(alternatives)
    gains = work.filter("frame_id is not null").select(F.col("frame_id").cast("long").alias("frame_id"), *(c.alias(f"{n}_{x}") for n, p in alternatives.items() for x, c in zip("rgb", p, strict=True)))
    own = pixels.filter("frame_id is not null").select(F.col("frame_id").cast("long").alias("frame_id"), *(F.col(c).cast("double").alias(c) for c in "rgb"))
    none = pa.schema([("frame_id", pa.int64()), *((f"after_{n}", pa.float64()) for n in names)])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none.empty_table()
        full = [left[c].to_numpy() * FULL for c in "rgb"]
        out = {"frame_id": [key[0].as_py()]}
        for n in names:
            k = [right[f"{n}_{c}"].to_numpy() for c in "rgb"]
            out[f"after_{n}"] = [stats.magnitude_of(*(applied(f, x) for f, x in zip(full, k, strict=True)))]
        return pa.table(out, schema=none)

    return own.groupBy("frame_id").cogroup(gains.groupBy("frame_id")).applyInArrow(run, ", ".join(["frame_id long", *(f"after_{n} double" for n in names)]))


def frame_work(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """A row a frame: exposure, cast, the neutral candidate's gains and how far they are to be trusted.

    Pixels without coordinates have no regions, so the neutral percentile candidate is the only one; it stands for the ensemble.
    """
    key = ["frame_id"]
    told = stats.by_group(dealt(pixels), key, MEASURED, measured)
    exposure = [part.split()[0] for part in stats.EXPOSURE.split(", ")]
    base = told.select(*key, *exposure, *(c.alias(n) for n, c in stats.cast_columns().items()), *(f"cand_{n}" for n in "rgb"), "after_cand").join(frames, "frame_id")
    base = base.withColumns({"has": F.col("cand_r").isNotNull()} | {f"cand_{n}": F.coalesce(f"cand_{n}", F.lit(1.0)) for n in "rgb"})
    has = F.col("has")
    before, after = F.col("magnitude"), F.col("after_cand")
    base = base.withColumns(named(logs(gains_of("cand")), "clog")).withColumn("gain_size", norm(*gains_of("clog")))
    gain_size = F.col("gain_size")
    evidence = 0.35 * F.least(F.lit(1.0), F.col("neutral_pixels") / 2400.0) + 0.35 * F.least(F.lit(1.0), F.col("neutral_fraction") / 0.08) + 0.30 * clip(1.0 - F.col("sat_median") / 0.36, 0.0, 1.0)
    safety = clip(1.0 - gain_size / F.when(before >= 0.04, 0.88).otherwise(0.62), 0.0, 1.0)
    score = 0.55 * clip((before - after) / F.greatest(before, F.lit(1e-6)), 0.0, 1.0) + 0.25 * evidence + 0.20 * safety
    obvious = has & (before > 0.005)
    base = base.withColumn("raw_score", F.when(obvious, score).otherwise(0.0))
    base = base.withColumns({"score": F.bround("raw_score", 4), "trust": F.bround(F.when(obvious, F.col("raw_score") * evidence * (0.35 + 0.65 * safety)).otherwise(0.0), 3), "after_cand": F.bround(after, 5)})
    valid = (F.col("trust") >= 0.18) & (F.col("score") >= 0.12) & (F.col("after_cand") < before)
    accepted = valid & (F.col("trust") >= 0.24) & (F.col("score") >= 0.18) & (F.col("after_cand") <= F.greatest(before * 0.97, before - 0.0025))
    base = base.withColumns({"accepted": F.coalesce(accepted, F.lit(False)), "exposure_class": stats.exposure_class(), "usable": stats.exposure_usable()})
    reason = relate.first_reason(
        (~F.col("accepted"), "unreliable correction"), (F.col("neutral_fraction") < 0.015, "low neutral evidence"), (F.col("gain_size") > 0.78, "large correction"),
        (F.col("exposure_class") == "low-light salvageable", "low-light excluded from baseline"), (F.col("exposure_class") == "extreme protected", "extreme exposure"), (~F.col("usable"), "exposure outlier"), otherwise="",
    )
    yes = F.col("accepted")
    return base.withColumn("exclusion", reason).select(
        "frame_id", "roll_id", "p05", "p25", "p50", "p75", "p95", "shadow_clip", "highlight_clip", "exposure_class", "usable", F.col("magnitude").alias("cast"), "neutral_fraction", "neutral_pixels", "exclusion",
        F.when(yes, "neutral_percentile").otherwise("identity").alias("algorithm"), *(F.when(yes, F.col(f"cand_{n}")).otherwise(1.0).alias(f"frame_{n}") for n in "rgb"),
        F.when(yes, F.col("trust")).otherwise(0.0).alias("confidence"), binary_round(F.when(yes, F.col("score")).when(valid, F.col("trust")).otherwise(0.0), 3).alias("agreement"),
        F.when(yes, F.col("after_cand")).otherwise(F.bround("magnitude", 5)).alias("after"), (yes & (F.col("exclusion") == "")).alias("used"),
    )


def baseline(work: DataFrame) -> DataFrame:
    """A row a roll: gains, exposure targets, cast strength, confidence, and the frames kept as an array."""
    key = ["roll_id"]
    used = work.filter("used").withColumns(named(logs(gains_of("frame")), "l")).withColumn("w", F.greatest(F.lit(0.01), F.col("confidence")))
    values = ["l_r", "l_g", "l_b"]
    c = settled(relate.gain_cluster(used, key, "frame_id", values, "w"))
    first = ordered.weighted_median(c.filter("in_cluster"), key, values, "w").withColumnsRenamed({v: f"m{v}" for v in values})
    c = settled(on(c, first, key)).withColumn("d", norm(*(F.col(v) - F.col(f"m{v}") for v in values)))
    mid = c.groupBy(*key).agg(F.median(F.when(F.col("in_cluster"), F.col("d"))).alias("md"))
    c = on(c, mid, key)
    mad = c.groupBy(*key).agg(F.median(F.when(F.col("in_cluster"), F.abs(F.col("d") - F.col("md")))).alias("mad"))
    limit = F.greatest(F.lit(0.16), F.col("md") + 2.5 * F.greatest(F.col("mad"), F.lit(0.018)))
    c = on(c, mad, key).withColumn("kept", F.col("in_cluster") & (F.col("d") <= limit))
    counts = c.groupBy(*key).agg(F.count_if("kept").alias("n_kept"), F.count(F.lit(1)).alias("n_used"))
    c = settled(on(c, counts, key).withColumn("kept", F.col("kept") | (F.col("n_kept") < 2)))
    kept = c.filter("kept")
    centre = ordered.weighted_median(kept, key, values, "w").withColumnsRenamed({v: f"c{v}" for v in values})
    spread = on(kept, centre, key).groupBy(*key).agg(
        (F.sum(norm(*(F.col(v) - F.col(f"c{v}") for v in values)) * F.col("w")) / F.sum("w")).alias("spread"), F.count(F.lit(1)).alias("n"), F.first("n_used").alias("n_used"), F.max("confidence").alias("only"),
        F.array_sort(F.collect_list("frame_id")).alias("kept_frames"), *(F.first(f"c{v}").alias(v) for v in values),
    )
    total = work.groupBy(*key).agg(F.count(F.lit(1)).alias("analysed"))
    out = settled(on(total, spread, key))
    several = F.coalesce(F.col("n_used") >= 2, F.lit(False))
    confidence = 0.35 * F.least(F.lit(1.0), F.col("n") / 8.0) + 0.30 * F.least(F.lit(1.0), F.col("n") / F.col("analysed") / 0.55) + 0.35 * clip(1.0 - F.col("spread") / 0.18, 0.0, 1.0)
    out = out.withColumns({
        **named(RGB(*(F.coalesce(x, F.lit(1.0)) for x in from_logs(rgb(*values)))), "roll"),
        "confidence": F.bround(F.coalesce(F.when(several, confidence).otherwise(F.col("only") * 0.45), F.lit(0.0)), 3),
        "used_count": F.coalesce("n", F.lit(0)), "kept_frames": F.coalesce("kept_frames", F.array().cast("array<bigint>")),
    })
    out = out.withColumn("warning", F.when(~several, "not enough reliable frames for roll baseline").when(F.col("confidence") >= 0.45, "").otherwise("low roll confidence"))
    out = on(out, exposure_targets(work, kept.select("frame_id")), key)
    out = on(out, cast_strength(kept, out), key)
    return out.select(
        "roll_id", "roll_r", "roll_g", "roll_b", F.coalesce("target_p50", F.lit(0.38)).alias("target_p50"), F.coalesce("target_p95", F.lit(0.86)).alias("target_p95"),
        F.coalesce("strength", F.lit(1.0)).alias("strength"), "confidence", "analysed", "used_count", "warning", "kept_frames",
    )


def exposure_targets(work: DataFrame, kept: DataFrame) -> DataFrame:
    """Medians of the rounded p50 and p95: of the kept frames if three of them are fit, else of all that are.

    They are rounded to 15 places first, so that the last bit of a value in the middle doesn't decide.
    """
    e = work.select("roll_id", "frame_id", "exposure_class", *(F.round(F.round(n, 15), 5).alias(n) for n in ("p50", "p95")))
    e = e.filter("exposure_class = 'normal' and p50 > 0.10 and p50 < 0.88 and p95 > 0.35 and p95 < 0.985")
    e = e.join(kept.select(F.col("frame_id").alias("_id")), F.col("frame_id") == F.col("_id"), "left").withColumn("mine", F.col("_id").isNotNull())
    enough = F.count_if("mine").over(Window.partitionBy("roll_id")) >= 3
    return e.withColumn("take", F.col("mine") | ~enough).groupBy("roll_id").agg(F.median(F.when(F.col("take"), F.col("p50"))).alias("target_p50"), F.median(F.when(F.col("take"), F.col("p95"))).alias("target_p95"))


def cast_strength(kept: DataFrame, rolls: DataFrame) -> DataFrame:
    """How much stronger a roll's cast may be corrected: 1, or up to 1.18 where the frames agree on its direction."""
    axes = rolls.select(F.col("roll_id").alias("_roll"), *(c.alias(f"a_{n}") for n, c in zip("rgb", logs(gains_of("roll")), strict=True)))
    a = rgb("a_r", "a_g", "a_b")
    f = kept.filter("confidence >= 0.30 and exposure_class = 'normal'").join(axes, F.col("roll_id") == F.col("_roll"))
    own = rgb("l_r", "l_g", "l_b")
    size, roll_size = norm(*own), norm(*a)
    cosine = sum((x * y for x, y in zip(own[1:], a[1:], strict=True)), own[0] * a[0]) / F.greatest(size * roll_size, F.lit(1e-6))
    f = f.withColumns({"size": size, "roll_size": roll_size, "cosine": cosine})
    far = F.col("size") >= 0.025
    near = far & (F.col("cosine") >= 0.35)
    g = f.groupBy("roll_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(far).alias("told"), F.count_if(near).alias("agree"), F.median(F.when(near, F.col("cosine"))).alias("mid"), F.first("roll_size").alias("roll_size"))
    share = F.col("agree") / F.greatest(F.col("told"), F.lit(1))
    good = (F.col("roll_size") >= 0.035) & (F.col("n") >= 5) & (F.col("told") >= 5) & (F.col("agree") >= F.greatest(F.lit(5), F.ceil(F.col("told") * 0.60))) & (share >= 0.62) & (F.col("mid") >= 0.65)
    strength = 1.0 + F.least(F.lit(0.18), (share - 0.60) * 0.28 + F.least(F.lit(0.08), F.col("roll_size") * 0.45))
    return g.select("roll_id", F.when(good & (strength >= 1.055), F.bround(strength, 3)).otherwise(1.0).alias("strength"))


# All thresholds, weights, limits and texts in the functions from here to ``tone_residuals`` decide plans that must come
# out as they do; they stand where they are used.


def harms(before: Column, after: Column) -> Column:
    return ((before <= 0.010) & (after >= 0.018)) | ((before <= 0.012) & (after >= 0.022)) | ((before <= 0.024) & (after >= 0.035)) | (after > before + 0.055)


def cosine(a: RGB, b: RGB) -> Column:
    return (a.r * b.r + a.g * b.g + a.b * b.b) / F.greatest(norm(*a) * norm(*b), F.lit(1e-6))


def membership(before: Column, after: Column, frame: RGB, roll: RGB) -> Column:
    """0 to 1: how well a frame fits its roll. ``frame`` and ``roll`` are logarithms of gains."""
    exposure = F.when(F.col("exposure_class") == "low-light salvageable", 0.45).when(F.col("exposure_class") == "extreme protected", 0.20).when(~F.col("usable"), 0.35).otherwise(1.0)
    effect = clip(0.50 + (before - after) / F.greatest(F.lit(0.006), before * 0.80), 0.0, 1.0)
    near_worse = (before <= 0.012) & (after > before + F.greatest(F.lit(0.002), before * 0.25))
    worse = after > before + F.greatest(F.lit(0.004), before * 0.50)
    effect = effect * F.when(near_worse, 0.15).when(worse, 0.45).otherwise(1.0)  # used four times below, so kept small
    direction = F.when(norm(*frame) < 0.015, 0.65).otherwise(clip((cosine(frame, roll) + 1.0) * 0.5, 0.0, 1.0))
    close = clip(1.0 - norm(*(a - b for a, b in zip(frame, roll, strict=True))) / 0.42, 0.0, 1.0)
    told = 0.38 * direction + 0.28 * close + 0.22 * F.col("agreement") + 0.12 * effect
    candidate = F.when((F.col("algorithm") == "identity") | (F.col("confidence") <= 0.0), 0.15 + 0.45 * effect).otherwise(told)
    evidence = F.least(F.lit(1.0), F.col("neutral_fraction") / 0.08)
    return F.when(norm(*roll) < 0.006, 0.0).otherwise(clip(0.42 * candidate + 0.33 * effect + 0.15 * evidence + 0.10 * exposure, 0.0, 1.0))


def frame_plans(pixels: DataFrame, work: DataFrame, rolls: DataFrame) -> DataFrame:
    """A row a frame: what to do, with which gains, and the cast that leaves."""
    key = ["frame_id"]
    pixels = dealt(pixels)
    roll = rolls.select("roll_id", *(f"roll_{n}" for n in "rgb"), "strength", "target_p50", "target_p95", (F.size("kept_frames") >= 2).alias("_two"))
    w = settled(work.join(roll, "roll_id"))
    w = settled(on(w, cast_after(pixels, w, {"roll": gains_of("roll")}), key))
    w = w.withColumns(named(logs(gains_of("roll")), "rlog") | named(logs(gains_of("frame")), "flog"))
    roll_log, frame_log = gains_of("rlog"), gains_of("flog")
    before = F.col("cast")
    w = w.withColumn("available", F.col("_two") & (norm(*roll_log) >= 0.006))
    member_after = F.when(F.col("available"), F.col("after_roll")).otherwise(before)
    w = w.withColumn("membership", membership(F.bround(before, 5), member_after, frame_log, roll_log))
    stronger = (F.col("strength") > 1.001) & (F.col("membership") >= 0.80) & (F.col("exposure_class") == "normal") & ~((F.bround(before, 5) <= 0.012) & (F.col("membership") < 0.92))
    factor = F.when(stronger, 1.0 + (clip(F.col("strength"), 1.0, 1.20) - 1.0) * clip((F.col("membership") - 0.80) / 0.18, 0.0, 1.0)).otherwise(1.0)
    w = w.withColumns(named(times(roll_log, factor).map(F.exp), "xs"))
    w = w.withColumns(named(unit_luma_gains(gains_of("xs")), "strong"))
    w = w.withColumns(named(logs(gains_of("strong")), "slog"))
    strong_log = gains_of("slog")
    combo = RGB(*(s + clip(f - s, -0.14, 0.14) * 0.45 for f, s in zip(frame_log, strong_log, strict=True)))
    share = 0.55 + 0.18 * clip((F.col("membership") - 0.55) / 0.35, 0.0, 1.0)
    w = w.withColumns(named(combo.map(F.exp), "xc") | named(times(frame_log, 0.45).map(F.exp), "xf") | named(times(strong_log, share).map(F.exp), "xr"))
    w = settled(w.withColumns(named(unit_luma_gains(gains_of("xc")), "combo") | named(unit_luma_gains(gains_of("xf")), "weakf") | named(unit_luma_gains(gains_of("xr")), "weakr")))
    names = ("strong", "frame", "combo", "weakf", "weakr")
    w = settled(on(w, cast_after(pixels, w, {n: gains_of(n) for n in names}), key))

    reliable = (F.col("algorithm") != "identity") & (F.col("confidence") >= 0.28)
    a = {n: F.col(f"after_{n}") for n in names}
    extreme = (F.col("exposure_class") == "extreme protected") | ~F.col("usable")
    low = F.col("exposure_class") == "low-light salvageable"
    blocked = (a["strong"] > before + F.greatest(F.lit(0.0015), before * 0.10)) & ((F.col("membership") < 0.30) | ((F.col("algorithm") == "identity") & (before <= 0.014) & (F.col("membership") < 0.48)))
    helps = reliable & (a["frame"] < before - F.greatest(F.lit(0.0025), before * 0.12))
    weak_helps = reliable & (a["weakf"] < before - F.greatest(F.lit(0.002), before * 0.10))
    sizes = norm(*frame_log), norm(*strong_log)
    agrees = (sizes[0] < 0.04) | (sizes[1] < 0.04) | (cosine(frame_log, strong_log) >= 0.20)
    conflicts = (sizes[0] >= 0.11) & (sizes[1] >= 0.04) & (cosine(frame_log, strong_log) < -0.25)
    residual = norm(*(f - s for f, s in zip(frame_log, strong_log, strict=True)))
    cases = [
        (extreme & reliable, "frame-only", "frame", "excluded from roll baseline"), (extreme, "review", "", "extreme exposure"),
        (low & ~F.col("available") & weak_helps, "frame-only", "weakf", "low-light weak correction"), (low & ~F.col("available") & (before <= 0.014), "none", "", "low-light no safe correction"),
        (low & ~F.col("available"), "review", "", "low-light no safe correction"),
        (low & (a["weakr"] <= before - F.greatest(F.lit(0.0015), before * 0.08)) & ~harms(before, a["weakr"]), "roll", "weakr", "low-light weak correction"),
        (low & weak_helps, "frame-only", "weakf", "low-light weak correction"),
        (low & (before <= 0.014) & (a["weakr"] <= before + F.greatest(F.lit(0.002), before * 0.20)), "none", "", "low-light protected"), (low, "review", "", "low-light protected"),
        (~F.col("available") & reliable, "frame-only", "frame", "no roll baseline"), (~F.col("available"), "none", "", "no roll baseline"),
        (blocked & helps, "frame-only", "frame", "low roll membership"), (blocked & (before <= 0.014), "none", "", "low roll membership"), (blocked, "review", "", "low roll membership"),
        (harms(before, a["strong"]) & reliable & agrees, "frame-only", "frame", "roll conflict"), (harms(before, a["strong"]), "review", "", "roll conflict"),
        (helps & (a["strong"] > before + F.greatest(F.lit(0.003), before * 0.12)), "frame-only", "frame", "roll local mismatch"),
        (~reliable, "roll", "strong", ""), (conflicts, "review", "", "frame conflicts with roll"), (residual <= 0.09, "roll", "strong", ""),
        (harms(before, a["combo"]) | (a["combo"] > F.least(before, a["strong"]) + 0.003), "roll", "strong", "frame residual skipped"), (F.lit(True), "roll+frame", "combo", ""),
    ]
    chosen = F.coalesce(*(F.when(test, F.struct(F.lit(action).alias("action"), F.lit(gain).alias("gain"), F.lit(text).alias("why"))) for test, action, gain, text in cases))
    w = w.withColumn("plan", chosen)
    pick = lambda column, default: F.coalesce(*(F.when(F.col("plan.gain") == n, column(n)) for n in names), default)
    stops, what = exposure_delta()
    return w.select(
        "roll_id", "frame_id", F.col("plan.action").alias("color_action"), F.col("plan.why").alias("warning"), *(pick(lambda n, x=x: F.col(f"{n}_{x}"), F.lit(1.0)).alias(f"safe_{x}") for x in "rgb"),
        F.bround("cast", 5).alias("before_cast"), F.bround(pick(lambda n: a[n], before), 5).alias("safe_after_cast"), F.bround("membership", 3).alias("membership"), "exposure_class",
        F.bround(stops, 3).alias("exposure_stops"), what.alias("exposure_action"), "algorithm", "confidence", "used",
    )


def exposure_delta() -> tuple[Column, Column]:
    """Stops towards the roll's targets, and what that is called; small or unsafe ones are nothing."""
    span = F.col("p75") - F.col("p25")
    guarded = (F.col("p50") <= 0.08) | (F.col("p95") <= 0.35) | (F.col("p50") >= 0.90) | (F.col("p95") >= 0.992) | (span <= 0.045) | (F.col("shadow_clip") >= 0.12) | (F.col("highlight_clip") >= 0.07)
    log2 = lambda t, v: F.log2(F.greatest(F.lit(0.001), F.col(t)) / F.greatest(F.lit(0.001), F.col(v)))
    mid, high = log2("target_p50", "p50"), log2("target_p95", "p95")
    up = (mid >= 0.50) & (high >= 0.22) & (F.col("p95") <= 0.90)
    down = (mid <= -0.48) & (high <= -0.20) & (F.col("p95") <= 0.965) & (F.col("highlight_clip") <= 0.01)
    brighter, darker = clip(mid * 0.70 + high * 0.30, 0.0, 0.55), clip(mid * 0.65 + high * 0.35, -0.32, 0.0)
    lifts, lowers = ~guarded & up & (brighter >= 0.10), ~guarded & ~up & down & (darker <= -0.10)
    return F.when(lifts, brighter).when(lowers, darker).otherwise(0.0), F.when(guarded, "exposure protected").when(lifts, "exposure brighten").when(lowers, "exposure darken").otherwise("none")


def combined_gains(roll_strength: float = 1.0, frame_strength: float = 0.45) -> RGB:
    """The gains to apply of frame_plans' columns."""
    a = F.col("color_action")
    k = F.when(a.isin(*IDENTITY), 0.0).when(a == "roll", roll_strength).otherwise(max(roll_strength, frame_strength))
    return from_logs(times(logs(gains_of("safe")), k))


def tone_residuals(pixels: DataFrame) -> DataFrame:
    """frame_id, band, gains and confidence for shadows, middle and highlights; the bands overlap."""
    bands = F.inline(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(m).alias("most")) for n, a, b, m in (("shadow", 0.08, 0.38, 0.055), ("mid", 0.25, 0.72, 0.105), ("highlight", 0.58, 0.93, 0.050)))))
    key = ["frame_id", "band"]
    p = stats.with_tone(pixels).select("*", bands).filter("luma >= low and luma <= high")
    p = stats.neutral(p, key, stats.clean_pixels((0.04, 0.97), 0.004, 0.992))
    n = F.col("neutral")
    m = p.groupBy(*key).agg(F.count(F.lit(1)).alias("all"), F.count_if(n).alias("n"), F.first("most").alias("most"), F.median(F.when(n, F.col("luma"))).alias("t"), F.median(F.when(n, F.col("sat"))).alias("sat"), *(F.median(F.when(n, F.col(c))).alias(c) for c in "rgb"))
    good = F.coalesce((F.col("all") >= 96) & (F.col("n") >= 64) & (F.col("t") > 1e-6) & (F.least("r", "g", "b") > 1e-6), F.lit(False))
    m = m.withColumns(named(logs(rgb().map(lambda c: F.col("t") / F.greatest(c, F.lit(1e-6)))), "log")).withColumn("size", norm(*gains_of("log")))
    m = m.withColumns(named(times(gains_of("log"), F.when(F.col("size") > F.col("most"), F.col("most") / F.greatest("size", F.lit(1e-6))).otherwise(1.0)).map(F.exp), "lim"))
    out = unit_luma_gains(gains_of("lim"))
    trust = 0.35 * F.least(F.lit(1.0), F.col("n") / 1600.0) + 0.35 * F.least(F.lit(1.0), F.col("n") / F.col("all") / 0.10) + 0.30 * clip(1.0 - F.col("sat") / 0.32, 0.0, 1.0)
    return m.select(*key, *(F.when(good, c).otherwise(1.0).alias(f"gain_{x}") for x, c in zip("rgb", out, strict=True)), F.when(good, trust).otherwise(0.0).alias("confidence"))


def summary(plans: DataFrame) -> DataFrame:
    """Medians, extremes and distributions of a roll's plans."""
    zero = F.lit(0.0)
    out = plans.groupBy("roll_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("used").alias("used"), F.round(F.coalesce(F.median("before_cast"), zero), 5).alias("median_before"), F.round(F.coalesce(F.median("safe_after_cast"), zero), 5).alias("median_after"),
        F.max("before_cast").alias("max_before"), F.max("safe_after_cast").alias("max_after"), F.count_if(F.col("safe_after_cast") > F.col("before_cast") + 0.003).alias("worsened"),
    )
    for column, name in (("color_action", "actions"), ("exposure_action", "exposures"), ("exposure_class", "classes")):
        counts = plans.groupBy("roll_id", column).agg(F.count(F.lit(1)).alias("n"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), "n"))), lambda x: F.concat_ws("=", x["k"], x["n"].cast("string"))), ",")
        out = on(out, counts.groupBy("roll_id").agg(text.alias(name)), ["roll_id"])
    return out
