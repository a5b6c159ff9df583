"""The regional neutral candidate: each tile of a frame votes for gains, and the tiles that agree decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import clip, log_gain, rgb, unit_luma_gains
from . import ordered, regions, relate, stats
from .scratch import settled

TILE = ["frame_id", "tile_row", "tile_col"]
#: Frames under so many pixels a side have no regions.
LEAST_SIDE = 96


def tile_votes(raster: DataFrame) -> DataFrame:
    """frame_id, tile_row, tile_col, scene, reject (empty if the tile votes), weight, and l_r, l_g, l_b, logarithms of its gains."""
    size = raster.groupBy("frame_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    r = raster.join(size.filter((F.col("_w") >= LEAST_SIDE) & (F.col("_h") >= LEAST_SIDE)), "frame_id")
    t = regions.tiled(r, F.col("_w"), F.col("_h")).drop("_w", "_h")
    e = stats.exposure_metrics(t, TILE)
    p = stats.neutral(stats.with_tone(t), TILE, stats.clean_pixels((0.07, 0.95), 0.008, 0.988)).withColumn("used", F.col("neutral"))
    kept = stats.trimmed(p, TILE, "used", 0.78, 96, 64, {c: F.col(c) for c in "rgb"})
    used = F.col("used")
    m = kept.groupBy(*TILE).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("clean").alias("n_clean"), F.count_if("neutral").alias("n"), F.median(F.when(F.col("clean"), F.col("sat"))).alias("sat_clean"), F.median(F.when(F.col("neutral"), F.col("sat"))).alias("sat_neutral"),
        F.median(F.when(used, F.col("luma"))).alias("t"), *(F.median(F.when(used, F.col(c))).alias(c) for c in "rgb"),
    )
    v = settled(stats.on(stats.on(m, e, TILE), regions.scene(t, TILE), TILE))
    gains = rgb().map(lambda c: F.col("t") / F.greatest(c, F.lit(1e-6)))
    v = v.withColumns({f"l_{n}": c for n, c in zip("rgb", unit_luma_gains(gains).map(log_gain), strict=True)})
    span = F.col("p75") - F.col("p25")
    reject = relate.first_reason(
        ((F.col("p50") <= 0.08) | (F.col("p50") >= 0.88), "extreme midtone"), ((F.col("p95") <= 0.28) | (F.col("p95") >= 0.992), "extreme highlight"), ((F.col("shadow_clip") >= 0.08) | (F.col("highlight_clip") >= 0.05), "clipping"),
        (span <= 0.045, "low dynamic range"), (F.col("pixels") < 96, "too few pixels"), (F.col("reject") != "", "scene"), (F.col("n_clean") < 96, "too few clean pixels"), (F.col("sat_clean") >= 0.40, "high saturation"),
        (F.col("n") < 64, "not enough neutral pixels"), (F.col("n") / F.greatest(F.col("n_clean"), F.lit(1)) < 0.045, "low neutral fraction"), ((F.col("t") <= 1e-6) | (F.least("r", "g", "b") <= 1e-6), "unstable neutral sample"),
        (stats.norm(F.col("l_r"), F.col("l_g"), F.col("l_b")) > 0.80, "large regional correction"), otherwise="",
    )
    weight = (0.30 + 0.30 * clip(1.0 - F.col("sat_neutral") / 0.32, 0.0, 1.0) + 0.25 * clip(span / 0.22, 0.0, 1.0) + 0.15 * F.least(F.lit(1.0), F.col("n") / 800.0)) * F.col("weight")
    told = F.when(reject == "scene", F.col("reject")).otherwise(reject)
    return v.select(*TILE, "scene", told.alias("reject"), weight.alias("weight"), "l_r", "l_g", "l_b")


def regional_candidate(votes: DataFrame) -> DataFrame:
    """A row a frame: gains, agreement, the numbers of tiles that voted, counted and were rejected, the scene, three top reasons.

    Fewer than three votes give no gains. If fewer than three tiles agree, all that voted count.
    """
    key = ["frame_id"]
    logs = ["l_r", "l_g", "l_b"]
    tally = votes.groupBy(*key).agg(F.count_if(F.col("reject") == "").alias("accepted"), F.count_if(F.col("reject") != "").alias("rejected"))
    scenes = ordered.dominant(votes, key, "scene").select("frame_id", F.col("dominant").alias("scene"))
    reasons = votes.filter("reject != ''").groupBy("frame_id", "reject").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(*key).orderBy(F.desc("n"), "reject")
    top = reasons.withColumn("_p", F.row_number().over(place)).filter("_p <= 3")
    top = top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "reject"))), lambda x: x["reject"]).alias("reasons"))
    good = votes.filter("reject = ''").withColumn("tile", F.col("tile_row") * 16 + F.col("tile_col"))
    c = relate.gain_cluster(good, key, "tile", logs, "weight")
    c = stats.beside(c, key, _agree=F.count_if("in_cluster")).withColumn("_take", F.col("in_cluster") | (F.col("_agree") < 3))
    kept = settled(c.filter("_take"))
    centre = ordered.weighted_median(kept, key, logs, "weight").withColumnsRenamed({n: f"c{n}" for n in logs})
    away = stats.norm(*(F.col(n) - F.col(f"c{n}") for n in logs))
    spread = stats.on(kept, centre, key).groupBy(*key).agg((F.sum(away * F.col("weight")) / F.sum("weight")).alias("spread"), F.count(F.lit(1)).alias("counted"), *(F.first(f"c{n}").alias(n) for n in logs))
    out = stats.on(stats.on(stats.on(tally, scenes, key), top, key), spread, key)
    enough = F.col("accepted") >= 3
    p = unit_luma_gains(rgb(*logs).map(F.exp))
    return out.select(
        "frame_id", "accepted", "rejected", "scene", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), F.when(enough, F.col("counted")).alias("counted"),
        F.when(enough, clip(1.0 - F.col("spread") / 0.26, 0.0, 1.0)).alias("agreement"), *(F.when(enough, c).alias(f"gain_{n}") for n, c in zip("rgb", p, strict=True)),
    )


# What a candidate of gains must have to count in the ensemble.
CANDIDATE_TRUST, CANDIDATE_SCORE, AGREEMENT_SPAN = 0.18, 0.12, 0.22


def ensemble(candidates: DataFrame, before: str = "before") -> DataFrame:
    """A row a frame: algorithm, gains, score, confidence, warning and counted, from the candidates that agree.

    ``candidates`` has frame_id, pos, algorithm, gain_r, gain_g, gain_b, confidence, score, after, warning and the frame's cast
    ``before``. One valid candidate is taken as it is; without any, the warning is that of the best-scored one, the first on
    ties, and the gains are 1.
    """
    key, logs = ["frame_id"], ["l_r", "l_g", "l_b"]
    valid = (F.col("algorithm") != "identity") & (F.col("confidence") >= CANDIDATE_TRUST) & (F.col("score") >= CANDIDATE_SCORE) & (F.col("after") < F.col(before))
    d = candidates.withColumns({"_valid": F.coalesce(valid, F.lit(False)), "_w": F.greatest(F.lit(0.01), F.col("confidence")) * F.greatest(F.lit(0.01), F.col("score"))})
    d = d.withColumns({f"l_{n}": log_gain(F.col(f"gain_{n}")) for n in "rgb"})
    told = d.groupBy(*key).agg(F.count_if("_valid").alias("_n"), F.max(F.struct("score", (-F.col("pos")).alias("o"), "warning")).alias("_best"))
    kept = settled(relate.gain_cluster(d.filter("_valid"), key, "pos", logs, "_w").filter("in_cluster"))
    centre = ordered.weighted_median(kept, key, logs, "_w").withColumnsRenamed({n: f"c{n}" for n in logs})
    away = stats.norm(*(F.col(n) - F.col(f"c{n}") for n in logs))
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "algorithm"))), lambda x: x["algorithm"])
    mean = lambda c: F.sum(c * F.col("_w")) / F.sum("_w")
    s = stats.on(kept, centre, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("counted"), names.alias("_names"), mean(away).alias("_spread"), mean(F.col("confidence")).alias("_trust"), *(F.first(f"c{n}").alias(n) for n in logs),
        F.first("score").alias("_score"), F.first("confidence").alias("_own"), F.first("warning").alias("_warning"), *(F.first(f"gain_{n}").alias(f"_gain_{n}") for n in "rgb"),
    )
    j = stats.on(told, s, key)
    single, none = F.col("_n") == 1, F.col("_n") == 0
    agreement, number = clip(1.0 - F.col("_spread") / AGREEMENT_SPAN, 0.0, 1.0), F.least(F.lit(1.0), F.col("counted") / 3.0)
    name = F.when(none, "identity").when(F.col("counted") >= 2, F.concat(F.lit("ensemble("), F.array_join("_names", "+"), F.lit(")"))).otherwise(F.get("_names", 0))
    quiet = F.coalesce(F.nullif("_best.warning", F.lit("")), F.lit("no candidate consensus"))
    warning = F.when(none, quiet).when(single, F.col("_warning")).when(F.col("counted") >= 2, "").otherwise("single candidate cluster")
    p = unit_luma_gains(rgb(*logs).map(F.exp))
    return j.select(
        "frame_id", name.alias("algorithm"), *(F.when(none, 1.0).when(single, F.col(f"_gain_{n}")).otherwise(c).alias(f"gain_{n}") for n, c in zip("rgb", p, strict=True)),
        F.when(none, 0.0).when(single, F.col("_score")).otherwise(F.bround(agreement * number, 4)).alias("score"),
        F.when(none, 0.0).when(single, F.col("_own")).otherwise(F.bround(F.col("_trust") * (0.55 + 0.45 * agreement) * (0.75 + 0.25 * number), 3)).alias("confidence"), warning.alias("warning"), F.coalesce("counted", F.lit(0)).alias("counted"),
    )
