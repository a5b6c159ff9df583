"""Queries of neighbourhood work, by frame: blur, texture, detail, warp, resize, components, peaks, overlap, midpoint."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import frames, ordered, relate, texture, tiles
from . import views
from .order_queries import ANGLE
from .pixel_queries import STANDARD, normal_log
from .registry import query


def luma_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raster(spark, sf_dir).select("frame_id", "y", "x", c.luma709(c.rgb()).alias("v"))


def summed(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy("frame_id").agg(*(F.round(F.avg(n), 6).alias(f"{n}_avg") for n in names), *(F.round(F.max(n), 6).alias(f"{n}_max") for n in names), F.count(F.lit(1)).alias("n"))


def _blur_sql(sigma: float) -> str:
    """Both passes of the blur as joins with the offsets' weights; the border is reflected, missing cells are 0."""
    reach = (round(sigma * 8 + 1) | 1) // 2
    at = lambda p, n: f"CASE WHEN {p} < 0 THEN -({p}) WHEN {p} > {n} - 1 THEN 2 * ({n} - 1) - ({p}) ELSE {p} END"
    weights = f"wt AS (SELECT o, exp(-0.5 * power(o / {sigma}::DOUBLE, 2)) / sum(exp(-0.5 * power(o / {sigma}::DOUBLE, 2))) OVER () AS k FROM range({-reach}, {reach + 1}) t(o))"
    grid = """z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM rs GROUP BY frame_id),
ce AS (SELECT frame_id, w, h, yy AS y, xx AS x FROM z, unnest(range(h)) a(yy), unnest(range(w)) b(xx)),
v0 AS (SELECT ce.*, coalesce(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE, 0) AS v FROM ce LEFT JOIN rs USING (frame_id, y, x))"""
    down = f"v1 AS (SELECT c.frame_id, c.w, c.h, c.y, c.x, sum(p.v * k) AS v FROM v0 c CROSS JOIN wt JOIN v0 p ON p.frame_id = c.frame_id AND p.x = c.x AND p.y = {at('(c.y + o)', 'c.h')} GROUP BY ALL)"
    across = f"v2 AS (SELECT c.frame_id, c.y, c.x, sum(p.v * k) AS v FROM v1 c CROSS JOIN wt JOIN v1 p ON p.frame_id = c.frame_id AND p.y = c.y AND p.x = {at('(c.x + o)', 'c.w')} GROUP BY ALL)"
    return f"WITH {views.RASTER}, {weights}, {grid}, {down}, {across} SELECT frame_id, round(avg(v), 6) AS v_avg, round(max(v), 6) AS v_max, count(*) AS n FROM v2 GROUP BY frame_id"


@query("blurred_luma", _blur_sql(2.0))
def blurred_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(texture.blurred(luma_raster(spark, sf_dir), 2.0), "v")


@query("texture_map")
def texture_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(texture.texture_map(luma_raster(spark, sf_dir)).withColumnRenamed("texture", "v"), "v")


@query("enhanced_detail")
def enhanced_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.floor(F.least(F.pow("v", 1 / 2.2) * 255 + 0.5, F.lit(255.0))).cast("double")
    return summed(texture.detailed(luma_raster(spark, sf_dir).withColumn("v", shown)), "v")


#: A tile's corner and mean of its cells, merged by the windows' weights; 15 cells a tile, each 8.
TILED_SQL = f"""WITH {views.RASTER}, sz AS (SELECT frame_id, max(y) + 1 AS h, max(x) + 1 AS w FROM rs GROUP BY frame_id),
lu AS (SELECT frame_id, y, x, h, w, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS v FROM rs JOIN sz USING (frame_id)),
ys AS (SELECT frame_id, h, w, unnest(list_distinct(list_append(list_filter(range(0, greatest(h - 15, 0) + 1, 8), lambda s: s <= h - 15), greatest(h - 15, 0)))) AS ty FROM sz),
ts AS (SELECT frame_id, h, w, ty, unnest(list_distinct(list_append(list_filter(range(0, greatest(w - 15, 0) + 1, 8), lambda s: s <= w - 15), greatest(w - 15, 0)))) AS tx FROM ys),
hn AS (SELECT i, greatest(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 14), 0.08) AS k FROM range(15) t(i)),
ce AS (SELECT frame_id, ty, tx, v, a.k * b.k AS k, y, x, (y - ty) * 1000 + x - tx AS at FROM lu JOIN ts USING (frame_id) JOIN hn a ON a.i = y - ty JOIN hn b ON b.i = x - tx WHERE y >= ty AND y < ty + 15 AND x >= tx AND x < tx + 15),
tv AS (SELECT *, max(v) OVER (PARTITION BY frame_id, ty, tx) AS top FROM ce),
mg AS (SELECT frame_id, y, x, sum(top * k) / sum(k) AS v FROM tv GROUP BY ALL)
SELECT frame_id, round(avg(v), 6) AS v_avg, round(max(v), 6) AS v_max, count(*) AS n FROM mg GROUP BY frame_id"""


@query("tiled_maximum", TILED_SQL)
def tiled_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile says its largest value for all of its cells; overlapping tiles are merged by their windows."""
    seen = luma_raster(spark, sf_dir)
    merged = tiles.blended(seen, ["v"], ["v"], lambda v: {"v": np.full_like(v, v.max())}, tile=15, overlap=7, least_stride=8)
    return summed(merged.join(seen.select("frame_id", "y", "x"), ["frame_id", "y", "x"], "left_semi"), "v")


def specks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, y, x, probability, texture, threshold of cells that may be dust: bright ones, and those of a colour of their own."""
    r = views.raster(spark, sf_dir)
    v = c.luma709(c.rgb())
    own = F.abs(F.col("r") - F.col("b"))
    d = r.select("frame_id", "y", "x", v.alias("probability"), (own * 4.0).alias("texture"), (0.55 + 0.2 * F.col("g")).alias("threshold"))
    return d.filter(F.col("probability") >= F.col("threshold") - 0.05 * (F.col("x") % 3))


@query("dust_components")
def dust_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many components of each frame stay, and why others go; tiles of eight cells, so that most components cross a border."""
    d = tiles.settled(specks(spark, sf_dir))
    found = tiles.components(d, 8)
    return tiles.mask_report(tiles.judged_components(d.join(found, ["frame_id", "y", "x"])))


@query("warped_crop")
def warped_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(frames.by_frame(luma_raster(spark, sf_dir), ["v"], "v double", lambda v: {"v": frames.warped(v, (3, 4, 16, 12, 7.5))}), "v")


@query(
    "halved_frames",
    f"WITH {views.RASTER}, h AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, avg(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) AS v FROM rs GROUP BY ALL) SELECT frame_id, round(avg(v), 6) AS v_avg, round(max(v), 6) AS v_max, count(*) AS n FROM h GROUP BY frame_id",
)
def halved_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer ratio needs no frame in one place: a grouped mean."""
    v = luma_raster(spark, sf_dir)
    return summed(v.groupBy("frame_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("v").alias("v")), "v")


@query("resized_frames")
def resized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(frames.by_frame(luma_raster(spark, sf_dir), ["v"], "v double", lambda v: {"v": frames.area_resized(v, 17)}), "v")


@query("flat_field_gain")
def flat_field_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(frames.by_frame(luma_raster(spark, sf_dir), ["v"], "v double", lambda v: {"v": frames.flat_field_gain(v)}), "v")


@query("radial_gain", f"WITH {views.RASTER}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM rs GROUP BY frame_id), d AS (SELECT frame_id, least(sqrt((x - 0.5 * greatest(w - 1, 1)) ** 2 + (y - 0.5 * greatest(h - 1, 1)) ** 2) / (greatest(w, h) * 0.5), 1) AS d FROM rs JOIN z USING (frame_id)) SELECT frame_id, round(avg(least(greatest(1 + 0.6 * power(d, 2) * 1.0, 1), 2)), 6) AS gain_avg, round(max(least(greatest(1 + 0.6 * power(d, 2) * 1.0, 1), 2)), 6) AS gain_max, count(*) AS n FROM d GROUP BY frame_id")
def radial_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raster(spark, sf_dir)
    size = r.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return summed(r.join(size, "frame_id").select("frame_id", c.radial_gain(F.col("x"), F.col("y"), F.col("w"), F.col("h"), strength=60).alias("gain")), "gain")


@query("cleaned_components")
def cleaned_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright and dark specks as components of three cells or more, grown by a cell."""
    work = lambda v: {"number": frames.labelled(v > 0.8).astype(np.int64), "kept": frames.cleaned(v > 0.8).astype(np.int64)}
    d = frames.by_frame(luma_raster(spark, sf_dir), ["v"], "number long, kept long", work)
    return d.groupBy("frame_id").agg(F.max("number").alias("components"), F.sum("kept").alias("kept"))


@query("protected_highlights")
def protected_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky and clouds keep their look when the rest is brightened."""

    def work(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        luma, hi, lo = r * 0.299 + g * 0.587 + b * 0.114, np.max([r, g, b], axis=0), np.min([r, g, b], axis=0)
        sat = (hi - lo) / np.maximum(hi, 1e-6)
        down = np.arange(r.shape[0])[:, None] / max(1, r.shape[0] - 1) + np.zeros_like(r)
        cloud = (luma >= 0.62) & (luma <= 0.988) & (down <= 0.86) & (sat <= 0.14) & (hi <= 0.992)
        after = [np.clip(x * 1.2, 0, 1) for x in (r, g, b)]
        out = frames.protected_blend([r, g, b], after, cloud, 0.8) if cloud.sum() >= 96 else after
        return dict(zip("rgb", out, strict=True))

    return summed(frames.by_frame(views.raster(spark, sf_dir), ["r", "g", "b"], "r double, g double, b double", work), "r", "g", "b")


@query("profile_peaks")
def profile_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four places of a profile that stand out, six apart."""
    return frames.peaks(views.profile(spark, sf_dir), 74.0, 1.4, 3.5, 6, 4).withColumn("score", F.round("score", 6))


def _overlap_sql() -> str:
    names = ("x", "y", "width", "height", "angle")
    ctes, last = [], "ro"
    for k, step in enumerate(relate.rotated_overlap_steps({n: f"a_{n}" for n in names}, {n: f"b_{n}" for n in names})):
        ctes.append(f"r{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {last})")
        last = f"r{k}"
    own = lambda p: ", ".join(f"{p}.{n}::DOUBLE AS {p}_{n}" for n in names[:-1])
    turn = lambda p: ANGLE.replace("angle", f"{p}.angle") + f"::DOUBLE AS {p}_angle"
    return (
        f"WITH {views.CANDIDATES}, f AS (SELECT frame_id, min(cand_pos) AS p FROM cd GROUP BY frame_id), ro AS (SELECT a.cand_pos, {own('a')}, {turn('a')}, {own('b')}, {turn('b')} FROM cd a JOIN f USING (frame_id) JOIN cd b ON b.cand_pos = f.p), "
        f"{', '.join(ctes)} SELECT cand_pos, round(iou, 6) AS iou FROM {last}"
    )


@query("rotated_overlap", _overlap_sql())
def rotated_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.candidates(spark, sf_dir).withColumn("angle", relate.normal_angle(F.col("angle")))
    first = ordered.first_wins(d, [], "cand_pos", ["frame_id"])
    a, b = (x.select("frame_id", *(["cand_pos"] if p == "a" else []), *(F.col(n).cast("double").alias(f"{p}_{n}") for n in ("x", "y", "width", "height", "angle"))) for x, p in ((d, "a"), (first, "b")))
    return relate.rotated_overlaps(a.join(b, "frame_id"), "a", "b").select("cand_pos", F.round("iou", 6).alias("iou"))


@query("visual_midpoint")
def visual_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.visual_midpoint(normal_log(spark, sf_dir), STANDARD.slope, STANDARD.pivot, 0.12)
