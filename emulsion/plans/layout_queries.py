"""Queries of layout, small predicates, insets, strides, inverses, and the display chain as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import layout, relate, stats
from ..sources import rasters
from . import chain
from . import pixel_queries as px
from . import views
from .file_queries import RAWS, SUFFIX
from .registry import query

SIZES = "z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h, count(*) AS n FROM rs GROUP BY frame_id)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raster(spark, sf_dir)
    return stats.beside(r, ["frame_id"], w=F.max("x"), h=F.max("y")).withColumns({"w": F.col("w") + 1, "h": F.col("h") + 1})


@query("turned_frames", f"WITH {views.RASTER}, {SIZES} SELECT frame_id, CAST(x AS INTEGER) AS y, CAST(h - 1 - y AS INTEGER) AS x, round(g, 6) AS g FROM (SELECT rs.frame_id, y, w - 1 - x AS x, h, g FROM rs JOIN z USING (frame_id))")
def turned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored across, then turned once clockwise."""
    out = layout.laid_out(sized(spark, sf_dir), F.col("w"), F.col("h"), across=True, quarters=1)
    return out.select("frame_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round("g", 6).alias("g"))


@query(
    "source_points",
    f"""WITH {views.CANDIDATES}, b AS (SELECT cand_pos, unnest([0, 1, 2, 3]) AS k, x, y FROM cd),
t AS (SELECT cand_pos, k, CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 639 - x ELSE 639 - y END AS sx, CASE k WHEN 0 THEN y WHEN 1 THEN 479 - x WHEN 2 THEN 479 - y ELSE x END AS sy FROM b)
SELECT cand_pos, CAST(k AS INTEGER) AS k, CAST(least(greatest(sx, 0), 639) AS INTEGER) AS x, CAST(least(greatest(479 - sy, 0), 479) AS INTEGER) AS y FROM t""",
)
def source_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of candidates as points of a picture that is mirrored down and turned by each number of quarters."""
    d = views.candidates(spark, sf_dir)
    out = []
    for k in range(4):
        x, y = layout.source_place((F.col("x"), F.col("y")), F.lit(640), F.lit(480), down=True, quarters=k)
        out.append(F.struct(F.lit(k).alias("k"), x.cast("int").alias("x"), y.cast("int").alias("y")))
    return d.select("cand_pos", F.inline(F.array(*out)))


@query("brush_cells", f"WITH {views.RASTER}, d AS (SELECT frame_id, x, y, least(greatest(((x - 3) * 12 + (y - 4) * 8) / 208.0::DOUBLE, 0), 1) AS t FROM rs) SELECT frame_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum FROM d WHERE power(x - 3 - t * 12, 2) + power(y - 4 - t * 8, 2) <= 6.25 GROUP BY frame_id")
def brush_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raster(spark, sf_dir).filter(layout.in_stroke(F.col("x"), F.col("y"), (3, 4), (15, 12), 2.5))
    return r.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum"), F.sum("y").alias("y_sum"))


@query("inset_pixels", f"WITH {views.RASTER}, {SIZES}, c AS (SELECT frame_id, w, h, round_even(w * 0.05, 0) AS cw, round_even(h * 0.05, 0) AS ch FROM z) SELECT frame_id, count(*) AS n, round(avg(g), 6) AS g FROM rs JOIN c USING (frame_id) WHERE ch * 2 >= h OR cw * 2 >= w OR (y >= ch AND y < h - ch AND x >= cw AND x < w - cw) GROUP BY frame_id")
def inset_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rasters.inset(views.raster(spark, sf_dir), ["frame_id"], 0.05)
    return r.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g"), 6).alias("g"))


@query("strided_pixels", f"WITH {views.RASTER}, {SIZES} SELECT frame_id, count(*) AS n, round(avg(g), 6) AS g FROM rs JOIN z USING (frame_id) WHERE (y * w + x) % greatest(1, n // 50) = 0 GROUP BY frame_id")
def strided_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rasters.strided(views.raster(spark, sf_dir), ["frame_id"], 50)
    return r.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g"), 6).alias("g"))


@query(
    "channel_stretch",
    px.means_sql(f"{views.PIXELS}, q AS (SELECT frame_id, " + ", ".join(f"quantile_cont({n}, 0.001) AS l{n}, quantile_cont({n}, 0.998) AS h{n}" for n in "rgb") + " FROM px GROUP BY frame_id)", "px JOIN q USING (frame_id)", *px.each("least(greatest(CASE WHEN h$ <= l$ + 1e-6 THEN $ ELSE ($ - l$) / (h$ - l$) END, 0), 1)")),
)
def channel_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.channel_stretch(views.pixels(spark, sf_dir), px.KEY)
    return px.means(d, c.rgb())


@query(
    "printer_offsets",
    "WITH a AS (SELECT event_id, greatest(-100, least(100, event_id % 301 - 150)) AS a, (event_id % 90 - 45) / 1000.0::DOUBLE AS o FROM events), m AS (SELECT event_id, o, least(greatest(-a * 0.0009::DOUBLE, -0.09), 0.09) AS m FROM a) SELECT event_id, round(m, 9) AS manual, round(least(greatest(o + m, -0.13), 0.13), 9) AS effective FROM m",
)
def printer_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slider's printer offset, and what it makes of an automatic one."""
    axis = F.greatest(F.lit(-100), F.least(F.lit(100), F.col("event_id") % 301 - 150))
    manual = c.clip(-axis * c.CMY_PER_STEP, -c.CMY_MANUAL_MAX, c.CMY_MANUAL_MAX)
    limit = c.CMY_AUTO_MAX + c.CMY_MANUAL_MAX
    both = c.clip((F.col("event_id") % 90 - 45) / 1000.0 + manual, -limit, limit)
    return views.table(spark, sf_dir, "events").select("event_id", F.round(manual, 9).alias("manual"), F.round(both, 9).alias("effective"))


@query("decoded_integers", "SELECT event_id, round(power((event_id * 7919 % 65536) / 65535.0::DOUBLE, 2.2), 9) AS linear FROM events")
def decoded_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.round(c.decoded(F.col("event_id") * 7919 % 65536), 9).alias("linear"))


@query(
    "reference_neutrals",
    f"""WITH {views.PIXELS}, t AS (SELECT *, {px.LUMA709} AS l, (greatest(r, g, b) - least(r, g, b)) / greatest({px.LUMA709}, 1e-4) AS s FROM px),
n AS (SELECT frame_id, count(*) FILTER (l > 0.08 AND l < 0.88) AS a, count(*) FILTER (l > 0.04 AND l < 0.94) AS b FROM t GROUP BY frame_id),
m AS (SELECT t.*, CASE WHEN n.a >= 64 THEN l > 0.08 AND l < 0.88 WHEN n.b >= 64 THEN l > 0.04 AND l < 0.94 ELSE true END AS mid FROM t JOIN n USING (frame_id)),
q AS (SELECT frame_id, greatest(quantile_cont(s, 0.28) FILTER (mid), 0.08) AS c1, quantile_cont(s, 0.45) FILTER (mid) AS c2 FROM m GROUP BY frame_id)
SELECT frame_id, CASE WHEN count(*) FILTER (mid AND s <= c1 + 1e-12) >= 32 THEN count(*) FILTER (mid AND s <= c1 + 1e-12) ELSE count(*) FILTER (mid AND s <= c2 + 1e-12) END AS n FROM m JOIN q USING (frame_id) GROUP BY frame_id""",
)
def reference_neutrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.reference_neutrals(views.pixels(spark, sf_dir), px.KEY)
    return d.groupBy("frame_id").agg(F.count_if("neutral").alias("n"))


STATE = views.FILES + f", st AS (SELECT file_id, {SUFFIX} AS suffix, file_id % 7 <> 0 AS has_state, file_id % 3 = 0 AS done, CASE WHEN file_id % 11 <> 0 THEN file_id % 13 - 1 END AS w, 5 AS h FROM fl)"


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("file_id")
    return views.files(spark, sf_dir).select("file_id", relate.suffix(F.col("name")).alias("suffix"), (i % 7 != 0).alias("has_state"), (i % 3 == 0).alias("done"), F.when(i % 11 != 0, i % 13 - 1).alias("w"), F.lit(5).alias("h"))


@query("export_reasons", f"WITH {STATE} SELECT file_id, CASE WHEN NOT has_state THEN 'no_state' WHEN NOT done THEN 'not_completed' WHEN suffix NOT IN {RAWS} THEN 'not_raw:' || suffix WHEN w IS NULL THEN 'no_frame' WHEN w <= 0 THEN 'invalid_frame' ELSE 'accepted' END AS reason, done OR coalesce(w > 0, false) AND file_id % 2 = 0 AS restores FROM st")
def export_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = file_states(spark, sf_dir)
    reason = layout.export_reason(F.col("has_state"), F.col("done"), F.col("suffix"), F.col("suffix").isin(*relate.RAW_SUFFIXES), F.col("w"), F.col("h"))
    return d.select("file_id", reason.alias("reason"), layout.restores_positive(F.col("done"), F.col("w"), F.col("h"), F.col("file_id") % 2 == 0).alias("restores"))


@query("rectangle_labels", f"WITH {views.CANDIDATES} SELECT cand_pos, printf('x=%d, y=%d, w=%d, h=%d', x, y, width, height) || CASE WHEN abs(angle) <= 0.05 THEN '' ELSE printf(', angle=%.1f', angle) END AS label, x + width AS right_, y + height AS bottom, round(x + width / 2.0, 3) AS centre_x FROM cd")
def rectangle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h, a = (F.col(n) for n in ("x", "y", "width", "height", "angle"))
    return views.candidates(spark, sf_dir).select("cand_pos", layout.rectangle_label(x, y, w, h, a).alias("label"), (x + w).alias("right_"), (y + h).alias("bottom"), F.round(x + w / 2.0, 3).alias("centre_x"))


@query("training_split", "SELECT p_partkey AS id, CAST('0x' || substr(md5('7:' || p_partkey), 1, 8) AS BIGINT) % 100 < 25 AS test FROM part")
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), layout.held_back(F.col("p_partkey")).alias("test"))


@query(
    "inverse_curve",
    f"""WITH RECURSIVE bi AS (SELECT DISTINCT (event_id % 97 + 1) / 98.0::DOUBLE AS t, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS k FROM events
  UNION ALL SELECT t, CASE WHEN v < t THEN (lo + hi) * 0.5 ELSE lo END, CASE WHEN v < t THEN hi ELSE (lo + hi) * 0.5 END, k + 1 FROM (SELECT *, least(greatest({px.ACES_SQL.replace('x', '((lo + hi) * 0.5)').replace('ma((lo + hi) * 0.5)', 'max').replace('e((lo + hi) * 0.5)p', 'exp')} / {px.ACES_SQL.replace('x', '1.0::DOUBLE')}, 0), 1) AS v FROM bi WHERE k < 24))
SELECT event_id, round((lo + hi) * 0.5, 6) AS x FROM events JOIN bi ON bi.k = 24 AND bi.t = (event_id % 97 + 1) / 98.0::DOUBLE""",
)
def inverse_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "events").withColumn("t", (F.col("event_id") % 97 + 1) / 98.0)
    targets = d.select("t").distinct()  # one search for each target, not for each row
    return d.join(targets.withColumn("x", c.inverse_curve(F.col("t"), "filmic_aces")), "t").select("event_id", F.round("x", 6).alias("x"))


def _chain_sql(linear: bool = False) -> str:
    response = ", ".join(f"{px.response_sql(f'(round_even({n} * 16383, 0) / 16383 + o_{n})', px.STANDARD.pivot, px.STANDARD.slope, 0.12)} AS {n}" for n in "rgb")
    tones = px.tones_ctes("pr", 40, -55)
    bent = ", ".join(f"{px.LUMA709} + ({n} - {px.LUMA709}) * 1.81 AS {n}" for n in "rgb")
    eight = ", ".join(f"CAST(sum(CAST(floor(power(least(greatest({n}, 0), 1), 1 / 2.2::DOUBLE) * 255 + 0.5) AS INTEGER)) AS BIGINT) AS {n}_sum" for n in "rgb")
    if linear:
        eight = ", ".join(f"round(avg(greatest({n}, 0)), 6) AS {n}_avg" for n in "rgb")
    return (
        f"WITH {views.PIXELS}, {px.NORMAL}, {px.OFFSETS}, pr AS (SELECT frame_id, {response} FROM (SELECT nl.*, o_r, o_g, o_b FROM nl JOIN os USING (frame_id))), "
        f"an AS (SELECT frame_id, least(greatest(quantile_cont({px.LUMA709}, 0.55), 0.32), 0.62) AS anchor FROM pr GROUP BY frame_id), {tones}, "
        f"un AS (SELECT frame_id, least(greatest(r * ratio, 0), 1) AS r, least(greatest(g * ratio, 0), 1) AS g, least(greatest(b * ratio, 0), 1) AS b FROM tr), sa AS (SELECT frame_id, {bent} FROM un), {px.gamut_sql('sa')} SELECT frame_id, {eight} FROM gc GROUP BY frame_id"
    )


def rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, c.RGB]:
    """Log bounds, offsets, print, highlights and shadows, saturation: the pixels before they are encoded, and their channels."""
    return chain.developed(views.pixels(spark, sf_dir), chain.Look(shadows=40, highlights=-55, saturation=60), px.gamut)


@query("display_chain", _chain_sql())
def display_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the negative to 8-bit values in one plan."""
    done, p = rendered(spark, sf_dir)
    return done.groupBy("frame_id").agg(*(F.sum(c.encoded(x)).alias(f"{k}_sum") for k, x in zip("rgb", p, strict=True)))


@query("export_chain", _chain_sql(linear=True))
def export_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the negative to what an export encodes, with the same tone anchor as on display."""
    done, p = rendered(spark, sf_dir)
    return done.groupBy("frame_id").agg(*(F.round(F.avg(F.greatest(x, F.lit(0.0))), 6).alias(f"{k}_avg") for k, x in zip("rgb", p, strict=True)))


FULL = chain.Look(
    levels=(3, 46, 97), soft_black=True, manual_offsets=(0.01, 0.0, -0.02), separation=0.45, roll=("gain_r", "gain_g", "gain_b"), shadows=25, highlights=-30, saturation=20,
    balance=c.ColourBalance(overall=c.Balance(6, -4, 2), tones=(("shadows", c.Balance(0, 5, -5)),)), camera=((1.1, -0.05, -0.05), (-0.03, 1.06, -0.03), (-0.02, -0.08, 1.1)), camera_strength=0.6,
)


@query("full_chain")
def full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on, with a roll's gains that differ by frame."""
    turn = (F.col("frame_id") % 5 - 2) * 0.02
    p = views.pixels(spark, sf_dir).withColumns({"gain_r": 1.0 + turn, "gain_g": F.lit(1.0), "gain_b": 1.0 - turn})
    done, q = chain.developed(p, FULL, px.gamut)
    return done.groupBy("frame_id").agg(*(F.sum(c.encoded(x)).alias(f"{k}_sum") for k, x in zip("rgb", q, strict=True)))
