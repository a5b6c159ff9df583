"""Queries of parts of frames, and of reports and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import areas, regions, relate, tiles
from . import views
from .pixel_queries import LUMA601
from .registry import query

TONE = f"(SELECT *, {LUMA601} AS luma, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (greatest(r, g, b) - least(r, g, b)) / greatest(greatest(r, g, b), 1e-6) AS sat FROM rs)"


@query(
    "tile_scenes",
    f"""WITH {views.RASTER}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM rs GROUP BY frame_id),
t AS (SELECT p.*, {' + '.join(f"CASE WHEN y >= round_even(h * {k} / 4.0, 0) THEN 1 ELSE 0 END" for k in (1, 2, 3))} AS tile_row, {' + '.join(f"CASE WHEN x >= round_even(w * {k} / 4.0, 0) THEN 1 ELSE 0 END" for k in (1, 2, 3))} AS tile_col FROM {TONE} p JOIN z USING (frame_id)),
s AS (SELECT frame_id, tile_row, tile_col, avg(CASE WHEN b > r * 1.05 AND b >= g * 0.98 AND luma >= 0.34 AND sat >= 0.08 THEN 1.0 ELSE 0 END) AS sky, avg(CASE WHEN g > r * 1.04 AND g > b * 1.08 AND luma >= 0.12 AND sat >= 0.30 THEN 1.0 ELSE 0 END) AS leaf,
  avg(CASE WHEN r > g * 1.08 AND r > b * 1.15 AND luma >= 0.16 AND sat >= 0.42 THEN 1.0 ELSE 0 END) AS red, avg(CASE WHEN sat >= 0.48 THEN 1.0 ELSE 0 END) AS loud, avg(CASE WHEN luma <= 0.18 THEN 1.0 ELSE 0 END) AS dark, quantile_cont(luma, 0.5) AS p50, quantile_cont(luma, 0.75) AS p75 FROM t GROUP BY ALL),
k AS (SELECT *, CASE WHEN dark >= 0.70 OR (p50 <= 0.18 AND p75 <= 0.34) THEN 1 WHEN sky >= 0.46 THEN 2 WHEN leaf >= 0.46 THEN 3 WHEN red >= 0.40 THEN 4 WHEN loud >= 0.42 THEN 5 WHEN sky >= 0.28 THEN 6 WHEN leaf >= 0.28 THEN 7 WHEN red >= 0.24 THEN 8 ELSE 9 END AS k FROM s)
SELECT frame_id, tile_row, tile_col, ['shadow-dominant', 'sky-heavy', 'foliage-heavy', 'skin/object-heavy', 'high-saturation', 'sky-heavy', 'foliage-heavy', 'skin/object-heavy', 'mixed-neutral'][k] AS scene, [0.45, 0.35, 0.30, 0.40, 0.20, 0.55, 0.50, 0.55, 1.0][k]::DOUBLE AS weight,
  ['shadow dominant', 'sky dominated', 'foliage dominated', 'skin or red object dominated', 'high saturation scene', '', '', '', ''][k] AS reject FROM k""",
)
def tile_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raster(spark, sf_dir)
    size = r.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    t = regions.tiled(r.join(size, "frame_id"), F.col("w"), F.col("h"))
    return regions.scene(t, ["frame_id", "tile_row", "tile_col"])


@query(
    "patch_medians",
    f"""WITH {views.RASTER}, pt AS (SELECT DISTINCT frame_id, CAST(frame_id % 20 AS INTEGER) AS px, CAST(frame_id % 17 AS INTEGER) AS py FROM rs),
j AS (SELECT rs.*, px, py, least(r, g, b) > 0.01 AND greatest(r, g, b) < 0.99 AS o FROM rs JOIN pt USING (frame_id) WHERE x BETWEEN px - 4 AND px + 4 AND y BETWEEN py - 4 AND py + 4)
SELECT frame_id, px, py, count(*) AS n, {', '.join(f"round(CASE WHEN count(*) FILTER (o) >= 16 THEN median({n}) FILTER (o) ELSE median({n}) END, 9) AS {n}" for n in 'rgb')} FROM j GROUP BY frame_id, px, py""",
)
def patch_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.raster(spark, sf_dir)
    points = r.select("frame_id").distinct().withColumns({"px": (F.col("frame_id") % 20).cast("int"), "py": (F.col("frame_id") % 17).cast("int")})
    m = regions.patch_medians(r, points, 4, unclipped=True)
    return m.withColumns({n: F.round(n, 9) for n in "rgb"})


def _features_sql() -> str:
    out = []
    for name, test in (("in", "i"), ("out", "NOT i")):
        n = f"count(*) FILTER ({test})"
        out.append(f"{n} AS {name}_n")
        out += [f"round(CASE WHEN {n} >= 16 THEN quantile_cont(v, {q / 100}) FILTER ({test}) ELSE 0 END, 9) AS {name}_p{q}" for q in (10, 50, 90)]
        out += [f"round(CASE WHEN {n} >= 16 THEN stddev_pop(v) FILTER ({test}) ELSE 0 END, 9) AS {name}_std", f"round(CASE WHEN {n} >= 16 THEN median(ch) FILTER ({test}) ELSE 0 END, 9) AS {name}_chroma", f"round(CASE WHEN {n} >= 16 THEN avg(CASE WHEN v < 0.030 THEN 1.0 ELSE 0 END) FILTER ({test}) ELSE 1 END, 9) AS {name}_black"]
    return f"""WITH {views.RASTER}, {views.CANDIDATES}, rc AS (SELECT frame_id, cand_pos, x // 16 AS x0, y // 8 AS y0, 6 + width // 60 AS w, 5 + height // 40 AS h FROM cd),
j AS (SELECT rs.frame_id, cand_pos, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS v, greatest(r, g, b) - least(r, g, b) AS ch, x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h AS i FROM rs JOIN rc USING (frame_id)
  WHERE x >= x0 - greatest(2, least(w, h) * 0.075) AND x < x0 + w + greatest(2, least(w, h) * 0.075) AND y >= y0 - greatest(2, least(w, h) * 0.075) AND y < y0 + h + greatest(2, least(w, h) * 0.075))
SELECT frame_id, cand_pos, {', '.join(out)} FROM j GROUP BY frame_id, cand_pos"""


@query("rectangle_features", _features_sql())
def rectangle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.candidates(spark, sf_dir)
    d = d.select("frame_id", "cand_pos", F.floor(F.col("x") / 16).alias("x0"), F.floor(F.col("y") / 8).alias("y0"), (6 + F.floor(F.col("width") / 60)).alias("width"), (5 + F.floor(F.col("height") / 40)).alias("height"))
    f = regions.rectangle_features(views.raster(spark, sf_dir), d)
    return f.select(*(F.round(n, 9).alias(n) if kind == "double" else F.col(n) for n, kind in f.dtypes))


@query(
    "highlight_risk",
    f"""WITH {views.RASTER}, z AS (SELECT frame_id, max(y) AS h, count(*) AS nn FROM rs GROUP BY frame_id), p AS (SELECT t.*, nn, y / greatest(h, 1)::DOUBLE AS down, r * 0.97 AS ar, g * 0.99 AS ag, b * 0.93 AS ab FROM {TONE} t JOIN z USING (frame_id) WHERE nn >= 128),
m AS (SELECT *, 0 AS o, 'blue_sky' AS region FROM p WHERE luma >= 0.50 AND luma <= 0.985 AND down <= 0.82 AND b >= r * 1.01 AND b >= g * 0.95 AND sat >= 0.035 AND sat <= 0.42
  UNION ALL SELECT *, 1, 'white_cloud' FROM p WHERE luma >= 0.62 AND luma <= 0.988 AND down <= 0.86 AND sat <= 0.14 AND hi <= 0.992 UNION ALL SELECT *, 2, 'overcast_cloud' FROM p WHERE luma >= 0.44 AND luma <= 0.92 AND down <= 0.88 AND sat <= 0.11 AND hi <= 0.985),
g AS (SELECT frame_id, o, region, count(*) AS n, any_value(nn) AS nn, median({LUMA601.replace('r *', 'ar *').replace('g *', 'ag *').replace('b *', 'ab *')}) - median(luma) AS ld, median(ag - (ar + ab) * 0.5) - median(g - (r + b) * 0.5) AS gd FROM m GROUP BY frame_id, o, region),
s AS (SELECT *, greatest(0, gd / CASE WHEN o = 0 THEN 0.013 ELSE 0.010 END) AS gs, greatest(0, ld / CASE WHEN o = 0 THEN -0.026 ELSE -0.030 END) AS ds FROM g WHERE n >= 96 AND n / nn::DOUBLE >= 0.008)
SELECT frame_id, region, round(ld, 9) AS luma_delta, round(gd, 9) AS green_delta, CASE WHEN gs >= 1 AND ds >= 1 THEN replace(region, '_', ' ') || ' green/dark highlight risk' WHEN gs >= 1 THEN replace(region, '_', ' ') || ' green highlight risk' WHEN ds >= 1 THEN replace(region, '_', ' ') || ' dark highlight risk' ELSE '' END AS warning
FROM s QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(greatest(gs, ds), 9) DESC, o) = 1""",
)
def highlight_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regions.highlight_risk(views.raster(spark, sf_dir), (F.col("r") * 0.97, F.col("g") * 0.99, F.col("b") * 0.93))
    return d.withColumns({n: F.round(n, 9) for n in ("luma_delta", "green_delta")})


def _lab_sql() -> str:
    row = lambda i: "(" + " + ".join(f"{n} * {regions.XYZ[i][j]!r}::DOUBLE" for j, n in enumerate("rgb")) + f") / {regions.WHITE[i]!r}::DOUBLE"
    f = lambda v: f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787::DOUBLE * {v} + 16.0::DOUBLE / 116 END"
    return f"""WITH {views.PIXELS}, v AS (SELECT frame_id, {row(0)} AS x, {row(1)} AS y, {row(2)} AS z FROM px),
l AS (SELECT frame_id, CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END AS l, 500 * (({f('x')}) - ({f('y')})) AS a, 200 * (({f('y')}) - ({f('z')})) AS b FROM v)
SELECT frame_id, round(avg(l), 6) AS l, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(sqrt(a * a + b * b)), 6) AS chroma FROM l GROUP BY frame_id"""


@query("lab_chroma", _lab_sql())
def lab_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    lightness, a, b = regions.lab(c.rgb())
    d = views.pixels(spark, sf_dir).select("frame_id", lightness.alias("l"), a.alias("a"), b.alias("b"))
    return d.groupBy("frame_id").agg(*(F.round(F.avg(n), 6).alias(n) for n in ("l", "a", "b")), F.round(F.avg(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))), 6).alias("chroma"))


@query(
    "ranker_report",
    f"""WITH {views.CANDIDATES}, t AS (SELECT frame_id, min(cand_pos) AS p FROM cd GROUP BY frame_id), q AS (SELECT c.*, r.x AS bx, r.y AS by_, r.width AS bw, r.height AS bh FROM cd c JOIN t USING (frame_id) JOIN cd r ON r.frame_id = c.frame_id AND r.cand_pos = t.p WHERE c.cand_pos <> t.p),
i AS (SELECT *, greatest(least(x + width, bx + bw) - greatest(x, bx), 0) * greatest(least(y + height, by_ + bh) - greatest(y, by_), 0) AS both_ FROM q), j AS (SELECT frame_id, cand_pos, both_ / (width * height + bw * bh - both_)::DOUBLE AS iou, width * height AS score FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, cand_pos) AS rk FROM j), g AS (SELECT frame_id, max(iou) FILTER (rk = 1) AS top1, max(iou) FILTER (rk <= 3) AS top3, max(iou) AS oracle FROM k GROUP BY frame_id)
SELECT count(*) AS groups, round(avg(oracle), 6) AS oracle_mean, {', '.join(f"round(avg({n}), 6) AS {n}_mean, round(median({n}), 6) AS {n}_median, " + ', '.join(f"round(avg(CASE WHEN {n} >= {t / 100} - 1e-12 THEN 1.0 ELSE 0 END), 6) AS {n}_ge_{t:03d}" for t in (80, 85, 90)) for n in ('top1', 'top3'))} FROM g""",
)
def ranker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored by their area, against the first of their frame."""
    from ..operators import ordered

    d = views.candidates(spark, sf_dir)
    first = ordered.first_wins(d, [], "cand_pos", ["frame_id"])
    a, b = (x.select("frame_id", "cand_pos", *(F.col(n).alias(f"{p}_{n}") for n in ("x", "y", "width", "height"))) for x, p in ((d, "a"), (first, "b")))
    j = a.join(b.withColumnRenamed("cand_pos", "first_pos"), "frame_id").filter("cand_pos != first_pos").withColumns({"iou": relate.axis_iou("a", "b"), "score": F.col("a_width") * F.col("a_height")})
    r = regions.ranked_report(j, "frame_id", "score", "iou")
    return r.select(*(F.round(n, 6).alias(n) if kind == "double" else F.col(n) for n, kind in r.dtypes))


@query(
    "small_rules",
    """WITH v AS (SELECT event_id AS id, ['JPEG (*.jpg)', 'PNG 8-bit', 'PNG 16-bit', 'TIFF 8-bit', 'Tif', 'webp'][event_id % 6 + 1] AS f, ['uint8', 'uint16', 'int16', 'int32', 'float32'][event_id % 5 + 1] AS k, (event_id % 200 - 100) / 1000.0::DOUBLE AS o FROM events)
SELECT id, CASE WHEN contains(lower(f), 'jpeg') OR contains(lower(f), 'jpg') THEN 'jpg' WHEN contains(lower(f), 'png') THEN CASE WHEN contains(lower(f), '8-bit') THEN 'png8' ELSE 'png16' END WHEN contains(lower(f), 'tif') THEN CASE WHEN contains(lower(f), '8-bit') THEN 'tiff8' ELSE 'tiff16' END END AS format,
  CASE k WHEN 'uint8' THEN 255.0 WHEN 'uint16' THEN 65535.0 WHEN 'int16' THEN 32767.0 WHEN 'int32' THEN 2147483647.0 ELSE 1.0 END::DOUBLE AS full_scale, round(least(greatest(least(greatest((o - 0.009) * (40 / 65.0::DOUBLE), -0.04), 0.04) - 0.018, -0.13), 0.13), 9) AS retargeted FROM v""",
)
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (i % len(v) + 1).cast("int"))
    d = views.table(spark, sf_dir, "events").select(i.alias("id"), pick("JPEG (*.jpg)", "PNG 8-bit", "PNG 16-bit", "TIFF 8-bit", "Tif", "webp").alias("f"), pick("uint8", "uint16", "int16", "int32", "float32").alias("k"), ((i % 200 - 100) / 1000.0).alias("o"))
    return d.select("id", regions.export_format(F.col("f")).alias("format"), regions.full_scale(F.col("k")).alias("full_scale"), F.round(regions.retargeted(F.col("o"), (0.009, 65), (-0.018, 40)), 9).alias("retargeted"))


SMALL_RECTS = "rc AS (SELECT frame_id, cand_pos, x // 16 AS x0, y // 8 AS y0, 6 + width // 60 AS w, 5 + height // 40 AS h, angle FROM cd)"
LUMA, CHROMA, OWN = "r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE", "greatest(r, g, b) - least(r, g, b)", "abs(r - b) > 0.05::DOUBLE"


def small_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates at the size of the made-up frames."""
    d = views.candidates(spark, sf_dir)
    return d.select("frame_id", "cand_pos", F.floor(F.col("x") / 16).alias("x0"), F.floor(F.col("y") / 8).alias("y0"), (6 + F.floor(F.col("width") / 60)).alias("width"), (5 + F.floor(F.col("height") / 40)).alias("height"), "angle")


def _statistics_sql() -> str:
    out = []
    for p, test in (("in", "i AND x IS NOT NULL"), ("out", "o AND NOT i AND x IS NOT NULL")):
        n = f"count(x) FILTER ({test})"
        few = lambda e, other="0", n=n: f"round(CASE WHEN {n} >= 16 THEN {e} ELSE {other} END, 6)"
        out += [f"{n} AS {p}_n", few(f"avg(v) FILTER ({test})") + f" AS {p}_mean", few(f"stddev_pop(v) FILTER ({test})") + f" AS {p}_std", few(f"stddev_pop(ch) FILTER ({test})") + f" AS {p}_chroma_std"]
        out += [few(f"avg(CASE WHEN e THEN 1.0::DOUBLE ELSE 0 END) FILTER ({test})") + f" AS {p}_edges", few(f"avg(CASE WHEN v < 0.03 THEN 1.0::DOUBLE ELSE 0 END) FILTER ({test})", "1") + f" AS {p}_black", f"round({n} / any_value(fh * fw)::DOUBLE, 6) AS {p}_valid"]
    return f"""WITH {views.RASTER}, {views.CANDIDATES}, {SMALL_RECTS}, sz AS (SELECT frame_id, max(y) + 1 AS fh, max(x) + 1 AS fw FROM rs GROUP BY frame_id),
gr AS (SELECT frame_id, y, unnest(range(fw)) AS x FROM (SELECT frame_id, fw, unnest(range(fh)) AS y FROM sz)),
lc AS (SELECT gr.frame_id, gr.y, rs.x, gr.x AS gx, {LUMA} AS v, {CHROMA} AS ch, {OWN} AS e FROM gr LEFT JOIN rs ON rs.frame_id = gr.frame_id AND rs.y = gr.y AND rs.x = gr.x),
pd AS (SELECT *, greatest(2, least(w, h) * 0.075::DOUBLE) AS p FROM rc JOIN sz USING (frame_id)),
j AS (SELECT frame_id, cand_pos, x, v, ch, e, fh, fw, gx >= x0 AND gx < x0 + w AND y >= y0 AND y < y0 + h AS i, gx >= x0 - p AND gx < x0 + w + p AND y >= y0 - p AND y < y0 + h + p AS o FROM pd JOIN lc USING (frame_id))
SELECT frame_id, cand_pos, {', '.join(out)} FROM j GROUP BY frame_id, cand_pos"""


@query("rectangle_statistics", _statistics_sql())
def rectangle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From summed-area tables: inside and around each candidate."""
    d = areas.rectangle_statistics(views.raster(spark, sf_dir), small_rectangles(spark, sf_dir), c.luma709(c.rgb()), F.greatest("r", "g", "b") - F.least("r", "g", "b"), F.abs(F.col("r") - F.col("b")) > 0.05, 2.0)
    return d.select(*(F.round(n, 6).alias(n) if kind == "double" else F.col(n) for n, kind in d.dtypes))


def _support_sql() -> str:
    corner = lambda sx, sy: (f"cx + ({sx}) * w / 2.0::DOUBLE * co - ({sy}) * h / 2.0::DOUBLE * si", f"cy + ({sx}) * w / 2.0::DOUBLE * si + ({sy}) * h / 2.0::DOUBLE * co")
    at = [corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)]
    sides = " UNION ALL ".join(f"SELECT frame_id, cand_pos, '{n}' AS side, {at[i][0]} AS ax, {at[i][1]} AS ay, {at[(i + 1) % 4][0]} AS bx, {at[(i + 1) % 4][1]} AS bt FROM tr" for i, n in enumerate(("top", "right", "bottom", "left")))
    share = lambda s: f"coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) FILTER (side = '{s}' AND inside) / nullif(count(*) FILTER (side = '{s}' AND inside), 0)::DOUBLE, 0)"
    return f"""WITH {views.RASTER}, {views.CANDIDATES}, {SMALL_RECTS}, sz AS (SELECT frame_id, max(y) + 1 AS fh, max(x) + 1 AS fw FROM rs GROUP BY frame_id),
tr AS (SELECT *, x0 + w / 2.0::DOUBLE AS cx, y0 + h / 2.0::DOUBLE AS cy, cos(angle * (pi() / 180)) AS co, sin(angle * (pi() / 180)) AS si FROM rc),
sd AS ({sides}),
st AS (SELECT *, greatest(8, CAST(floor(sqrt((bx - ax) * (bx - ax) + (bt - ay) * (bt - ay)) / 5) AS INTEGER)) AS n FROM sd),
sp AS (SELECT *, k / (n - 1)::DOUBLE AS t FROM (SELECT *, unnest(range(n)) AS k FROM st)),
pt AS (SELECT frame_id, cand_pos, side, CAST(round_even(ax * (1 - t) + bx * t, 0) AS INTEGER) AS x, CAST(round_even(ay * (1 - t) + bt * t, 0) AS INTEGER) AS y FROM sp),
h AS (SELECT pt.*, pt.x >= 0 AND pt.x < fw AND pt.y >= 0 AND pt.y < fh AS inside, coalesce({OWN.replace('r -', 'rs.r -').replace('b)', 'rs.b)')}, false) AS hit FROM pt JOIN sz USING (frame_id) LEFT JOIN rs ON rs.frame_id = pt.frame_id AND rs.x = pt.x AND rs.y = pt.y),
a AS (SELECT frame_id, cand_pos, {', '.join(f'{share(s)} AS {s}_' for s in ('top', 'right', 'bottom', 'left'))} FROM h GROUP BY frame_id, cand_pos)
SELECT frame_id, cand_pos, {', '.join(f'round({s}_, 6) AS {s}' for s in ('top', 'right', 'bottom', 'left'))}, round((top_ + right_ + bottom_ + left_) / 4, 6) AS support FROM a"""


@query("side_support", _support_sql())
def side_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each side of a turned candidate lies on cells of a colour of their own."""
    r = views.raster(spark, sf_dir)
    edges = r.filter(F.abs(F.col("r") - F.col("b")) > 0.05)
    rects = small_rectangles(spark, sf_dir).withColumnsRenamed({"x0": "x", "y0": "y"})
    d = areas.side_support(edges, tiles.sizes(r), rects)
    return d.select(*(F.round(n, 6).alias(n) if kind == "double" else F.col(n) for n, kind in d.dtypes))
