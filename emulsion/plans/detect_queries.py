"""Queries of film base, frame rectangles and their prefilter, with the lists they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, grids, ordered, regions, relate
from . import views
from .registry import query
from .region_queries import _features_sql

UNIT = lambda e: f"least(greatest({e}, 0), 1)"


def _points_sql() -> str:
    edge = []
    for i, share in enumerate(detect.EDGE_SHARES):
        x, y = f"CAST(round_even(w * {share}::DOUBLE, 0) AS INTEGER)", f"CAST(round_even(h * {share}::DOUBLE, 0) AS INTEGER)"
        for j, (name, px, py) in enumerate((("edge-top", x, "o"), ("edge-bottom", x, "h - o - 1"), ("edge-left", "o", y), ("edge-right", "w - o - 1", y))):
            edge.append(f"SELECT frame_id, {i * 4 + j} AS pos, '{name}' AS source, {px} AS px, {py} AS py, rad, 1 AS kind FROM sz")
    side = []
    for i, (name, ax, ay, bx, by, dx, dy) in enumerate((("top", 9, 8, 15, 8, 0, -8), ("right", 15, 8, 15, 14, 8, 0), ("bottom", 15, 14, 9, 14, 0, 8), ("left", 9, 14, 9, 8, -8, 0))):
        for j, s in enumerate(detect.FRAME_SHARES):
            side.append(f"SELECT frame_id, {i * 5 + j} AS pos, '{name}' AS source, {round(ax * (1 - s) + bx * s + dx)} AS px, {round(ay * (1 - s) + by * s + dy)} AS py, 4 AS rad, 0 AS kind FROM sz WHERE frame_id % 2 = 0")
    return " UNION ALL ".join(edge + side)


BASES = f"""{views.RASTER}, sz AS (SELECT frame_id, w, h, CAST(floor(least(greatest(least(w, h) * 0.045::DOUBLE, 5), least(w, h) // 2)) AS INTEGER) AS o, CAST(floor(least(greatest(least(w, h) * 0.022::DOUBLE, 4), 42)) AS INTEGER) AS rad
  FROM (SELECT frame_id, CAST(max(x) + 1 AS INTEGER) AS w, CAST(max(y) + 1 AS INTEGER) AS h FROM rs GROUP BY frame_id)),
pn AS ({_points_sql()}),
pj AS (SELECT pn.*, {', '.join(UNIT(n) + ' AS ' + n for n in 'rgb')}, x = px AND y = py AS own FROM pn JOIN rs USING (frame_id) WHERE abs(x - px) <= rad AND abs(y - py) <= rad),
pv AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS v, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pj),
pa AS (SELECT frame_id, kind, pos, source, px, py, median(r) AS r, median(g) AS g, median(b) AS b, avg(v) AS mean, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS spread,
  ({' + '.join(f'quantile_cont({n}, 0.9) - quantile_cont({n}, 0.1)' for n in 'rgb')}) / 3.0::DOUBLE AS channels, avg(CASE WHEN hi >= 0.995 THEN 1.0::DOUBLE ELSE 0 END) AS clipped, avg(hi - lo) AS colour FROM pv GROUP BY ALL HAVING count(*) FILTER (own) > 0),
pc AS (SELECT *, {UNIT(UNIT('1 - (spread + channels) / 0.28') + ' * 0.44 + ' + UNIT('(mean - 0.02) / 0.55') + ' * 0.24 + ' + UNIT('1 - clipped * 12') + ' * 0.22 + ' + UNIT('1 - colour / 0.55') + ' * 0.10')} AS confidence FROM pa),
ps AS (SELECT *, confidence * 100 + mean * 12 - spread * 35 - clipped * 30 AS score FROM pc WHERE mean >= 0.025 AND confidence >= 0.22)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside a rectangle for every other frame, and near the edges for all."""
    r = views.raster(spark, sf_dir)
    size = r.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    rect = size.filter("frame_id % 2 = 0").select("frame_id", *(F.lit(v).alias(n) for n, v in (("x", 9), ("y", 8), ("width", 6), ("height", 6), ("angle", 0.0))))
    points = detect.frame_points(rect).withColumn("kind", F.lit(0)).unionByName(detect.edge_points(size).withColumn("kind", F.lit(1)))
    return detect.base_patches(r, points)


@query("base_patches", f"WITH {BASES} SELECT frame_id, kind, pos, source, px, py, round(r, 9) AS r, round(confidence, 9) AS confidence, round(score, 7) AS score FROM ps")
def base_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = patches(spark, sf_dir)
    return d.select("frame_id", "kind", "pos", "source", "px", "py", F.round("r", 9).alias("r"), F.round("confidence", 9).alias("confidence"), F.round("score", 7).alias("score"))


@query(
    "film_base",
    f"""WITH {BASES}, pk AS (SELECT * FROM ps QUALIFY kind = min(kind) OVER (PARTITION BY frame_id)),
pr AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(score, 9) DESC, pos) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM pk),
fb AS (SELECT frame_id, max(px) FILTER (k = 1) AS px, max(py) FILTER (k = 1) AS py, max(source) FILTER (k = 1) AS source, median(r) AS r, median(g) AS g, median(b) AS b,
  least(greatest(avg(confidence) * 0.72 + {UNIT('1 - (' + ' + '.join(f'quantile_cont({n}, 0.9) - quantile_cont({n}, 0.1)' for n in 'rgb') + ') / 3.0::DOUBLE / 0.16')} * 0.20 + {UNIT('count(*) / 6.0::DOUBLE')} * 0.08, 0), 0.98) AS c FROM pr WHERE k <= least(7, greatest(3, n // 4)) GROUP BY frame_id)
SELECT frame_id, px, py, source, round(r, 9) AS r, round(g, 9) AS g, round(b, 9) AS b, round_even(c, 3) AS confidence, CASE WHEN c >= 0.68 THEN 'high' ELSE 'medium' END AS level FROM fb WHERE c >= 0.45""",
)
def film_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the patches outside the frame's rectangle; where it has none, from those near the edges."""
    d = patches(spark, sf_dir)
    d = d.withColumn("_kind", F.min("kind").over(ordered.Window.partitionBy("frame_id"))).filter("kind = _kind")
    return detect.film_base(d).withColumns({n: F.round(n, 9) for n in "rgb"})


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the features of the prefilter: inside and ring from the pixels, edges made up."""
    d = views.candidates(spark, sf_dir)
    small = d.select("frame_id", "cand_pos", F.floor(F.col("x") / 16).alias("x0"), F.floor(F.col("y") / 8).alias("y0"), (6 + F.floor(F.col("width") / 60)).alias("width"), (5 + F.floor(F.col("height") / 40)).alias("height"))
    f = regions.rectangle_features(views.raster(spark, sf_dir), small)
    f = f.select(*(F.round(n, 9).alias(n) if kind == "double" else F.col(n) for n, kind in f.dtypes))  # as the query of that name gives them
    c = d.select(
        "cand_pos", ((F.col("x") + F.col("width") / 2.0) / 640.0).alias("cx"), ((F.col("y") + F.col("height") / 2.0) / 480.0).alias("cy"), (F.col("width") * F.col("height") / 307200.0).alias("area"), (F.abs("angle") / 90.0).alias("angle_abs"),
        F.least(F.lit(1.0), F.least("x", "y") / 19.2).alias("border"), relate.aspect_score(F.col("width") / F.col("height"), F.lit(1.5)).alias("format_score"), (F.col("cand_pos") % 11 / 22.0).alias("edge_support"),
    )
    return f.join(c, "cand_pos").select(
        "frame_id", *c.columns, (F.col("in_p90") - F.col("in_p10")).alias("inside_range"), F.col("in_std").alias("inside_std"), F.col("in_p50").alias("inside_luma"), F.col("out_p50").alias("outside_luma"), F.col("out_std").alias("outside_std"),
        F.col("out_black").alias("outside_black"), (F.col("out_n") / 600.0).alias("outside_valid"),
    )


def _prefilter_sql(transition: bool) -> str:
    u = UNIT
    around = f"greatest(ring * 0.62 + ({u('(ol - il + 0.015) / 0.24')} * 0.58 + {u('es / 0.32')} * 0.22 + content * 0.20) * 0.38, tight * 0.82)" if transition else "greatest(ring, tight)"
    return f"""WITH ft AS ({_features_sql()}), {views.CANDIDATES.replace('cd AS', 'cn AS')}, jf AS (SELECT ft.frame_id, cand_pos, (x + width / 2.0::DOUBLE) / 640 AS cx, (y + height / 2.0::DOUBLE) / 480 AS cy, width * height / 307200.0::DOUBLE AS area, abs(angle) / 90 AS aa,
  least(1, least(x, y) / 19.2::DOUBLE) AS bo, 1 - {u('abs(ln(width / height::DOUBLE) - ln(1.5::DOUBLE)) / 0.42')} AS fs, cand_pos % 11 / 22.0::DOUBLE AS es, in_p90 - in_p10 AS ir, in_std AS isd, in_p50 AS il, out_p50 AS ol, out_std AS os, out_black AS ob, out_n / 600.0::DOUBLE AS ov FROM ft JOIN cn USING (cand_pos)),
pp AS (SELECT *, {u('ir / 0.34')} * 0.55 + {u('isd / 0.18')} * 0.45 AS content, {u('(ol - 0.035) / 0.18')} * 0.32 + {u('1 - os / 0.20')} * 0.23 + ov * 0.15 + {u('1 - ob * 1.2')} * 0.10 + es * 0.20 AS ring,
  fs * 0.36 + {u('1 - abs(area - 0.66) / 0.46')} * 0.24 + bo * 0.12 + {u('1 - (abs(cx - 0.5) * 2 + abs(cy - 0.5) * 2) / 1.35')} * 0.18 + {u('1 - aa / 0.95')} * 0.10 AS shape, {u('(area - 0.84) / 0.12')} * {u('(0.10 - bo) / 0.10')} AS touches FROM jf),
pt AS (SELECT *, {u('ob * 1.45')} * 0.24 + es * 0.26 + content * 0.25 + bo * 0.10 + fs * 0.15 AS tight FROM pp),
sc AS (SELECT frame_id, cand_pos, round({around} * 0.46 + shape * 0.34 + content * 0.20 - touches * 0.18 - {u('(0.20 - content) / 0.20')} * 0.12, 6) AS score FROM pt)
SELECT frame_id, cand_pos, score FROM sc QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, cand_pos DESC) <= 8"""


def _prefiltered(spark: SparkSession, sf_dir: str, transition: bool) -> DataFrame:
    d = detect.prefilter_score(featured(spark, sf_dir), transition).select("frame_id", "cand_pos", F.round("score", 6).alias("score"))
    return detect.best_placed(d, 8).select("frame_id", "cand_pos", "score")


@query("prefiltered_rectangles", _prefilter_sql(True))
def prefiltered_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefiltered(spark, sf_dir, True)


@query("training_rectangles", _prefilter_sql(False))
def training_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefiltered(spark, sf_dir, False)


@query(
    "inner_frames",
    f"""WITH {views.CANDIDATES}, e AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cand_pos * 31 % 60 DESC, cand_pos) - 1 AS p, cand_pos * 31 % 60 + 10 AS s FROM cd QUALIFY p < 4),
j AS (SELECT l.frame_id, l.p AS lp, r.p AS rp, t.p AS tp, d.p AS dp, l.x AS le, t.y AS tt, r.x + r.width - l.x + 1 AS w, d.y + d.height - t.y + 1 AS h, (l.s + r.s + t.s + d.s) / 4.0::DOUBLE AS s FROM e l JOIN e r USING (frame_id) JOIN e t USING (frame_id) JOIN e d USING (frame_id)),
k AS (SELECT *, w * h / 307200.0::DOUBLE AS area, {UNIT('least(le, tt, 640 - le - w, 480 - tt - h) / 12.0::DOUBLE')} AS clear, {UNIT('1 - (abs((le + w / 2.0::DOUBLE) / 640 - 0.5) * 2 + abs((tt + h / 2.0::DOUBLE) / 480 - 0.5) * 2) / 1.35')} AS centre,
  [{', '.join('round(1 - ' + UNIT(f'abs(ln(greatest(w / h::DOUBLE, 0.05)) - ln({r!r}::DOUBLE)) / 0.42') + ', 12)' for _, r in detect.INNER_FORMATS)}] AS fits FROM j WHERE w >= 179 AND h >= 134),
c AS (SELECT *, list_max(fits) AS fit, least(greatest({UNIT('s / 38')} * 0.28 + 0.1 * 0.20 + list_max(fits) * 0.22 + clear * 0.10 + (1 - {UNIT('abs(area - 0.38) / 0.38')}) * 0.12 + centre * 0.08, 0), 0.98) AS c FROM k WHERE area BETWEEN 0.10 AND 0.70 AND least(w, h) >= 76.8 AND NOT (clear < 0.12 AND area > 0.62))
SELECT frame_id, CAST(le AS INTEGER) AS x, CAST(tt AS INTEGER) AS y, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, round(c, 6) AS confidence, CASE WHEN fit > 0 THEN ['135', '645', '66', '67', '69'][list_position(fits, fit)] ELSE 'auto' END AS format, CASE WHEN c >= 0.72 THEN 'high' ELSE 'medium' END AS level
FROM c WHERE c >= 0.68 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(c, 9) DESC, lp, rp, tp, dp) = 1""",
)
def inner_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four edges a side: the strongest of a frame's candidates."""
    d = views.candidates(spark, sf_dir).withColumn("strength", (F.col("cand_pos") * 31 % 60 + 10).cast("double"))
    d = d.withColumn("pos", F.row_number().over(ordered.Window.partitionBy("frame_id").orderBy(F.desc("strength"), "cand_pos")) - 1).filter("pos < 4")
    sides = (("left", F.col("x")), ("right", F.col("x") + F.col("width")), ("top", F.col("y")), ("bottom", F.col("y") + F.col("height")))
    e = d.select("frame_id", "pos", "strength", F.inline(F.array(*(F.struct(F.lit(n).alias("side"), v.alias("at")) for n, v in sides))))
    out = detect.inner_frame(e, 640, 480, F.lit(0.1))
    return out.select("frame_id", *(F.col(n).cast("int").alias(n) for n in ("x", "y", "width", "height")), F.round("confidence", 6).alias("confidence"), "format", "level")


@query(
    "distinct_angles",
    f"""WITH RECURSIVE {views.CANDIDATES}, a AS (SELECT frame_id, list(CASE WHEN v = 0 THEN 45.0 ELSE v - 45 END ORDER BY cand_pos) AS vs FROM (SELECT frame_id, cand_pos, ((angle + 45) % 90 + 90) % 90 AS v FROM cd) GROUP BY frame_id),
f AS (SELECT frame_id, vs, 1 AS i, []::DOUBLE[] AS kept FROM a UNION ALL SELECT frame_id, vs, i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k - vs[i]) < 2.0)) > 0 THEN kept ELSE list_append(kept, vs[i]) END FROM f WHERE i <= len(vs))
SELECT frame_id, unnest(kept) AS angle FROM f WHERE i > len(vs)""",
)
def distinct_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each frame's candidates, the angles that are two degrees or more apart."""
    d = views.candidates(spark, sf_dir).withColumn("angle", relate.normal_angle(F.col("angle")))
    return detect.epsilon_distinct(d, ["frame_id"], "angle", "cand_pos", 2.0)


GRID_W, GRID_H = 640, 480
NORMAL = lambda a: f"(CASE WHEN ({a} + 45) - 90 * floor(({a} + 45) / 90) = 0 THEN 45 ELSE ({a} + 45) - 90 * floor(({a} + 45) / 90) - 45 END)"
INSIDE = lambda x, w, m: f"greatest(0, least({x}, {m} - {w}))"

GRID_SQL = f"""WITH RECURSIVE {views.CANDIDATES}, gs AS (SELECT frame_id, x, y, width, height, angle FROM cd QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY cand_pos) = 1),
g0 AS (SELECT frame_id, least(width, {GRID_W}) AS w0, least(height, {GRID_H}) AS h0, x, y, angle FROM gs),
gb AS (SELECT frame_id, {INSIDE('x', 'w0', GRID_W)} AS x0, {INSIDE('y', 'h0', GRID_H)} AS y0, w0, h0, [{NORMAL('angle')}, 0.0::DOUBLE, {NORMAL('(angle - 1.2::DOUBLE)')}, {NORMAL('(angle + 1.2::DOUBLE)')}] AS ts FROM g0),
tk AS (SELECT frame_id, ts, 1 AS i, []::DOUBLE[] AS kept FROM gb UNION ALL SELECT frame_id, ts, i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k - ts[i]) < 0.35)) > 0 THEN kept ELSE list_append(kept, ts[i]) END FROM tk WHERE i <= 4),
an AS (SELECT frame_id, unnest(kept) AS angle, unnest(range(len(kept))) AS k FROM tk WHERE i > 4),
sh AS (SELECT i, a, b FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(grids.SHIFTS))}) t(i, a, b)), sl AS (SELECT j, s FROM (VALUES {', '.join(f'({j}, {x}::DOUBLE)' for j, x in enumerate(grids.SCALES))}) t(j, s)),
rw AS (SELECT gb.*, i, j, a, b, least(greatest(12, CAST(round_even(w0 * s, 0) AS INTEGER)), {GRID_W}) AS w, least(greatest(12, CAST(round_even(h0 * s, 0) AS INTEGER)), {GRID_H}) AS h, greatest(12, CAST(round_even(w0 * s, 0) AS INTEGER)) AS uw, greatest(12, CAST(round_even(h0 * s, 0) AS INTEGER)) AS uh,
  greatest(1, CAST(round_even(w0 * 0.018::DOUBLE, 0) AS INTEGER)) AS dx, greatest(1, CAST(round_even(h0 * 0.018::DOUBLE, 0) AS INTEGER)) AS dy FROM gb CROSS JOIN sh CROSS JOIN sl),
rp AS (SELECT frame_id, i, j, w, h, {INSIDE("CAST(round_even(x0 + w0 / 2.0::DOUBLE + a * dx - uw * 0.5::DOUBLE, 0) AS INTEGER)", 'w', GRID_W)} AS x, {INSIDE("CAST(round_even(y0 + h0 / 2.0::DOUBLE + b * dy - uh * 0.5::DOUBLE, 0) AS INTEGER)", 'h', GRID_H)} AS y FROM rw),
ra AS (SELECT rp.*, angle, k FROM rp JOIN an USING (frame_id) QUALIFY row_number() OVER (PARTITION BY frame_id, x, y, w, h, round_even(angle * 10, 0) ORDER BY i, j, k) = 1)
SELECT frame_id, x, y, w AS width, h AS height, round(angle, 6) AS angle, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY i, j, k) AS INTEGER) AS place FROM ra QUALIFY place <= 120"""


@query("prior_grid", GRID_SQL)
def prior_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles around the first candidate of each frame."""
    guess = ordered.first_wins(views.candidates(spark, sf_dir), [], "cand_pos", ["frame_id"])
    return grids.prior_grid(guess, GRID_W, GRID_H, 120).withColumn("angle", F.round("angle", 6))


def _corners_sql() -> str:
    sides = (("x", "y"), ("x + width", "y"), ("x", "y + height"), ("x + width", "y + height"))
    corner = " UNION ALL ".join(f"SELECT frame_id, cand_pos * 4 + {i} AS pos, {x} AS x, {y} AS y, 0.3::DOUBLE + cand_pos * 31 % 60 / 100.0::DOUBLE AS score, cand_pos % 3 > 0 AS bright FROM cd" for i, (x, y) in enumerate(sides))
    fits = lambda asp, rat: f"(1 - least(greatest(abs(ln(greatest({asp}, 0.05)) - ln({rat})) / 0.42::DOUBLE, 0), 1))"
    prior = f"(1 - least(greatest((abs((x + width / 2.0::DOUBLE) / {GRID_W} - 0.5) * 2 + abs((y + height / 2.0::DOUBLE) / {GRID_H} - 0.5) * 2) / 1.45::DOUBLE, 0), 1))"
    ratios = ", ".join(f"{r!r}::DOUBLE" for r in grids.RATIOS)
    fit = lambda c: f"greatest(1, least({c}, %d))"
    near = lambda c: f"CAST(round_even({c}, 0) AS INTEGER)"
    return f"""WITH {views.CANDIDATES}, co AS ({corner}),
qd AS (SELECT *, CASE WHEN y < 240 THEN 't' WHEN y > 240 THEN 'b' END || CASE WHEN x < 320 THEN 'l' WHEN x > 320 THEN 'r' END AS q FROM co),
bc AS (SELECT * FROM qd WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_id, q ORDER BY bright DESC, score DESC, pos) <= 5),
pr AS (SELECT a.frame_id, k.kind, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bt, a.score + b.score AS cs FROM bc a JOIN bc b USING (frame_id) JOIN (VALUES ('falling', 'tl', 'br'), ('rising', 'tr', 'bl'), ('top', 'tl', 'tr'), ('bottom', 'bl', 'br'), ('left', 'tl', 'bl'), ('right', 'tr', 'br')) k(kind, qa, qb) ON a.q = qa AND b.q = qb),
ob AS (SELECT frame_id, kind, cs, least(ax, bx) AS l, least(ay, bt) AS t, abs(ax - bx) AS bw, abs(ay - bt) AS bh FROM pr WHERE kind IN ('falling', 'rising')),
of_ AS (SELECT *, unnest([{ratios}]) AS ratio FROM ob WHERE bw >= {GRID_W} * 0.24 AND bh >= {GRID_H} * 0.24 AND bw * bh / {GRID_W * GRID_H}::DOUBLE BETWEEN 0.10 AND 0.94),
og AS (SELECT *, CASE WHEN bw / bh::DOUBLE >= ratio THEN bh * ratio ELSE bw END AS fw, CASE WHEN bw / bh::DOUBLE >= ratio THEN bh ELSE bw / ratio END AS fh FROM of_),
oh AS (SELECT *, {fit(f"greatest(12, {near('fw')})") % GRID_W} AS width, {fit(f"greatest(12, {near('fh')})") % GRID_H} AS height, {near('(l * 2 + bw) * 0.5::DOUBLE - fw * 0.5::DOUBLE')} AS ux, {near('(t * 2 + bh) * 0.5::DOUBLE - fh * 0.5::DOUBLE')} AS uy FROM og),
oi AS (SELECT *, {INSIDE('ux', 'width', GRID_W)} AS x, {INSIDE('uy', 'height', GRID_H)} AS y FROM oh),
os AS (SELECT frame_id, kind, x, y, width, height, cs * 0.38::DOUBLE + {fits('bw / bh::DOUBLE', 'ratio')} * 0.25::DOUBLE + width * height / (bw * bh)::DOUBLE * 0.22::DOUBLE + {prior} * 0.15::DOUBLE AS score FROM oi),
ea AS (SELECT frame_id, kind, cs, kind IN ('top', 'bottom') AS f, CASE WHEN f THEN ax ELSE ay END AS a1, CASE WHEN f THEN bx ELSE bt END AS b1, CASE WHEN f THEN ay ELSE ax END AS a2, CASE WHEN f THEN bt ELSE bx END AS b2 FROM pr WHERE kind NOT IN ('falling', 'rising')),
eb AS (SELECT *, least(a1, b1) AS st, abs(a1 - b1) AS span, {near('(a2 + b2) * 0.5::DOUBLE')} AS at_, unnest([{ratios}]) AS ratio FROM ea WHERE abs(a1 - b1) >= CASE WHEN f THEN {GRID_W} * 0.24 ELSE {GRID_H} * 0.24 END),
ec AS (SELECT *, CASE WHEN f THEN span / ratio ELSE span * ratio END AS deep FROM eb),
ed AS (SELECT *, CASE WHEN kind IN ('top', 'left') THEN at_ ELSE at_ - deep END AS fr FROM ec),
ee AS (SELECT *, CASE WHEN f THEN st ELSE {near('fr')} END AS ux, CASE WHEN f THEN {near('fr')} ELSE st END AS uy, {fit(f"CASE WHEN f THEN span ELSE {near('deep')} END") % GRID_W} AS width, {fit(f"CASE WHEN f THEN {near('deep')} ELSE span END") % GRID_H} AS height FROM ed WHERE fr <= CASE WHEN f THEN 240 ELSE 320 END AND fr + deep >= CASE WHEN f THEN 240 ELSE 320 END),
ef AS (SELECT *, {INSIDE('ux', 'width', GRID_W)} AS x, {INSIDE('uy', 'height', GRID_H)} AS y FROM ee),
es AS (SELECT frame_id, kind, x, y, width, height, cs * 0.42::DOUBLE + {fits('width / greatest(height, 1)::DOUBLE', 'ratio')} * 0.25::DOUBLE + {prior} * 0.18::DOUBLE + least(1, greatest(0, least(x, y, {GRID_W} - x - width, {GRID_H} - y - height) / {max(grids.CLEAR_LEAST, GRID_H * grids.CLEAR_SHARE)}::DOUBLE)) * 0.15::DOUBLE AS score FROM ef),
al AS (SELECT frame_id, kind, x, y, width, height, round(score, 6) AS score FROM os UNION ALL SELECT frame_id, kind, x, y, width, height, round(score, 6) FROM es)
SELECT frame_id, kind, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, max(score) AS score, count(*) AS n FROM al GROUP BY frame_id, kind, x, y, width, height"""


@query("corner_rectangles", _corners_sql())
def corner_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rectangles between the best corners of each frame; the candidates' own corners stand for found ones."""
    d = views.candidates(spark, sf_dir)
    sides = (("x", "y"), ("x + width", "y"), ("x", "y + height"), ("x + width", "y + height"))
    points = F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.expr(x).alias("px"), F.expr(y).alias("py")) for i, (x, y) in enumerate(sides))))
    c = d.select("frame_id", "cand_pos", points).select(
        "frame_id", (F.col("cand_pos") * 4 + F.col("i")).alias("pos"), F.col("px").alias("x"), F.col("py").alias("y"), (0.3 + F.col("cand_pos") * 31 % 60 / 100.0).alias("score"), (F.col("cand_pos") % 3 > 0).alias("bright")
    )
    r = grids.corner_rectangles(c, GRID_W, GRID_H)
    return r.withColumn("score", F.round("score", 6)).groupBy("frame_id", "kind", "x", "y", "width", "height").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
