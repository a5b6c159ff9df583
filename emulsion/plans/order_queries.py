"""Queries of ordered operators: medians by weight, moving sums, bins, boundaries, best rows, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import color as c
from ..operators import ordered, relate
from . import roll, views
from .registry import query

LOGS = views.GAINS + ", gu AS (SELECT key, pos, w, " + ", ".join(f"least(greatest({n}, 0.05), 20) AS {n}" for n in "rgb") + " FROM gn), gl AS (SELECT key, pos, w, " + ", ".join(f"ln({n} / (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)) AS {n}" for n in "rgb") + " FROM gu)"


def log_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.gains(spark, sf_dir)
    return g.select("key", "pos", "w", *(F.ln(x).alias(n) for n, x in zip("rgb", c.unit_luma_gains(c.rgb()), strict=True)))


@query("unit_luma_gains", f"WITH {LOGS} SELECT key, pos, " + ", ".join(f"round(exp({n}), 6) AS {n}" for n in "rgb") + " FROM gl")
def unit_luma_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.gains(spark, sf_dir)
    return g.select("key", "pos", *(F.round(x, 6).alias(n) for n, x in zip("rgb", c.unit_luma_gains(c.rgb()), strict=True)))


def _wm_sql(n: str) -> str:
    return f"(SELECT key, min({n}) AS {n} FROM (SELECT key, {n}, sum(w) OVER (PARTITION BY key ORDER BY {n} RANGE UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY key) AS total FROM gl) WHERE upto >= total * 0.5 GROUP BY key)"


@query("weighted_median_gains", f"WITH {LOGS} SELECT key, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM {_wm_sql('r')} JOIN {_wm_sql('g')} USING (key) JOIN {_wm_sql('b')} USING (key)")
def weighted_median_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ordered.weighted_median(log_gains(spark, sf_dir), ["key"], ["r", "g", "b"], "w")
    return m.select("key", *(F.round(n, 6).alias(n) for n in "rgb"))


@query(
    "gain_cluster",
    f"""WITH {LOGS}, nr AS (SELECT a.key, a.pos AS a_pos, b.pos, b.w, sqrt((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) AS d FROM gl a JOIN gl b ON a.key = b.key),
sc AS (SELECT key, a_pos, round(sum(w), 12) AS w, count(*) AS n, round(sum(d * w) / sum(w), 12) AS sp FROM nr WHERE d <= 0.20 GROUP BY key, a_pos HAVING count(*) >= 2),
bs AS (SELECT key, a_pos, n FROM sc QUALIFY row_number() OVER (PARTITION BY key ORDER BY w DESC, n DESC, sp, a_pos) = 1),
tt AS (SELECT key, count(*) AS t FROM gl GROUP BY key)
SELECT gl.key, gl.pos, CASE WHEN t > 2 AND n IS NOT NULL AND n >= greatest(2, ceil(t * 0.25)) THEN d <= 0.20 ELSE true END AS in_cluster
FROM gl JOIN tt USING (key) LEFT JOIN bs USING (key) LEFT JOIN nr ON nr.key = gl.key AND nr.a_pos = bs.a_pos AND nr.pos = gl.pos""",
)
def gain_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.gain_cluster(log_gains(spark, sf_dir), ["key"], "pos", ["r", "g", "b"], "w").select("key", "pos", "in_cluster")


ACTIONS = ("roll", "roll+frame", "frame-only", "none", "review")


@query(
    "plan_gains",
    f"WITH {LOGS}, k AS (SELECT *, CASE pos % 5 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.45 WHEN 2 THEN 0.45 ELSE 0 END AS k FROM gl), x AS (SELECT key, pos, k, " + ", ".join(f"exp({n} * k) AS {n}" for n in "rgb") + " FROM k) SELECT key, pos, ['roll', 'roll+frame', 'frame-only', 'none', 'review'][pos % 5 + 1] AS action, " + ", ".join(f"round({n} / (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE), 6) AS {n}" for n in "rgb") + " FROM x",
)
def plan_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gains that a roll's plan applies, for each of its five actions, the roll at three tenths of its strength."""
    g = views.gains(spark, sf_dir)
    action = F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), (F.col("pos") % 5 + 1).cast("int"))
    plans = g.select("key", "pos", action.alias("color_action"), *(F.col(n).alias(f"safe_{n}") for n in "rgb"))
    return plans.select("key", "pos", F.col("color_action").alias("action"), *(F.round(x, 6).alias(n) for n, x in zip("rgb", roll.combined_gains(0.3), strict=True)))


@query("combined_gains", f"WITH {LOGS}, x AS (SELECT key, pos, " + ", ".join(f"exp({n} + least(greatest(0.1 * {n}, -0.14), 0.14) * 0.45) AS {n}" for n in "rgb") + " FROM gl) SELECT key, pos, " + ", ".join(f"round({n} / (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE), 6) AS {n}" for n in "rgb") + " FROM x")
def combined_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base with a limited residual on top, here a tenth of the base itself."""
    g = log_gains(spark, sf_dir)
    p = c.unit_luma_gains(c.RGB(*(F.exp(F.col(n) + c.clip(F.col(n) * 0.1, -0.14, 0.14) * 0.45) for n in "rgb")))
    return g.select("key", "pos", *(F.round(x, 6).alias(n) for n, x in zip("rgb", p, strict=True)))


@query("moving_sum", f"WITH {views.PROFILE} SELECT key, i, round(sum(v) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) / 17, 6) AS smooth FROM pf")
def moving_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.profile(spark, sf_dir)
    return p.select("key", "i", F.round(ordered.moving_sum(p, ["key"], "i", "v", 17), 6).alias("smooth"))


@query(
    "block_contrast",
    f"""WITH {views.PROFILE}, m AS (SELECT key, i, avg(v) OVER a AS a, avg(v) OVER b AS b, count(v) OVER a AS na, count(v) OVER b AS nb FROM pf
  WINDOW b AS (PARTITION BY key ORDER BY i ROWS BETWEEN 15 PRECEDING AND 6 PRECEDING), a AS (PARTITION BY key ORDER BY i ROWS BETWEEN 5 FOLLOWING AND 14 FOLLOWING))
SELECT key, i, CASE WHEN na = 10 AND nb = 10 THEN round(greatest(0, b - a) * 0.78 + abs(a - b) * 0.22, 6) END AS score FROM m""",
)
def block_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.profile(spark, sf_dir)
    return p.select("key", "i", F.round(ordered.block_contrast(["key"], "i", "v", 5), 6).alias("score"))


@query("running_max", f"WITH {views.PROFILE} SELECT key, i, max(v) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) AS top FROM pf")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.profile(spark, sf_dir).select("key", "i", ordered.running_max(["key"], "i", "v").alias("top"))


@query(
    "centre_boundary",
    f"""WITH {views.PROFILE}, cn AS (SELECT pf.*, n, fl, n // 2 AS centre, greatest(2, round_even(n * 0.018, 0)) AS mg, greatest(6, round_even(n * 0.10, 0)) AS ap FROM pf JOIN (SELECT key, count(*) AS n, quantile_cont(v, 0.72) AS fl FROM pf GROUP BY key) USING (key)),
p AS (SELECT key, 'left' AS side, i, v, n, fl FROM cn WHERE i >= mg AND i < greatest(mg, centre - ap) UNION ALL SELECT key, 'right', i, v, n, fl FROM cn WHERE i >= least(n - mg, centre + ap) AND i < n - mg),
f AS (SELECT key, side, i, v, n, fl FROM p QUALIFY row_number() OVER (PARTITION BY key, side ORDER BY v DESC, i) = 1)
SELECT key, side, CASE WHEN n >= 32 AND v >= greatest(fl * 1.12, fl + 1) THEN i END AS place, CASE WHEN n >= 32 AND v >= greatest(fl * 1.12, fl + 1) THEN round(v, 6) END AS score FROM f""",
)
def centre_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.profile(spark, sf_dir)
    p = p.join(p.groupBy("key").agg(F.floor(F.count(F.lit(1)) / 2).alias("centre")), "key")
    out = [ordered.centre_boundary(p, ["key"], "i", "v", "centre", side).select("key", F.lit(side).alias("side"), "place", F.round("score", 6).alias("score")) for side in ("left", "right")]
    return out[0].unionByName(out[1])


DENSITY = " + ".join(f"greatest(-log10(least(greatest({n}, 1e-6), 1)), 0) * {w}::DOUBLE" for n, w in zip("rgb", (0.2126, 0.7152, 0.0722), strict=True))


@query(
    "tone_curve",
    f"""WITH {views.PIXELS}, dn AS (SELECT frame_id, {DENSITY} AS x, 1.0 - (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) AS y FROM px),
v AS (SELECT *, count(*) OVER (PARTITION BY frame_id) AS n, row_number() OVER (PARTITION BY frame_id ORDER BY x, y) - 1 AS p FROM dn WHERE x > 0 AND y > 0 AND y < 0.995),
e AS (SELECT n, i, CASE WHEN i = 24 THEN n ELSE CAST(floor(i * (n / 24.0::DOUBLE)) AS BIGINT) END AS lo FROM (SELECT DISTINCT n FROM v) CROSS JOIN range(25) t(i)),
s AS (SELECT n, CAST(i AS INTEGER) AS i, lo, lead(lo) OVER (PARTITION BY n ORDER BY i) AS hi FROM e),
m AS (SELECT frame_id, i, median(x) AS x, median(y) AS y FROM v JOIN s ON v.n = s.n AND p >= lo AND p < hi WHERE v.n >= 192 GROUP BY frame_id, i),
r AS (SELECT frame_id, i, x, max(y) OVER (PARTITION BY frame_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM m)
SELECT frame_id, i, round(x, 9) AS x, round(least(greatest(y, 0), 1), 9) AS y FROM r QUALIFY row_number() OVER (PARTITION BY frame_id, x ORDER BY i) = 1""",
)
def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rising tone curve of each frame's densities to its luma."""
    px = views.pixels(spark, sf_dir)
    d = px.select("frame_id", c.luma709(c.rgb().map(c.density)).alias("x"), (1.0 - c.luma709(c.rgb())).alias("y"))
    return ordered.tone_curve(d, ["frame_id"], "x", "y", 24).select("frame_id", "i", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


KNOTS = ((0.0, 0.02), (0.1, 0.05), (0.3, 0.35), (0.55, 0.6), (0.9, 0.97))


@query(
    "curve_lookup",
    f"WITH {views.PIXELS}, kn AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE, {y}::DOUBLE)' for x, y in KNOTS)}) t(x, y)), sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM kn) "
    "SELECT frame_id, round(avg(coalesce(y0 + (g - x0) * (y1 - y0) / (x1 - x0), y0)), 6) AS toned_avg, count(*) AS n FROM px JOIN sg ON g >= x0 AND (x1 IS NULL OR g < x1) GROUP BY frame_id",
)
def curve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The green channel between the knots of a curve."""
    toned = views.pixels(spark, sf_dir).withColumn("toned", ordered.on_curve(F.col("g"), list(KNOTS)))
    return toned.groupBy("frame_id").agg(F.round(F.avg("toned"), 6).alias("toned_avg"), F.count(F.lit(1)).alias("n"))


@query(
    "deduped_rectangles",
    f"WITH {views.CANDIDATES} SELECT frame_id, cand_pos, x, y, width, height, angle FROM cd QUALIFY row_number() OVER (PARTITION BY frame_id, x // 8, y // 8, width, height, round_even(angle / 10, 0) ORDER BY cand_pos) = 1",
)
def deduped_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each group of rectangles that are alike on a coarse grid."""
    keys = [F.floor(F.col("x") / 8), F.floor(F.col("y") / 8), F.col("width"), F.col("height"), F.rint(F.col("angle") / 10)]
    return ordered.first_wins(views.candidates(spark, sf_dir), keys, "cand_pos", ["frame_id"])


ANGLE = "(CASE WHEN (angle + 45) - 90 * floor((angle + 45) / 90) = 0 THEN 45 ELSE (angle + 45) - 90 * floor((angle + 45) / 90) - 45 END)"
ASPECT = "(CASE WHEN width / height::DOUBLE < 1 THEN 1 / greatest(width / height::DOUBLE, 1e-5) ELSE width / height::DOUBLE END)"


def _format_sql() -> tuple[str, str]:
    s = {n: f"(1 - least(greatest(abs(ln(greatest({ASPECT}, 0.05)) - ln({r!r}::DOUBLE)) / 0.36, 0), 1))" for n, r in relate.FORMATS}
    top = f"greatest({', '.join(s.values())})"
    return f"CASE WHEN {top} <= 0 THEN 'unknown' " + " ".join(f"WHEN {x} = {top} THEN '{n}'" for n, x in s.items()) + " END", top


@query("rectangle_scores", f"WITH {views.CANDIDATES} SELECT cand_pos, round({ANGLE}, 6) AS angle, {_format_sql()[0]} AS format, round({_format_sql()[1]}, 6) AS format_score, round(1 - least(greatest((abs((x + width / 2.0) / 640 - 0.5) * 2 + abs((y + height / 2.0) / 480 - 0.5) * 2) / 1.45, 0), 1), 6) AS centre FROM cd")
def rectangle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.candidates(spark, sf_dir).withColumn("f", relate.best_format(F.col("width") / F.col("height")))
    return d.select("cand_pos", F.round(relate.normal_angle(F.col("angle")), 6).alias("angle"), F.col("f.label").alias("format"), F.round("f.score", 6).alias("format_score"), F.round(relate.centre_prior(F.col("x"), F.col("y"), F.col("width"), F.col("height"), 640, 480), 6).alias("centre"))


def _corners_sql() -> tuple[str, str]:
    """Of candidates: the corners' x and y, comma-joined."""
    turn = "radians(an)"
    xs = [f"cx + {sx} * width / 2.0 * cos({turn}) - {sy} * height / 2.0 * sin({turn})" for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    ys = [f"cy + {sx} * width / 2.0 * sin({turn}) + {sy} * height / 2.0 * cos({turn})" for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return ", ".join(xs), ", ".join(ys)


@query("border_clearance", f"WITH {views.CANDIDATES}, tc AS (SELECT *, x + width / 2.0::DOUBLE AS cx, y + height / 2.0::DOUBLE AS cy, {ANGLE} AS an FROM cd), m AS (SELECT cand_pos, least({_corners_sql()[0]}, {_corners_sql()[1]}, 640 - greatest({_corners_sql()[0]}), 480 - greatest({_corners_sql()[1]})) AS m FROM tc) SELECT cand_pos, round(least(greatest(m / 19.2::DOUBLE, 0), 1), 6) AS clearance FROM m")
def border_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = relate.rotated_corners(*(F.col(n).cast("double") for n in ("x", "y", "width", "height")), relate.normal_angle(F.col("angle")))
    return views.candidates(spark, sf_dir).select("cand_pos", F.round(relate.border_clearance(corners, 640, 480), 6).alias("clearance"))


@query(
    "best_rectangles",
    f"WITH {views.CANDIDATES}, s AS (SELECT *, round(1 - least(greatest((abs((x + width / 2.0) / 640 - 0.5) * 2 + abs((y + height / 2.0) / 480 - 0.5) * 2) / 1.45, 0), 1), 6) AS score FROM cd) SELECT frame_id, cand_pos, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, cand_pos) AS place FROM s QUALIFY place <= 5",
)
def best_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.round(relate.centre_prior(F.col("x"), F.col("y"), F.col("width"), F.col("height"), 640, 480), 6)
    d = views.candidates(spark, sf_dir).withColumn("score", prior)
    return ordered.top_k(d, ["frame_id"], F.col("score"), 5, "cand_pos").select("frame_id", "cand_pos", "score", "place")


@query(
    "rectangle_overlap",
    f"""WITH {views.CANDIDATES}, t AS (SELECT frame_id, min(cand_pos) AS p FROM cd GROUP BY frame_id), p AS (SELECT c.*, r.x AS bx, r.y AS by_, r.width AS bw, r.height AS bh FROM cd c JOIN t USING (frame_id) JOIN cd r ON r.frame_id = c.frame_id AND r.cand_pos = t.p),
i AS (SELECT *, greatest(least(x + width, bx + bw) - greatest(x, bx), 0) * greatest(least(y + height, by_ + bh) - greatest(y, by_), 0) AS both_ FROM p)
SELECT cand_pos, round(both_ / (width * height + bw * bh - both_), 6) AS iou FROM i""",
)
def rectangle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate against the first one of its frame."""
    d = views.candidates(spark, sf_dir)
    first = ordered.first_wins(d, [], "cand_pos", ["frame_id"])
    sides = [x.select("frame_id", "cand_pos", *(F.col(n).alias(f"{p}_{n}") for n in ("x", "y", "width", "height"))) for x, p in ((d, "a"), (first, "b"))]
    return sides[0].join(sides[1].drop("cand_pos"), "frame_id").select("cand_pos", F.round(relate.axis_iou("a", "b"), 6).alias("iou"))


#: The places of either half of a profile that part it best, as lines of an image 640 wide: six at most, above the floor and apart.
LINES_SQL = f"""{views.PROFILE}, ew AS (SELECT key, i, n, avg(v) OVER a AS a, avg(v) OVER b AS b, count(v) OVER a AS na, count(v) OVER b AS nb FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM pf)
  WINDOW b AS (PARTITION BY key ORDER BY i ROWS BETWEEN 6 PRECEDING AND 3 PRECEDING), a AS (PARTITION BY key ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)),
es AS (SELECT key, i, n, i * 2 >= n AS far, round(greatest(0, b - a) * 0.78 + abs(a - b) * 0.22, 6) AS score FROM ew WHERE na = 4 AND nb = 4),
fl AS (SELECT key, far, greatest(quantile_cont(score, 0.82) * 1.15::DOUBLE, 0.030) AS floor FROM es GROUP BY key, far),
ab AS (SELECT key, far, any_value(n) AS n, greatest(4, CAST(round_even(any_value(n) * 0.035::DOUBLE, 0) AS INTEGER)) AS apart, list(i ORDER BY score DESC, i) AS ps, list(score ORDER BY score DESC, i) AS ss FROM es JOIN fl USING (key, far) WHERE score >= floor GROUP BY key, far),
gr AS (SELECT key, far, n, apart, ps, ss, 1 AS k, []::BIGINT[] AS kept FROM ab UNION ALL
  SELECT key, far, n, apart, ps, ss, k + 1, CASE WHEN len(kept) >= 6 OR len(list_filter(kept, lambda q: abs(ps[q] - ps[k]) < apart)) > 0 THEN kept ELSE list_append(kept, k) END FROM gr WHERE k <= len(ps)),
li AS (SELECT key, far, CAST(ps[q] * 640 // n AS BIGINT) AS place, ss[q] AS score FROM (SELECT *, unnest(kept) AS q FROM gr WHERE k > len(ps)))"""


def lines(spark: SparkSession, sf_dir: str, far: bool) -> DataFrame:
    p = views.profile(spark, sf_dir)
    score = F.round(ordered.block_contrast(["key"], "i", "v", 2), 6)
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    p = p.withColumns({"score": score, "n": n}).filter("score is not null").withColumn("far", F.col("i") * 2 >= F.col("n"))
    best = ordered.separated_lines(p, ["key", "far", "n"], "i", "score", "n")
    return best.filter(F.col("far") == far).select("key", F.floor(F.col("i") * 640 / F.col("n")).alias("place"), "score")


def pairs_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.span_pairs(lines(spark, sf_dir, False), lines(spark, sf_dir, True), ["key"], 640, 153, 14)


PAIRS_SQL = f"""{LINES_SQL}, j AS (SELECT a.key, a.place AS a, b.place AS b, (a.score + b.score) * 0.5 + (1 - least(greatest(abs((b.place - a.place) / 640.0::DOUBLE - 0.68::DOUBLE) / 0.52::DOUBLE, 0), 1)) * 0.10::DOUBLE AS score
  FROM li a JOIN li b ON a.key = b.key AND NOT a.far AND b.far AND b.place - a.place BETWEEN 153 AND 614),
lp AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, a, b) <= 14)"""


@query("boundary_pairs", f"WITH RECURSIVE {PAIRS_SQL} SELECT key, a, b, round(score, 6) AS score FROM lp")
def boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_lines(spark, sf_dir).withColumn("score", F.round("score", 6))


RATIOS = (1.5, 2 / 3, 4 / 3, 0.75, 1.0)


@query(
    "boundary_boxes",
    f"""WITH RECURSIVE {PAIRS_SQL}, g AS (SELECT p.key, p.a AS l, p.b AS r, q.a AS t, q.b AS bt, p.score AS xs, q.score AS ys, (p.b - p.a)::DOUBLE AS bw, (q.b - q.a)::DOUBLE AS bh FROM lp p JOIN lp q USING (key)),
k AS (SELECT *, unnest([{', '.join(f'{x!r}::DOUBLE' for x in RATIOS)}]) AS ratio FROM g WHERE bw * bh / 409600.0::DOUBLE BETWEEN 0.10 AND 0.92),
d AS (SELECT *, greatest(12, round_even(CASE WHEN bw / bh >= ratio THEN bh * ratio ELSE bw END, 0)) AS width, greatest(12, round_even(CASE WHEN bw / bh >= ratio THEN bh ELSE bw / ratio END, 0)) AS height FROM k),
f AS (SELECT *, width * height / (bw * bh) AS fill FROM d),
s AS (SELECT key, round_even((l + r) * 0.5::DOUBLE - width * 0.5::DOUBLE, 0) AS x, round_even((t + bt) * 0.5::DOUBLE - height * 0.5::DOUBLE, 0) AS y, width, height, ratio,
  (xs + ys) * 0.44::DOUBLE + (1 - least(greatest(abs(ln(greatest(bw / bh, 0.05)) - ln(ratio)) / 0.42::DOUBLE, 0), 1)) * 0.22::DOUBLE + fill * 0.16::DOUBLE AS score FROM f WHERE fill >= 0.52)
SELECT key, x, y, width, height, round(ratio, 6) AS ratio, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY key ORDER BY round(score, 9) DESC, x, y, width, height, round(ratio, 6)) AS INTEGER) AS place FROM s QUALIFY place <= 10""",
)
def boundary_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from pairs of lines across and down; the best ten of each key."""
    pairs = pairs_of_lines(spark, sf_dir)
    b = relate.boxes(pairs, pairs, ["key"], 640, 640, RATIOS).withColumn("ratio", F.round("ratio", 6))
    b = b.withColumn("pos", F.struct("x", "y", "width", "height", "ratio"))
    return ordered.top_k(b, ["key"], F.round("score", 9), 10, "pos").drop("pos").withColumn("score", F.round("score", 6))
