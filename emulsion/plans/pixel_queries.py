"""Queries over pixels: statistics by frame, and stages of tone and colour as averages by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import stats
from . import views
from .registry import query

KEY = ["frame_id"]


def means(df: DataFrame, p: c.RGB) -> DataFrame:
    """Mean, least and greatest of each channel by frame, to six places."""
    return df.select("frame_id", *(x.alias(n) for n, x in zip("rgb", p, strict=True))).groupBy("frame_id").agg(
        *(F.round(F.avg(n), 6).alias(f"{n}_avg") for n in "rgb"), *(F.round(F.min(n), 6).alias(f"{n}_min") for n in "rgb"), *(F.round(F.max(n), 6).alias(f"{n}_max") for n in "rgb")
    )


def means_sql(ctes: str, source: str, r: str, g: str, b: str) -> str:
    """The same as SQL: ``r``, ``g``, ``b`` are expressions over ``source``."""
    cols = ", ".join([f"round(avg({n}), 6) AS {n}_avg, round(min({n}), 6) AS {n}_min, round(max({n}), 6) AS {n}_max" for n in "rgb"])
    return f"WITH {ctes} SELECT frame_id, {cols} FROM (SELECT frame_id, {r} AS r, {g} AS g, {b} AS b FROM {source}) GROUP BY frame_id"


def each(template: str) -> tuple[str, str, str]:
    return tuple(template.replace("$", ch) for ch in "rgb")


LUMA601 = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
LUMA709 = "(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE)"


@query(
    "exposure_stats",
    f"""WITH {views.PIXELS}, st AS (
  SELECT frame_id, quantile_cont(l, 0.05) p05, quantile_cont(l, 0.25) p25, quantile_cont(l, 0.5) p50, quantile_cont(l, 0.75) p75, quantile_cont(l, 0.95) p95,
    avg(CASE WHEN l <= 0.01 THEN 1.0 ELSE 0.0 END) sc, avg(CASE WHEN l >= 0.99 THEN 1.0 ELSE 0.0 END) hc FROM (SELECT frame_id, {LUMA601} AS l FROM px) GROUP BY frame_id)
SELECT frame_id, round(p05, 9) AS p05, round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, round(p95, 9) AS p95, round(sc, 9) AS shadow_clip, round(hc, 9) AS highlight_clip,
  CASE WHEN sc >= 0.12 OR hc >= 0.07 OR p50 <= 0.10 OR p95 <= 0.35 OR p50 >= 0.90 OR p95 >= 0.992 OR p75 - p25 <= 0.045 THEN 'extreme protected'
       WHEN p50 <= 0.18 OR (p50 <= 0.22 AND p95 <= 0.68) THEN 'low-light salvageable' ELSE 'normal' END AS exposure_class,
  NOT (sc >= 0.10 OR hc >= 0.06 OR p50 <= 0.10 OR p50 >= 0.88 OR p95 <= 0.35 OR p95 >= 0.992 OR p75 - p25 <= 0.045) AS usable
FROM st""",
)
def exposure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.exposure_metrics(views.pixels(spark, sf_dir), KEY)
    m = m.withColumns({"exposure_class": stats.exposure_class(), "usable": stats.exposure_usable()})
    return m.withColumns({n: F.round(n, 9) for n in ("p05", "p25", "p50", "p75", "p95", "shadow_clip", "highlight_clip")})


@query(
    "luma_histogram",
    f"""WITH {views.PIXELS}, n AS (SELECT frame_id, CAST(least(floor({LUMA709.replace('r *', 'least(greatest(r, 0), 1) *').replace('g *', 'least(greatest(g, 0), 1) *').replace('b *', 'least(greatest(b, 0), 1) *')} * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM px GROUP BY ALL)
SELECT f.frame_id, CAST(s.bin AS INTEGER) AS bin, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT frame_id FROM px) f CROSS JOIN range(256) s(bin) LEFT JOIN n ON n.frame_id = f.frame_id AND n.bin = s.bin""",
)
def luma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.luma_histogram(views.pixels(spark, sf_dir), KEY)


def neutral_sql(source: str, clean: str, keys: str = "frame_id") -> str:
    """CTEs nt0 to nt: ``source`` with luma, sat, clean and neutral."""
    return f"""nt0 AS (SELECT *, {LUMA601} AS luma, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {source}),
nt1 AS (SELECT *, (hi - lo) / greatest(hi, 1e-6) AS sat, greatest(abs(r - luma), abs(g - luma), abs(b - luma)) AS spread, ({clean}) AS clean FROM nt0),
ntq AS (SELECT {keys}, count(*) FILTER (clean) AS n_clean, least(0.30, greatest(0.055, quantile_cont(sat, 0.35) FILTER (clean))) AS l1,
  quantile_cont(sat, 0.55) FILTER (clean) AS q2, least(0.14, greatest(0.045, quantile_cont(spread, 0.30) FILTER (clean))) AS l3 FROM nt1 GROUP BY {keys}),
ntl AS (SELECT *, least(0.42, greatest(l1, q2)) AS l2 FROM ntq),
ntn AS (SELECT {keys}, count(*) FILTER (clean AND sat <= l1) AS n1, count(*) FILTER (clean AND sat <= l2) AS n2 FROM nt1 JOIN ntl USING ({keys}) GROUP BY {keys}),
nt AS (SELECT nt1.*, n_clean, clean AND n_clean >= 16 AND CASE WHEN n1 >= 64 THEN sat <= l1 WHEN n2 >= 64 THEN sat <= l2 ELSE spread <= l3 END AS neutral FROM nt1 JOIN ntl USING ({keys}) JOIN ntn USING ({keys}))"""


def trimmed_sql(source: str, out: str, flag: str, q: float, before: int, after: int, cols: tuple[str, str, str], keys: str = "frame_id") -> str:
    """CTE ``out``: ``source`` with ``flag`` set anew without the rows farthest from the median of ``cols``."""
    d = " + ".join(f"({col} - m{i}) * ({col} - m{i})" for i, col in enumerate(cols))
    med = ", ".join(f"median({col}) FILTER ({flag}) AS m{i}" for i, col in enumerate(cols))
    return f"""{out}m AS (SELECT {keys}, {med} FROM {source} GROUP BY {keys}),
{out}d AS (SELECT s.*, sqrt({d}) AS away FROM {source} s JOIN {out}m USING ({keys})),
{out}q AS (SELECT {keys}, count(*) FILTER ({flag}) AS nq, quantile_cont(away, {q}) FILTER ({flag}) AS lim FROM {out}d GROUP BY {keys}),
{out}k AS (SELECT {keys}, count(*) FILTER ({flag} AND away <= lim) AS nk FROM {out}d JOIN {out}q USING ({keys}) GROUP BY {keys}),
{out} AS (SELECT d.* EXCLUDE ({flag}), {flag} AND (NOT (nq >= {before} AND nk >= {after}) OR away <= lim) AS {flag} FROM {out}d d JOIN {out}q USING ({keys}) JOIN {out}k USING ({keys}))"""


CAST_CLEAN = "luma >= 0.08 AND luma <= 0.94 AND lo >= 0.01 AND hi <= 0.985"


@query(
    "cast_metrics",
    f"""WITH {views.PIXELS}, {neutral_sql('px', CAST_CLEAN)},
cu AS (SELECT nt.*, CASE WHEN nn >= 16 THEN neutral ELSE clean AND n_clean >= 16 END AS used FROM nt JOIN (SELECT frame_id, count(*) FILTER (neutral) AS nn FROM nt GROUP BY frame_id) USING (frame_id)),
f AS (SELECT frame_id, count(*) AS sampled, count(*) FILTER (used) AS n_used, median(sat) FILTER (used) AS sat_median FROM cu GROUP BY frame_id),
{trimmed_sql('cu', 'ct', 'used', 0.85, 32, 16, ('(r - luma)', '(g - luma)', '(b - luma)'))},
m AS (SELECT frame_id, median(r - luma) FILTER (used) AS r, median(g - luma) FILTER (used) AS g, median(b - luma) FILTER (used) AS b FROM ct GROUP BY frame_id),
v AS (SELECT frame_id, r - {LUMA601} AS cr, g - {LUMA601} AS cg, b - {LUMA601} AS cb FROM m)
SELECT frame_id, round(sqrt(cr * cr + cg * cg + cb * cb), 6) AS magnitude, round(cr, 6) AS cast_r, round(cg, 6) AS cast_g, round(cb, 6) AS cast_b, round(n_used / sampled, 6) AS neutral_fraction, n_used AS neutral_pixels, sampled, round(sat_median, 6) AS sat_median
FROM v JOIN f USING (frame_id)""",
)
def cast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.cast_metrics(views.pixels(spark, sf_dir), KEY)
    return m.withColumns({n: F.round(n, 6) for n in ("magnitude", "cast_r", "cast_g", "cast_b", "neutral_fraction", "sat_median")})


GAIN_CLEAN = "luma >= 0.06 AND luma <= 0.96 AND lo >= 0.006 AND hi <= 0.992"


@query(
    "neutral_gains",
    f"""WITH {views.PIXELS}, {neutral_sql('px', GAIN_CLEAN)}, gu AS (SELECT *, neutral AS used FROM nt),
n AS (SELECT frame_id, count(*) FILTER (used) AS n FROM gu GROUP BY frame_id), {trimmed_sql('gu', 'gt', 'used', 0.80, 128, 96, ('r', 'g', 'b'))},
m AS (SELECT frame_id, median(r) FILTER (used) AS r, median(g) FILTER (used) AS g, median(b) FILTER (used) AS b, median(luma) FILTER (used) AS t FROM gt GROUP BY frame_id),
raw AS (SELECT frame_id, least(greatest(t / r, 0.05), 20) AS r, least(greatest(t / g, 0.05), 20) AS g, least(greatest(t / b, 0.05), 20) AS b FROM m)
SELECT frame_id, n, round(r / {LUMA601}, 6) AS gain_r, round(g / {LUMA601}, 6) AS gain_g, round(b / {LUMA601}, 6) AS gain_b FROM raw JOIN n USING (frame_id)""",
)
def neutral_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.neutral_gains(views.pixels(spark, sf_dir), KEY)
    p = c.unit_luma_gains(c.rgb("gain_r", "gain_g", "gain_b"))
    return m.select("frame_id", "n", *(F.round(x, 6).alias(f"gain_{n}") for n, x in zip("rgb", p, strict=True)))


LOGS = "lg AS (SELECT frame_id, log10(least(greatest(r, 1e-6), 1)) AS r, log10(least(greatest(g, 1e-6), 1)) AS g, log10(least(greatest(b, 1e-6), 1)) AS b FROM px)"
BOUNDS = LOGS + ", bd AS (SELECT frame_id, " + ", ".join(f"quantile_cont({n}, 0.0002) AS f{n}, quantile_cont({n}, 0.9998) AS c{n}" for n in "rgb") + " FROM lg GROUP BY frame_id)"
NORMAL = BOUNDS + ", nl AS (SELECT frame_id, " + ", ".join(f"least(greatest((lg.{n} - f{n}) / CASE WHEN abs(c{n} - f{n}) < 1e-6 THEN 1e-6 ELSE c{n} - f{n} END, 0), 1) AS {n}" for n in "rgb") + " FROM lg JOIN bd USING (frame_id))"


@query("log_bounds", f"WITH {views.PIXELS}, {BOUNDS} SELECT frame_id, " + ", ".join(f"round(f{n}, 6) AS floor_{n}, round(c{n}, 6) AS ceil_{n}" for n in "rgb") + " FROM bd")
def log_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.log_bounds(views.pixels(spark, sf_dir), KEY)
    return b.select("frame_id", *(F.round(n, 6).alias(n) for n in b.columns[1:]))


def normal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    return stats.normalised_log(px, KEY, stats.log_bounds(px, KEY))


@query("log_normalised", means_sql(f"{views.PIXELS}, {NORMAL}", "nl", "r", "g", "b"))
def log_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(normal_log(spark, sf_dir), c.rgb())


def wb_sql(source: str, luma: str, band: tuple[float, float], inside: tuple[float, float], chroma: float) -> str:
    """CTE ws: the rows of the white-balance sample."""
    return f"""w0 AS (SELECT *, {luma} AS l, greatest(r, g, b) - least(r, g, b) AS ch FROM {source}),
w1 AS (SELECT w0.*, l >= lo - 1e-12 AND l <= hi + 1e-12 AS s FROM w0 JOIN (SELECT frame_id, quantile_cont(l, {band[0]}) AS lo, quantile_cont(l, {band[1]}) AS hi FROM w0 GROUP BY frame_id) USING (frame_id)),
w2 AS (SELECT * EXCLUDE (s), CASE WHEN count(*) FILTER (s) OVER (PARTITION BY frame_id) >= 128 THEN s ELSE true END AS s FROM w1),
w3 AS (SELECT * EXCLUDE (s), CASE WHEN count(*) FILTER (s AND least(r, g, b) > {inside[0]} AND greatest(r, g, b) < {inside[1]}) OVER (PARTITION BY frame_id) >= 128 THEN s AND least(r, g, b) > {inside[0]} AND greatest(r, g, b) < {inside[1]} ELSE s END AS s FROM w2),
w4 AS (SELECT w3.*, lim FROM w3 JOIN (SELECT frame_id, quantile_cont(ch, {chroma}) FILTER (s) AS lim FROM w3 GROUP BY frame_id) USING (frame_id)),
ws AS (SELECT * FROM (SELECT * EXCLUDE (s), CASE WHEN count(*) FILTER (s AND ch <= lim + 1e-12) OVER (PARTITION BY frame_id) >= 128 THEN s AND ch <= lim + 1e-12 ELSE s END AS s FROM w4) WHERE s)"""


NEG_LUMA = "((1 - r) * 0.2126::DOUBLE + (1 - g) * 0.7152::DOUBLE + (1 - b) * 0.0722::DOUBLE)"
OFFSETS = wb_sql("nl", NEG_LUMA, (0.22, 0.78), (0.04, 0.96), 0.45) + """,
om AS (SELECT frame_id, median(r) AS r, median(g) AS g, median(b) AS b FROM ws GROUP BY frame_id),
os AS (SELECT frame_id, """ + ", ".join(f"least(greatest(((r + g + b) / 3.0 - {n}) * 0.65, -0.04), 0.04) AS o_{n}" for n in "rgb") + " FROM om)"


@query("auto_offsets", f"WITH {views.PIXELS}, {NORMAL}, {OFFSETS} SELECT frame_id, " + ", ".join(f"round(o_{n}, 6) AS offset_{n}" for n in "rgb") + " FROM os")
def auto_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = stats.auto_offsets(normal_log(spark, sf_dir), KEY)
    return o.select("frame_id", *(F.round(n, 6).alias(n) for n in o.columns[1:]))


@query(
    "grey_gains",
    f"""WITH {views.PIXELS}, {wb_sql('px', LUMA709, (0.12, 0.88), (0.02, 0.98), 0.55)}, m AS (SELECT frame_id, greatest(median(r), 1e-5) AS r, greatest(median(g), 1e-5) AS g, greatest(median(b), 1e-5) AS b FROM ws GROUP BY frame_id)
SELECT frame_id, """ + ", ".join(f"round(1 + (least(greatest((r + g + b) / 3.0 / {n}, 0.5), 2) - 1) * 0.65, 6) AS gain_{n}" for n in "rgb") + " FROM m",
)
def grey_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = stats.grey_gains(views.pixels(spark, sf_dir), KEY)
    return o.select("frame_id", *(F.round(n, 6).alias(n) for n in o.columns[1:]))


ANCHOR = f"an AS (SELECT frame_id, least(greatest(quantile_cont({LUMA709}, 0.55), 0.32), 0.62) AS anchor FROM px GROUP BY frame_id)"


@query("tone_anchor", f"WITH {views.PIXELS}, {ANCHOR} SELECT frame_id, round(anchor, 6) AS anchor FROM an")
def tone_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tone_anchor(views.pixels(spark, sf_dir), KEY).withColumn("anchor", F.round("anchor", 6))


@query(
    "display_stretch",
    f"""WITH {views.PIXELS}, q AS (SELECT frame_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM (SELECT frame_id, unnest([r, g, b]) AS v FROM px) GROUP BY frame_id),
d AS (SELECT frame_id, """ + ", ".join(f"CAST(floor(power(least(greatest(({n} - lo) / greatest(hi - lo, 1e-6), 0), 1), 1 / 2.2::DOUBLE) * 255 + 0.5) AS INTEGER) AS {n}" for n in "rgb") + """ FROM px JOIN q USING (frame_id))
SELECT frame_id, CAST(sum(r) AS BIGINT) AS r_sum, CAST(sum(g) AS BIGINT) AS g_sum, CAST(sum(b) AS BIGINT) AS b_sum FROM d GROUP BY frame_id""",
)
def display_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.display_stretch(views.pixels(spark, sf_dir), KEY).groupBy("frame_id").agg(*(F.sum(n).alias(f"{n}_sum") for n in "rgb"))


@query(
    "level_points",
    f"""WITH {views.PIXELS}, q AS (SELECT frame_id, quantile_cont({LUMA709}, 0.005) AS lo, quantile_cont({LUMA709}, 0.55) AS mid, quantile_cont({LUMA709}, 0.995) AS hi FROM px GROUP BY frame_id),
p AS (SELECT *, lo - 0.02 * greatest(1e-5, hi - lo) AS bk, hi + 0.04 * greatest(1e-5, hi - lo) AS wh FROM q),
m AS (SELECT *, bk + greatest(1e-5, wh - bk) * power(0.5, 1 / least(greatest(ln(0.5) / ln(least(greatest((mid - bk) / greatest(1e-5, wh - bk), 0.01), 0.99)), 0.2), 8)) AS md FROM p),
i AS (SELECT frame_id, greatest(0, least(98, round_even(bk * 100, 0))) AS b, round_even(md * 100, 0) AS m, round_even(wh * 100, 0) AS w FROM m),
j AS (SELECT frame_id, b, m, greatest(b + 2, least(100, w)) AS w FROM i)
SELECT frame_id, CAST(b AS INTEGER) AS black_point, CAST(greatest(b + 1, least(w - 1, m)) AS INTEGER) AS mid_point, CAST(w AS INTEGER) AS white_point FROM j""",
)
def level_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black, middle and white sliders from three percentiles, for a linear curve whose middle should come out at one half."""
    luma = c.luma709(c.rgb().map(c.unit))
    q = views.pixels(spark, sf_dir).groupBy("frame_id").agg(F.percentile(luma, F.array(F.lit(0.005), F.lit(0.55), F.lit(0.995))).alias("q"))
    lo, mid, hi = (F.get("q", i) for i in range(3))
    span = F.greatest(F.lit(1e-5), hi - lo)
    q = q.select("frame_id", mid.alias("mid"), (lo - 0.02 * span).alias("bk"), (hi + 0.04 * span).alias("wh"))
    reach = F.greatest(F.lit(1e-5), F.col("wh") - F.col("bk"))
    gamma = c.clip(F.ln(F.lit(0.5)) / F.ln(c.clip((F.col("mid") - F.col("bk")) / reach, 0.01, 0.99)), 0.2, 8.0)
    q = q.select("frame_id", F.greatest(F.lit(0), F.least(F.lit(98), F.rint(F.col("bk") * 100))).alias("b"), F.rint((F.col("bk") + reach * F.pow(F.lit(0.5), 1.0 / gamma)) * 100).alias("m"), F.rint(F.col("wh") * 100).alias("w"))
    q = q.withColumn("w", F.greatest(F.col("b") + 2, F.least(F.lit(100), F.col("w"))))
    return q.select("frame_id", F.col("b").cast("int").alias("black_point"), F.greatest(F.col("b") + 1, F.least(F.col("w") - 1, F.col("m"))).cast("int").alias("mid_point"), F.col("w").cast("int").alias("white_point"))


def logistic_sql(x: str) -> str:
    return f"(1 / (1 + exp(-least(greatest({x}, -60), 60))))"


def step_sql(lo: str, hi: str, x: str) -> str:
    t = f"least(greatest(({x} - {lo}) / greatest({hi} - {lo}, 1e-5), 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def response_sql(v: str, pivot: float, slope: float, bias: float, knee: float = 0.55) -> str:
    """The print response without soft ends."""
    shift = f"({v} - {pivot}::DOUBLE + {bias}::DOUBLE * {step_sql('0', str(knee), f'({knee} - least(greatest({v}, 0), 1))')})"
    return f"least(greatest(power(10.0::DOUBLE, -4 * {logistic_sql(f'{slope}::DOUBLE * {shift}')}), 0), 1)"


STANDARD = c.print_curve("standard")


@query("print_response", means_sql(f"{views.PIXELS}, {NORMAL}, {OFFSETS}, np AS (SELECT nl.*, o_r, o_g, o_b FROM nl JOIN os USING (frame_id))", "np", *(response_sql(f"(round_even({n} * 16383, 0) / 16383 + {o})", STANDARD.pivot, STANDARD.slope, 0.12) for n, o in (("r", "o_r"), ("g", "o_g"), ("b", "o_b")))))
def print_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard print curve on the normalised negative, with the automatic offsets."""
    n = normal_log(spark, sf_dir)
    j = stats.on(n, stats.auto_offsets(n, KEY), KEY)
    return means(j, c.RGB(*(c.print_response(c.on_table(F.col(x)), STANDARD, F.col(f"offset_{x}")) for x in "rgb")))


def soft_response_sql(v: str, curve: c.PrintCurve) -> str:
    """The print response with both ends soft; ``v`` is in [0, 1]."""
    away = f"({v} - {curve.pivot!r}::DOUBLE)"
    toe = logistic_sql(f"2.5::DOUBLE * ({away} / {1.0 - curve.pivot!r}::DOUBLE - 0.5)")
    shoulder = logistic_sql(f"-2.5::DOUBLE * ({away} / {curve.pivot!r}::DOUBLE + 0.5)")
    turn = lambda m: f"least(greatest(4 * {m} * (1 - {m}), 0), 1)"
    shift = f"{away} - 0.056::DOUBLE * {turn(toe)} + 0.05::DOUBLE * {turn(shoulder)}"
    if curve.highlight_bias:
        shift += f" + {curve.highlight_bias!r}::DOUBLE * {step_sql('0', '0.55', f'(0.55::DOUBLE - {v})')}"
    slope = f"least(greatest(1 - 0.11::DOUBLE * {turn(toe)} - 0.09::DOUBLE * {turn(shoulder)}, 0.1), 2)"
    return f"least(greatest(power(10.0::DOUBLE, -4 * {logistic_sql(f'{curve.slope!r}::DOUBLE * ({shift}) * {slope}')}), 0), 1)"


def _print_curves_sql() -> str:
    out = []
    for mode in c.MODE_CURVES:
        if mode.startswith("filmic_"):
            curve = HABLE_SQL if mode == "filmic_hable" else ACES_SQL
            v = f"least(greatest({curve.replace('x', '(1 - g)').replace('ma(1 - g)', 'max')} / {curve.replace('x', '1.0::DOUBLE')}, 0), 1)"
        else:
            v = soft_response_sql("g", c.print_curve(mode, exposure=10, contrast=-5))
        out.append(f"round(avg({v}), 6) AS {mode}")
    return f"WITH {views.PIXELS} SELECT frame_id, {', '.join(out)} FROM px GROUP BY frame_id"


HABLE_SQL = "(((x * (0.15 * x + 0.05) + 0.004) / greatest(x * (0.15 * x + 0.5) + 0.06, 1e-6)) - 0.02 / 0.30)"
ACES_SQL = "((x * (2.51 * x + 0.03)) / greatest(x * (2.43 * x + 0.59) + 0.14, 1e-6))"


@query("print_curves", _print_curves_sql())
def print_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode's curve on the green channel, soft ends on."""
    px = views.pixels(spark, sf_dir)
    out = []
    for mode in c.MODE_CURVES:
        v = c.rational_curve(1.0 - F.col("g"), mode) if mode.startswith("filmic_") else c.print_response(F.col("g"), c.print_curve(mode, exposure=10, contrast=-5, soft_shadows=True, soft_highlights=True))
        out.append(F.round(F.avg(v), 6).alias(mode))
    return px.groupBy("frame_id").agg(*out)


def _rational_sql(curve: str) -> str:
    one = curve.replace("x", "1.0::DOUBLE")
    f = lambda n: f"least(greatest({curve.replace('x', n)} / {one}, 0), 1)"
    return means_sql(views.PIXELS, "px", f("r"), f("g"), f("b"))


@query("filmic_hable", _rational_sql(HABLE_SQL))
def filmic_hable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.rgb().map(lambda x: c.rational_curve(x, "filmic_hable")))


@query("filmic_aces", _rational_sql(ACES_SQL))
def filmic_aces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.rgb().map(lambda x: c.rational_curve(x, "filmic_aces")))


def _hue_sql(mode: str) -> str:
    """The least and greatest channel on the cubic curve, six Newton steps each."""
    (x1, y1), (x2, y2) = c.BEZIER_POINTS[mode]
    at = lambda t, a, b: f"(3 * (1 - {t}) * (1 - {t}) * {t} * {a}::DOUBLE + 3 * (1 - {t}) * {t} * {t} * {b}::DOUBLE + {t} * {t} * {t})"
    rise = lambda t: f"(3 * (1 - {t}) * (1 - {t}) * {x1}::DOUBLE + 6 * (1 - {t}) * {t} * {x2 - x1!r}::DOUBLE + 3 * {t} * {t} * {1 - x2!r}::DOUBLE)"
    ctes = ["h0 AS (SELECT *, least(r, g, b) AS lo, greatest(r, g, b) AS hi, least(r, g, b) AS tl, greatest(r, g, b) AS th FROM px)"]
    for k in range(6):
        step = ", ".join(f"least(greatest({t} - ({at(t, x1, x2)} - {x}) / greatest({rise(t)}, 1e-5), 0), 1) AS {t}" for t, x in (("tl", "lo"), ("th", "hi")))
        ctes.append(f"h{k + 1} AS (SELECT * EXCLUDE (tl, th), {step} FROM h{k})")
    ctes.append(f"hc AS (SELECT *, least(greatest({at('tl', y1, y2)}, 0), 1) AS cl, least(greatest({at('th', y1, y2)}, 0), 1) AS ch FROM h6)")
    put = lambda n: f"least(greatest(cl + ({n} - lo) * CASE WHEN hi - lo > 1e-6 THEN (ch - cl) / (hi - lo) ELSE 0 END, 0), 1)"
    return means_sql(f"{views.PIXELS}, {', '.join(ctes)}", "hc", put("r"), put("g"), put("b"))


@query("hue_preserving_curve", _hue_sql("contrast"))
def hue_preserving_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.hue_preserving(c.rgb(), "contrast"))


S_CURVE = "($ * 0.42 + least(greatest((1 / (1 + exp(-1.85 * ($ - 0.5))) - 1 / (1 + exp(0.925))) / (1 / (1 + exp(-0.925)) - 1 / (1 + exp(0.925))), 0), 1) * 0.58)"


@query("s_curve", means_sql(views.PIXELS, "px", *each(S_CURVE)))
def s_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.rgb().map(c.s_curve))


@query("unit_levels", means_sql(views.PIXELS, "px", *each("least(greatest(power(greatest(($ - 0.08) / 0.87, 0), least(greatest(ln(0.5) / ln((0.42 - 0.08) / 0.87), 0.2), 8)), 0), 1)")))
def unit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.unit_levels(c.rgb(), 8, 42, 95))


@query(
    "soft_black_levels",
    means_sql(views.PIXELS, "px", *each("least(CASE WHEN ($ - 0.12) / 0.83 < 0 THEN 0.004 * exp(($ - 0.12) / 0.83 / 0.1) ELSE 0.004 + power(greatest(($ - 0.12) / 0.83, 0), ln(0.5) / ln((0.5 - 0.12) / 0.83)) * 0.996 END, 1)")),
)
def soft_black_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.unit_levels(c.rgb(), 12, 50, 95, soft_black=True))


@query("exposure_and_contrast", means_sql(views.PIXELS, "px", *each("least(greatest((least(greatest(greatest($, 0) * power(2, 0.35), 0), 1) - 0.5) * 1.2 + 0.5, 0), 1)")))
def exposure_and_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.contrast(c.exposure(c.rgb(), 35), 20))


def gamut(df: DataFrame, p: c.RGB) -> tuple[DataFrame, c.RGB]:
    """``df`` with the columns of ``p`` as r, g, b and whether their frame has any pixel out of gamut; and the pixels compressed."""
    df = df.withColumns(dict(zip("rgb", p, strict=True)))
    df = stats.beside(df, KEY, outside=F.bool_or(c.out_of_gamut(c.rgb())))
    return c.compressed_gamut(df, F.col("outside")), c.rgb()


def gamut_sql(source: str) -> str:
    """CTE gc: ``source`` compressed into the gamut."""
    lum = f"least(greatest({LUMA709}, 1e-5), 1 - 1e-5)"
    lim = ", ".join(f"CASE WHEN {n} - l < -1e-6 THEN (l - 1e-5) / (l - {n}) END, CASE WHEN {n} - l > 1e-6 THEN (1 - 1e-5 - l) / ({n} - l) END" for n in "rgb")
    return f"""g0 AS (SELECT *, least(r, g, b) < 0 OR greatest(r, g, b) > 1 AS o, bool_or(least(r, g, b) < 0 OR greatest(r, g, b) > 1) OVER (PARTITION BY frame_id) AS any_o, {lum} AS l FROM {source}),
g1 AS (SELECT *, least(greatest(coalesce(least({lim}), 1), 0), 1) AS s FROM g0),
g2 AS (SELECT frame_id, r, g, b, o, any_o, l, l + (r - l) * s AS pr, l + (g - l) * s AS pg, l + (b - l) * s AS pb FROM g1),
g3 AS (SELECT *, least(greatest(pr * 0.2126::DOUBLE + pg * 0.7152::DOUBLE + pb * 0.0722::DOUBLE, 1e-5), 1 - 1e-5) AS k, CASE WHEN o THEN 1 - {step_sql('0.01', '0.12', 'l')} ELSE 0 END AS w FROM g2),
gc AS (SELECT frame_id, {", ".join(f"CASE WHEN any_o THEN least(greatest(CASE WHEN w > 0 THEN k + (p{n} - k) * (1 - 0.55 * w) ELSE p{n} END, 0), 1) ELSE {n} END AS {n}" for n in "rgb")} FROM g3)"""


@query("saturation", means_sql(f"{views.PIXELS}, sa AS (SELECT frame_id, " + ", ".join(f"{LUMA709} + ({n} - {LUMA709}) * 1.81 AS {n}" for n in "rgb") + f" FROM px), {gamut_sql('sa')}", "gc", "r", "g", "b"))
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(*gamut(views.pixels(spark, sf_dir), c.saturated(c.rgb(), 60)))


MATRIX = ((1.62, -0.44, -0.18), (-0.21, 1.48, -0.27), (0.03, -0.52, 1.49))


@query("camera_matrix", means_sql(f"{views.PIXELS}, cm AS (SELECT frame_id, " + ", ".join("(" + " + ".join(f"{n} * {(1.0 if i == j else 0.0) * 0.3 + MATRIX[i][j] * 0.7!r}" for i, n in enumerate("rgb")) + f")::DOUBLE AS {m}" for j, m in enumerate("rgb")) + f" FROM px), {gamut_sql('cm')}", "gc", "r", "g", "b"))
def camera_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(*gamut(views.pixels(spark, sf_dir), c.matrix_mix(c.rgb(), MATRIX, 0.7)))


def _separation_sql() -> str:
    out = []
    for i in range(3):
        row = [(1.0 if i == j else 0.0) * 0.55 + c.SEPARATION[i][j] * 0.45 for j in range(3)]
        d = " + ".join(f"-log10(least(greatest({n}, 1e-6), 1)) * ({x!r}::DOUBLE / {sum(row)!r}::DOUBLE)" for n, x in zip("rgb", row, strict=True))
        out.append(f"least(greatest(power(10.0::DOUBLE, -greatest({d}, 0)), 0), 1)")
    return means_sql(views.PIXELS, "px", *out)


@query("colour_separation", _separation_sql())
def colour_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.colour_separation(c.rgb()))


BALANCE = c.ColourBalance(c.Balance(12, -4, 7), (("shadows", c.Balance(10, 0, -15)), ("midtones", c.Balance(0, 5, 0)), ("highlights", c.Balance(-8, 0, 0, 30))))


@query(
    "colour_balance",
    means_sql(
        f"{views.PIXELS}, cb AS (SELECT *, {LUMA709} AS l FROM px), cw AS (SELECT *, 1 - {step_sql('0', '0.4', 'l')} AS sh, least(greatest(1 - {step_sql('0', '1', '(abs(l - 0.5) / 0.4)')}, 0), 1) AS mi, {step_sql('(1 - 0.288)', '1', 'l')} AS hi FROM cb)", "cw",
        "least(greatest(r * power(2, 12 / 55.0) * exp(sh * ln(power(2, 10 / 75.0))) * exp(hi * ln(power(2, -8 / 75.0))), 0), 1)",
        "least(greatest(g * power(2, -4 / 55.0) * exp(mi * ln(power(2, 5 / 75.0))), 0), 1)",
        "least(greatest(b * power(2, 7 / 55.0) * exp(sh * ln(power(2, -15 / 75.0))), 0), 1)",
    ),
)
def colour_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(views.pixels(spark, sf_dir), c.colour_balance(c.rgb(), BALANCE))


def tones_ctes(source: str, shadows: int, highlights: int) -> str:
    """CTEs up to tr, ``source`` (with an, its anchors) and the ratio of its pixels. Lifted shadows and recovered highlights: cubic pieces through three points below and above the anchor."""
    s, h = shadows / 100.0, -highlights / 100.0
    knots = f"""kn AS (SELECT {source}.*, a, a * 0.62 AS sx, least(a - 1e-4, a * 0.62 + a * 0.24 * {s}) AS sy, a + (1 - a) * 0.38 AS hx, greatest(a + 1e-4, a + (1 - a) * 0.38 - (1 - a) * 0.27 * {h}) AS hy,
  {LUMA709} AS l, round_even(least({LUMA709}, 1) * 16383, 0) / 16383 AS x FROM {source} JOIN (SELECT frame_id, anchor AS a FROM an) USING (frame_id))"""
    slopes = "k1 AS (SELECT *, sy / sx AS s0, (a - sy) / (a - sx) AS s1, (hy - a) / (hx - a) AS u0, (1 - hy) / (1 - hx) AS u1 FROM kn)"
    start = "k2 AS (SELECT *, s0 AS m0, (s0 + s1) * 0.5 AS m1, s1 AS m2, u0 AS n0, (u0 + u1) * 0.5 AS n1, u1 AS n2 FROM k1)"
    ctes = [knots, slopes, start]
    for i in (0, 1):  # tangents kept inside a circle of three slopes, segment by segment
        cols = []
        for m, z in (("m", f"s{i}"), ("n", f"u{i}")):
            r2 = f"(power(greatest({m}{i}, 0) / {z}, 2) + power(greatest({m}{i + 1}, 0) / {z}, 2))"
            k = f"CASE WHEN {z} <= 1e-8 THEN 0 WHEN {r2} > 9 THEN 3 / sqrt({r2}) ELSE 1 END"
            cols += [f"greatest({m}{j}, 0) * ({k}) AS {m}{j}" for j in (i, i + 1)]
        ctes.append(f"k{3 + i} AS (SELECT * EXCLUDE (m{i}, m{i + 1}, n{i}, n{i + 1}), {', '.join(cols)} FROM k{2 + i})")

    def piece(m: str, i: int, x0: str, y0: str, x1: str, y1: str) -> str:
        w, t, d = f"({x1} - {x0})", f"((x - {x0}) / ({x1} - {x0}))", f"(({y1} - {y0}) / ({x1} - {x0}))"
        return f"({y0} + {w} * {t} * ({m}{i} + {t} * (3 * {d} - 2 * {m}{i} - {m}{i + 1} + {t} * ({m}{i} + {m}{i + 1} - 2 * {d}))))"

    y = f"CASE WHEN x >= a THEN CASE WHEN x < hx THEN {piece('n', 0, 'a', 'a', 'hx', 'hy')} ELSE {piece('n', 1, 'hx', 'hy', '1', '1')} END WHEN x < sx THEN {piece('m', 0, '0', '0', 'sx', 'sy')} ELSE {piece('m', 1, 'sx', 'sy', 'a', 'a')} END"
    ctes.append(f"ty AS (SELECT *, CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE least(greatest({y}, 0), 1) END AS y FROM k4)")
    ctes.append(f"tr AS (SELECT *, least(CASE WHEN l > 1e-5 THEN (y + greatest(l - 1, 0) * {max(0.18, 0.55 * (1 - h))!r}) / l ELSE 1 END, {1 + 2.8 * s!r}) AS ratio FROM ty)")
    return ", ".join(ctes)


@query("highlights_and_shadows", means_sql(f"{views.PIXELS}, {ANCHOR}, {tones_ctes('px', 40, -55)}", "tr", "r * ratio", "g * ratio", "b * ratio"))
def highlights_and_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    return means(c.highlights_and_shadows(stats.on(px, stats.tone_anchor(px, KEY), KEY), 40, -55), c.rgb())


@query(
    "soft_tones",
    means_sql(
        f"""{views.PIXELS}, su AS (SELECT frame_id, greatest(1, coalesce(quantile_cont({LUMA709}, 0.997) FILTER ({LUMA709} > 0.72), 1)) AS top FROM px GROUP BY frame_id), sl AS (SELECT px.*, top, {LUMA709} AS l FROM px JOIN su USING (frame_id)),
sh AS (SELECT *, l * (1 - 0.42 * {step_sql('0.62', 'least(top, 1)', 'l')}) + least(0.72 + 0.28 * (1 - exp(-2.4 * greatest(l - 0.72, 0) / (top - 0.72))) / (1 - exp(-2.4)), 1) * 0.42 * {step_sql('0.62', 'least(top, 1)', 'l')} AS t FROM sl),
sd AS (SELECT *, t * (1 - 0.46 * (1 - {step_sql('0', '0.30', 'l')})) + (0.018 + t * 0.76) * 0.46 * (1 - {step_sql('0', '0.30', 'l')}) AS u, 1 - {step_sql('0', '0.20', 'l')} AS f FROM sh)""",
        "sd", *each("$ * u / greatest(l, 1e-5) * (1 - 0.18 * f) + 0.018 * 0.65 * f"),
    ),
)
def soft_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    luma = c.luma709(c.rgb())
    upper = px.groupBy("frame_id").agg(stats.quantile(F.when(luma > 0.72, luma), 0.997).alias("upper"))
    return means(stats.on(px, upper, KEY), c.soft_tones(c.rgb(), True, True, F.col("upper")))


@query("encoded_channels", f"WITH {views.PIXELS} SELECT frame_id, " + ", ".join(f"CAST(sum(CAST(floor(power(least(greatest({n}, 0), 1), 1 / 2.2::DOUBLE) * {k} + 0.5) AS INTEGER)) AS BIGINT) AS {n}{bits}" for n in "rgb" for k, bits in ((255, 8), (65535, 16))) + " FROM px GROUP BY frame_id")
def encoded_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir).groupBy("frame_id").agg(*(F.sum(c.encoded(F.col(n), k)).alias(f"{n}{bits}") for n in "rgb" for k, bits in ((255, 8), (65535, 16))))


@query("srgb_round_trip", means_sql(views.PIXELS, "px", "CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE power((r + 0.055) / 1.055, 2.4) END", "CASE WHEN g <= 0.0031308 THEN g * 12.92 ELSE 1.055 * power(g, 1 / 2.4::DOUBLE) - 0.055 END", "greatest(-log10(least(greatest(b, 1e-6), 1)), 0)"))
def srgb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piecewise sRGB curve both ways, and density."""
    return means(views.pixels(spark, sf_dir), c.RGB(c.srgb_to_linear(F.col("r")), c.linear_to_srgb(F.col("g")), c.density(F.col("b"))))


@query(
    "tone_aware_gains",
    means_sql(
        f"{views.PIXELS}, tw AS (SELECT *, {LUMA601} AS l FROM px), tx AS (SELECT *, 1 - {step_sql('0.14', '0.42', 'l')} AS sh, {step_sql('0.18', '0.42', 'l')} * (1 - {step_sql('0.62', '0.86', 'l')}) AS mi, {step_sql('0.58', '0.88', 'l')} AS hi FROM tw)", "tx",
        *(f"round_even(least(greatest({n} * 65535 * exp({a} + sh * {s} + mi * {m} + hi * {h}), 0), 65535), 0) / 65535" for n, a, s, m, h in (("r", 0.06, 0.02, -0.01, 0.03), ("g", -0.02, -0.01, 0.0, -0.01), ("b", -0.05, 0.0, 0.02, -0.02))),
    ),
)
def tone_aware_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = c.luma601(c.rgb())
    sh, mi, hi = 1.0 - c.hard_smoothstep(0.14, 0.42, luma), c.hard_smoothstep(0.18, 0.42, luma) * (1.0 - c.hard_smoothstep(0.62, 0.86, luma)), c.hard_smoothstep(0.58, 0.88, luma)
    logs = {"r": (0.06, 0.02, -0.01, 0.03), "g": (-0.02, -0.01, 0.0, -0.01), "b": (-0.05, 0.0, 0.02, -0.02)}
    p = c.RGB(*(F.rint(c.clip(F.col(n) * 65535 * F.exp(a + sh * s + mi * m + hi * h), 0.0, 65535.0)) / 65535 for n, (a, s, m, h) in logs.items()))
    return means(views.pixels(spark, sf_dir), p)


@query(
    "image_difference",
    f"""WITH {views.PIXELS}, d AS (SELECT frame_id, r, g, b, least(greatest((r - 0.5) * 1.2 + 0.5, 0), 1) AS r2, least(greatest((g - 0.5) * 1.2 + 0.5, 0), 1) AS g2, least(greatest((b - 0.5) * 1.2 + 0.5, 0), 1) AS b2 FROM px),
e AS (SELECT frame_id, unnest([r2 - r, g2 - g, b2 - b]) AS d FROM d)
SELECT frame_id, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(quantile_cont(abs(d), 0.95), 6) AS p95_abs FROM e GROUP BY frame_id""",
)
def image_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c.contrast(c.rgb(), 20)
    d = views.pixels(spark, sf_dir).withColumns(dict(zip(("r2", "g2", "b2"), q, strict=True)))
    e = stats.error_stats(d, KEY, ["r2", "g2", "b2"], ["r", "g", "b"])
    return e.select("frame_id", *(F.round(n, 6).alias(n) for n in ("rmse", "mae", "p95_abs")))
