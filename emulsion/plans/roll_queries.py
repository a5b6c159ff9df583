"""Queries over rolls: baseline, membership, exposure targets, plans, and least-squares fits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import fits, stats
from . import pixel_queries as px_sql
from . import roll, views
from .registry import query


def with_rolls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.pixels(spark, sf_dir), views.frames(spark, sf_dir)


def unit_sql(prefix: str, out: str) -> str:
    """Gains of a prefix clipped and divided by their luma, as columns out_r, out_g, out_b."""
    safe = {n: f"least(greatest({prefix}_{n}, 0.05), 20)" for n in "rgb"}
    luma = f"({safe['r']} * 0.299::DOUBLE + {safe['g']} * 0.587::DOUBLE + {safe['b']} * 0.114::DOUBLE)"
    return ", ".join(f"{safe[n]} / {luma} AS {out}_{n}" for n in "rgb")


def logs_sql(prefix: str, out: str) -> str:
    return ", ".join(f"ln(least(greatest({prefix}_{n}, 0.05), 20)) AS {out}_{n}" for n in "rgb")


def limited_sql(source: str, out: str, most: str) -> str:
    """CTEs that end in ``out``: gains k_r, k_g, k_b of ``source`` of unit luma, drawn in to the length ``most``, as lim_r, lim_g, lim_b."""
    return f"""{out}0 AS (SELECT *, {unit_sql('k', 'u')} FROM {source}), {out}1 AS (SELECT *, {logs_sql('u', 'l')} FROM {out}0), {out}2 AS (SELECT *, sqrt(l_r * l_r + l_g * l_g + l_b * l_b) AS size, {most} AS most_ FROM {out}1),
{out}3 AS (SELECT *, {', '.join(f'exp(l_{n} * CASE WHEN size > most_ THEN most_ / greatest(size, 1e-6) ELSE 1 END) AS e_{n}' for n in 'rgb')} FROM {out}2), {out} AS (SELECT *, {unit_sql('e', 'lim')} FROM {out}3)"""


def cast_sql(source: str, p: str) -> str:
    """CTEs that end in ``p``c: the cast of the pixels of ``source`` by frame, with its evidence."""
    names = lambda t: re.sub(r"\bnt(0|1|q|l|n|)\b", rf"{p}nt\1", t)
    return f"""{names(px_sql.neutral_sql(source, px_sql.CAST_CLEAN))},
{p}u AS (SELECT {p}nt.*, CASE WHEN nn >= 16 THEN neutral ELSE clean AND n_clean >= 16 END AS used FROM {p}nt JOIN (SELECT frame_id, count(*) FILTER (neutral) AS nn FROM {p}nt GROUP BY frame_id) USING (frame_id)),
{p}f AS (SELECT frame_id, count(*) AS sampled, count(*) FILTER (used) AS n_used, median(sat) FILTER (used) AS sat_median FROM {p}u GROUP BY frame_id),
{px_sql.trimmed_sql(f'{p}u', f'{p}t', 'used', 0.85, 32, 16, ('(r - luma)', '(g - luma)', '(b - luma)'))},
{p}m AS (SELECT frame_id, {', '.join(f'median({n} - luma) FILTER (used) AS {n}' for n in 'rgb')} FROM {p}t GROUP BY frame_id),
{p}v AS (SELECT frame_id, {', '.join(f'coalesce({n} - {px_sql.LUMA601}, 0) AS c{n}' for n in 'rgb')} FROM {p}m),
{p}c AS (SELECT frame_id, sqrt(cr * cr + cg * cg + cb * cb) AS magnitude, n_used / greatest(sampled, 1)::DOUBLE AS neutral_fraction, n_used AS neutral_pixels, coalesce(sat_median, 0) AS sat_median FROM {p}v JOIN {p}f USING (frame_id))"""


def _candidates_sql() -> str:
    clean = "luma >= 0.06 AND luma <= 0.96 AND lo >= 0.006 AND hi <= 0.992"
    gains = re.sub(r"\bnt(0|1|q|l|n|)\b", r"gnt\1", px_sql.neutral_sql("px", clean))
    step = lambda n: f"round_even(least(greatest({n} * 65535 * cand_{n}, 0), 65535), 0) / 65535 AS {n}"
    return f"""WITH {views.PIXELS}, {views.FRAMES}, ex AS (SELECT frame_id, {', '.join(f'quantile_cont(l, {q / 100}) AS p{q:02d}' for q in (5, 25, 50, 75, 95))}, avg(CASE WHEN l <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) AS shadow_clip, avg(CASE WHEN l >= 0.99 THEN 1.0::DOUBLE ELSE 0 END) AS highlight_clip FROM (SELECT frame_id, {px_sql.LUMA601} AS l FROM px) GROUP BY frame_id),
{cast_sql('px', 'q1')}, {gains}, gu AS (SELECT *, neutral AS used FROM gnt), {px_sql.trimmed_sql('gu', 'gt', 'used', 0.80, 128, 96, ('r', 'g', 'b'))},
gm AS (SELECT frame_id, count(*) FILTER (neutral) AS gn, count(*) AS gp, median(luma) FILTER (used) AS t, {', '.join(f'median({n}) FILTER (used) AS {n}' for n in 'rgb')} FROM gt GROUP BY frame_id),
k AS (SELECT frame_id, magnitude, neutral_fraction, neutral_pixels, sat_median, coalesce(gn >= 96 AND gp >= 64 AND t > 1e-6 AND least(r, g, b) > 1e-6, false) AS has, {', '.join(f't / nullif({n}, 0) AS k_{n}' for n in 'rgb')} FROM q1c JOIN gm USING (frame_id)),
{limited_sql('k', 'li', 'CASE WHEN magnitude >= 0.04 THEN 0.90 ELSE 0.62 END')}, ca AS (SELECT * EXCLUDE (size), {', '.join(f'CASE WHEN has THEN lim_{n} ELSE 1 END AS cand_{n}' for n in 'rgb')} FROM li),
ap AS (SELECT frame_id, {', '.join(step(n) for n in 'rgb')} FROM px JOIN ca USING (frame_id)), {cast_sql('ap', 'q2')}, cl AS (SELECT *, {unit_sql('cand', 'v')} FROM ca), cz AS (SELECT *, {logs_sql('v', 'w')} FROM cl),
sc AS (SELECT cz.*, q2c.magnitude AS raw_after, sqrt(w_r * w_r + w_g * w_g + w_b * w_b) AS gs, 0.35 * least(1, cz.neutral_pixels / 2400.0::DOUBLE) + 0.35 * least(1, cz.neutral_fraction / 0.08) + 0.30 * least(greatest(1 - cz.sat_median / 0.36, 0), 1) AS ev, has AND cz.magnitude > 0.005 AS obvious FROM cz JOIN q2c USING (frame_id)),
sf AS (SELECT *, least(greatest(1 - gs / CASE WHEN magnitude >= 0.04 THEN 0.88 ELSE 0.62 END, 0), 1) AS safety FROM sc), sr AS (SELECT *, CASE WHEN obvious THEN 0.55 * least(greatest((magnitude - raw_after) / greatest(magnitude, 1e-6), 0), 1) + 0.25 * ev + 0.20 * safety ELSE 0 END AS raw FROM sf),
st AS (SELECT *, round_even(raw, 4) AS score, round_even(CASE WHEN obvious THEN raw * ev * (0.35 + 0.65 * safety) ELSE 0 END, 3) AS trust, round_even(raw_after, 5) AS aft FROM sr),
va AS (SELECT *, trust >= 0.18 AND score >= 0.12 AND aft < magnitude AS valid FROM st), ac_ AS (SELECT *, valid AND trust >= 0.24 AND score >= 0.18 AND aft <= greatest(magnitude * 0.97, magnitude - 0.0025) AS yes FROM va),
j AS (SELECT ac_.*, ex.* EXCLUDE (frame_id), roll_id, CASE WHEN shadow_clip >= 0.12 OR highlight_clip >= 0.07 OR p50 <= 0.10 OR p95 <= 0.35 OR p50 >= 0.90 OR p95 >= 0.992 OR p75 - p25 <= 0.045 THEN 'extreme protected' WHEN p50 <= 0.18 OR (p50 <= 0.22 AND p95 <= 0.68) THEN 'low-light salvageable' ELSE 'normal' END AS exposure_class,
  NOT (shadow_clip >= 0.10 OR highlight_clip >= 0.06 OR p50 <= 0.10 OR p50 >= 0.88 OR p95 <= 0.35 OR p95 >= 0.992 OR p75 - p25 <= 0.045) AS usable FROM ac_ JOIN ex USING (frame_id) JOIN fr USING (frame_id)),
x AS (SELECT *, CASE WHEN NOT yes THEN 'unreliable correction' WHEN neutral_fraction < 0.015 THEN 'low neutral evidence' WHEN gs > 0.78 THEN 'large correction' WHEN exposure_class = 'low-light salvageable' THEN 'low-light excluded from baseline' WHEN exposure_class = 'extreme protected' THEN 'extreme exposure' WHEN NOT usable THEN 'exposure outlier' ELSE '' END AS exclusion FROM j)
SELECT frame_id, roll_id, {', '.join(f'round({n}, 8) AS {n}' for n in ('p05', 'p25', 'p50', 'p75', 'p95', 'shadow_clip', 'highlight_clip'))}, exposure_class, usable, round(magnitude, 8) AS "cast", round(neutral_fraction, 8) AS neutral_fraction, neutral_pixels, exclusion, CASE WHEN yes THEN 'neutral_percentile' ELSE 'identity' END AS algorithm,
  {', '.join(f'round(CASE WHEN yes THEN cand_{n} ELSE 1 END, 8) AS frame_{n}' for n in 'rgb')}, round(CASE WHEN yes THEN trust ELSE 0 END, 5) AS confidence, round_even(CASE WHEN yes THEN score WHEN valid THEN trust ELSE 0 END, 3) AS agreement, CASE WHEN yes THEN aft ELSE round_even(magnitude, 5) END AS after, yes AND exclusion = '' AS used FROM x"""


@query("frame_candidates", _candidates_sql())
def frame_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll.rounded(roll.frame_work(*with_rolls(spark, sf_dir)), 8)


def _baseline_sql() -> str:
    whole = re.sub(r", 8\)", ", 15)", _candidates_sql())
    wm = lambda n, source: f"(SELECT roll_id, min({n}) AS {n} FROM (SELECT roll_id, {n}, sum(w) OVER (PARTITION BY roll_id ORDER BY {n} RANGE UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY roll_id) AS total FROM {source}) WHERE upto >= total * 0.5 GROUP BY roll_id)"
    centre = lambda source: f"SELECT roll_id, l_r AS c_r, l_g AS c_g, l_b AS c_b FROM {wm('l_r', source)} JOIN {wm('l_g', source)} USING (roll_id) JOIN {wm('l_b', source)} USING (roll_id)"
    away = lambda p, q: "sqrt(" + " + ".join(f"({p}_{n} - {q}_{n}) * ({p}_{n} - {q}_{n})" for n in "rgb") + ")"
    return f"""WITH fc AS ({whole}), f0 AS (SELECT *, {unit_sql('frame', 'u')} FROM fc WHERE used), us AS (SELECT *, {logs_sql('u', 'l')}, greatest(0.01, confidence) AS w FROM f0),
nr AS (SELECT a.roll_id, a.frame_id AS ap, b.frame_id, b.w, sqrt({' + '.join(f'(a.l_{n} - b.l_{n}) ** 2' for n in 'rgb')}) AS d FROM us a JOIN us b USING (roll_id)),
sc AS (SELECT roll_id, ap, round(sum(w), 12) AS w, count(*) AS n, round(sum(d * w) / sum(w), 12) AS sp FROM nr WHERE d <= 0.20 GROUP BY roll_id, ap HAVING count(*) >= 2), bs AS (SELECT roll_id, ap, n FROM sc QUALIFY row_number() OVER (PARTITION BY roll_id ORDER BY w DESC, n DESC, sp, ap) = 1),
tt AS (SELECT roll_id, count(*) AS n_used FROM us GROUP BY roll_id),
cl AS (SELECT us.*, n_used, CASE WHEN n_used > 2 AND n IS NOT NULL AND n >= greatest(2, ceil(n_used * 0.25)) THEN d <= 0.20 ELSE true END AS inside FROM us JOIN tt USING (roll_id) LEFT JOIN bs USING (roll_id) LEFT JOIN nr ON nr.roll_id = us.roll_id AND nr.ap = bs.ap AND nr.frame_id = us.frame_id),
ci AS (SELECT * FROM cl WHERE inside), c1 AS ({centre('ci')}), dd AS (SELECT cl.*, {away('l', 'c')} AS d FROM cl JOIN c1 USING (roll_id)), md AS (SELECT roll_id, median(d) FILTER (inside) AS md FROM dd GROUP BY roll_id),
ma AS (SELECT roll_id, md, median(abs(d - md)) FILTER (inside) AS mad FROM dd JOIN md USING (roll_id) GROUP BY roll_id, md), k0 AS (SELECT dd.*, inside AND d <= greatest(0.16, md + 2.5 * greatest(mad, 0.018)) AS ok FROM dd JOIN ma USING (roll_id)),
kp AS (SELECT * FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY roll_id) AS nk FROM k0) WHERE ok OR nk < 2), c2 AS ({centre('kp')}),
sp AS (SELECT roll_id, sum({away('l', 'c')} * w) / sum(w) AS spread, count(*) AS n, any_value(n_used) AS n_used, max(confidence) AS only_, string_agg(frame_id, ',' ORDER BY frame_id) AS kept_frames, {', '.join(f'exp(any_value(c_{n})) AS k_{n}' for n in 'rgb')} FROM kp JOIN c2 USING (roll_id) GROUP BY roll_id),
s1 AS (SELECT *, {unit_sql('k', 'roll')} FROM sp), an AS (SELECT roll_id, count(*) AS analysed FROM fc GROUP BY roll_id),
eb AS (SELECT fc.roll_id, fc.frame_id, round(fc.p50, 5) AS p50, round(fc.p95, 5) AS p95, kp.frame_id IS NOT NULL AS mine FROM fc LEFT JOIN kp USING (frame_id) WHERE fc.exposure_class = 'normal'),
eg AS (SELECT *, count(*) FILTER (mine) OVER (PARTITION BY roll_id) >= 3 AS enough FROM eb WHERE p50 > 0.10 AND p50 < 0.88 AND p95 > 0.35 AND p95 < 0.985), et AS (SELECT roll_id, median(p50) AS t50, median(p95) AS t95 FROM eg WHERE mine OR NOT enough GROUP BY roll_id),
ax0 AS (SELECT roll_id, {unit_sql('roll', 'v')} FROM s1), ax AS (SELECT roll_id, {logs_sql('v', 'a')} FROM ax0),
cf AS (SELECT kp.roll_id, sqrt(l_r * l_r + l_g * l_g + l_b * l_b) AS size, sqrt(a_r * a_r + a_g * a_g + a_b * a_b) AS rs_, l_r * a_r + l_g * a_g + l_b * a_b AS dot FROM kp JOIN ax USING (roll_id) WHERE confidence >= 0.30 AND exposure_class = 'normal'),
cg AS (SELECT *, dot / greatest(size * rs_, 1e-6) AS co FROM cf),
ch AS (SELECT roll_id, count(*) AS n, count(*) FILTER (size >= 0.025) AS told, count(*) FILTER (size >= 0.025 AND co >= 0.35) AS agree, median(co) FILTER (size >= 0.025 AND co >= 0.35) AS mid, any_value(rs_) AS rs_ FROM cg GROUP BY roll_id),
cs AS (SELECT *, agree / greatest(told, 1)::DOUBLE AS share FROM ch), ct AS (SELECT *, 1 + least(0.18, (share - 0.60) * 0.28 + least(0.08, rs_ * 0.45)) AS st FROM cs),
cu AS (SELECT roll_id, CASE WHEN rs_ >= 0.035 AND n >= 5 AND told >= 5 AND agree >= greatest(5, ceil(told * 0.60)) AND share >= 0.62 AND mid >= 0.65 AND st >= 1.055 THEN round_even(st, 3) ELSE 1 END AS strength FROM ct),
o AS (SELECT an.roll_id, analysed, {', '.join(f'coalesce(roll_{n}, 1) AS roll_{n}' for n in 'rgb')}, coalesce(n, 0) AS used_count, coalesce(kept_frames, '') AS kept_frames, coalesce(n_used >= 2, false) AS several,
  round_even(coalesce(CASE WHEN coalesce(n_used >= 2, false) THEN 0.35 * least(1, n / 8.0::DOUBLE) + 0.30 * least(1, n / analysed::DOUBLE / 0.55) + 0.35 * least(greatest(1 - spread / 0.18, 0), 1) ELSE only_ * 0.45 END, 0), 3) AS confidence FROM an LEFT JOIN s1 USING (roll_id))
SELECT roll_id, {', '.join(f'round(roll_{n}, 5) AS roll_{n}' for n in 'rgb')}, round(coalesce(t50, 0.38), 6) AS target_p50, round(coalesce(t95, 0.86), 6) AS target_p95, round(coalesce(strength, 1), 5) AS strength, confidence, analysed, used_count,
  CASE WHEN NOT several THEN 'not enough reliable frames for roll baseline' WHEN confidence >= 0.45 THEN '' ELSE 'low roll confidence' END AS warning, kept_frames FROM o LEFT JOIN et USING (roll_id) LEFT JOIN cu USING (roll_id)"""


@query("roll_baseline", _baseline_sql())
def roll_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = roll.settled(roll.frame_work(*with_rolls(spark, sf_dir)))
    b = roll.baseline(work)
    b = b.withColumns({"kept_frames": F.array_join(F.col("kept_frames").cast("array<string>"), ","), "target_p50": F.round("target_p50", 6), "target_p95": F.round("target_p95", 6)})
    return b.withColumns({n: F.round(n, 5) for n in ("roll_r", "roll_g", "roll_b", "strength")})


@query("roll_plan")
def roll_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, fr = with_rolls(spark, sf_dir)
    work = roll.settled(roll.frame_work(px, fr))
    return roll.rounded(roll.frame_plans(px, work, roll.settled(roll.baseline(work))))


@query("roll_summary")
def roll_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, fr = with_rolls(spark, sf_dir)
    work = roll.settled(roll.frame_work(px, fr))
    return roll.summary(roll.frame_plans(px, work, roll.settled(roll.baseline(work))))


@query(
    "tone_residuals",
    f"""WITH {views.PIXELS}, bd AS (SELECT unnest(['shadow', 'mid', 'highlight']) AS band, unnest([0.08, 0.25, 0.58]) AS low, unnest([0.38, 0.72, 0.93]) AS high, unnest([0.055, 0.105, 0.050])::DOUBLE AS most),
pb AS (SELECT frame_id, band, most, r, g, b FROM px JOIN bd ON {px_sql.LUMA601} >= low AND {px_sql.LUMA601} <= high), {px_sql.neutral_sql('pb', 'luma >= 0.04 AND luma <= 0.97 AND lo >= 0.004 AND hi <= 0.992', 'frame_id, band')},
m AS (SELECT frame_id, band, any_value(most) AS most, count(*) AS al, count(*) FILTER (neutral) AS n, median(luma) FILTER (neutral) AS t, median(sat) FILTER (neutral) AS sat, {', '.join(f'median({n}) FILTER (neutral) AS {n}' for n in 'rgb')} FROM nt GROUP BY frame_id, band),
k AS (SELECT *, coalesce(al >= 96 AND n >= 64 AND t > 1e-6 AND least(r, g, b) > 1e-6, false) AS good, {', '.join(f't / greatest({n}, 1e-6) AS k_{n}' for n in 'rgb')} FROM m), {limited_sql('k', 'li', 'most')}
SELECT frame_id, band, {', '.join(f'round(CASE WHEN good THEN lim_{n} ELSE 1 END, 5) AS gain_{n}' for n in 'rgb')}, round(CASE WHEN good THEN 0.35 * least(1, n / 1600.0::DOUBLE) + 0.35 * least(1, n / al::DOUBLE / 0.10) + 0.30 * least(greatest(1 - sat / 0.32, 0), 1) ELSE 0 END, 5) AS confidence FROM li""",
)
def tone_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll.rounded(roll.tone_residuals(views.pixels(spark, sf_dir)))


@query(
    "exposure_targets",
    f"""WITH {views.PIXELS}, {views.FRAMES}, st AS (SELECT frame_id, round(quantile_cont(l, 0.5), 5) p50, round(quantile_cont(l, 0.95), 5) p95 FROM (SELECT frame_id, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS l FROM px) GROUP BY frame_id)
SELECT roll_id, round(coalesce(median(p50), 0.38), 6) AS target_p50, round(coalesce(median(p95), 0.86), 6) AS target_p95, count(*) AS frames FROM st JOIN fr USING (frame_id) WHERE p50 > 0.10 AND p50 < 0.88 AND p95 > 0.35 AND p95 < 0.985 GROUP BY roll_id""",
)
def exposure_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, fr = with_rolls(spark, sf_dir)
    e = stats.exposure_metrics(px, ["frame_id"]).join(fr, "frame_id").select("roll_id", F.round("p50", 5).alias("p50"), F.round("p95", 5).alias("p95"))
    good = e.filter("p50 > 0.10 and p50 < 0.88 and p95 > 0.35 and p95 < 0.985")
    return good.groupBy("roll_id").agg(F.round(F.coalesce(F.median("p50"), F.lit(0.38)), 6).alias("target_p50"), F.round(F.coalesce(F.median("p95"), F.lit(0.86)), 6).alias("target_p95"), F.count(F.lit(1)).alias("frames"))


def fit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and what a known mixture makes of them, with a small bend."""
    p = c.rgb()
    q = c.matrix_mix(p, ((0.9, 0.05, 0.02), (0.04, 0.92, 0.03), (0.06, 0.03, 0.95)), 1.0)
    out = {f"t{n}": c.unit(x * 0.9 + 0.03 + 0.05 * p.g * p.g) for n, x in zip("rgb", q, strict=True)}
    return views.pixels(spark, sf_dir).withColumns(out)


def matrix_rows(spark: SparkSession, m) -> DataFrame:
    return spark.createDataFrame([(i, *(round(float(v), 5) for v in row)) for i, row in enumerate(m)], "i int, r double, g double, b double")


@query("colour_matrix_fit")
def colour_matrix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_rows(spark, fits.colour_matrix(fit_pairs(spark, sf_dir), ["r", "g", "b"], ["tr", "tg", "tb"]))


PAIRS_SQL = f"""{views.PIXELS}, mx AS (SELECT *, r * 0.9::DOUBLE + g * 0.04::DOUBLE + b * 0.06::DOUBLE AS mr, r * 0.05::DOUBLE + g * 0.92::DOUBLE + b * 0.03::DOUBLE AS mg, r * 0.02::DOUBLE + g * 0.03::DOUBLE + b * 0.95::DOUBLE AS mb FROM px),
fp AS (SELECT frame_id, r, g, b, {', '.join(f'least(greatest(m{n} * 0.9::DOUBLE + 0.03::DOUBLE + 0.05::DOUBLE * g * g, 0), 1) AS t{n}' for n in 'rgb')} FROM mx)"""


def _camera_fit_sql() -> str:
    """Normal equations of three unknowns, solved by determinants."""
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    sums = ", ".join([f"sum({a} * {b}) AS {a}{b}" for i, a in enumerate("rgb") for b in "rgb"[i:]] + [f"sum({a} * t{b}) AS {a}_{b}" for a in "rgb" for b in "rgb"])
    whole = [["".join(sorted((a, b), key="rgb".index)) for b in "rgb"] for a in "rgb"]
    rows = []
    for i in range(3):  # row i: what source channel i gives to each target
        cells = [f"round({det([[f'{a}_{t}' if j == i else whole[k][j] for j in range(3)] for k, a in enumerate('rgb')])} / {det(whole)}, 5) AS {t}" for t in "rgb"]
        rows.append(f"SELECT CAST({i} AS INTEGER) AS i, {', '.join(cells)} FROM su")
    clear = " AND ".join(f"{n} > 0.005 AND {n} < 0.98" for n in ("r", "g", "b", "tr", "tg", "tb"))
    return f"WITH {PAIRS_SQL}, su AS (SELECT {sums} FROM fp WHERE {clear}) " + " UNION ALL ".join(rows)


@query("camera_matrix_fit", _camera_fit_sql())
def camera_matrix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_rows(spark, fits.camera_matrix(fit_pairs(spark, sf_dir), ["r", "g", "b"], ["tr", "tg", "tb"]))


@query("density_matrix_fit")
def density_matrix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fit_pairs(spark, sf_dir).select(*(c.density(F.col(n)).alias(n) for n in ("r", "g", "b", "tr", "tg", "tb")))
    return matrix_rows(spark, fits.density_matrix(d, ["r", "g", "b"], ["tr", "tg", "tb"]))


@query(
    "channel_gain_fit",
    f"""WITH {views.PIXELS}, t AS (SELECT frame_id, unnest([0, 1, 2]) AS ch, unnest([r, g, b]) AS s, unnest([least(r * 1.1, 1), least(g * 0.95, 1), least(b * 1.02, 1)]) AS d FROM px)
SELECT frame_id, ch, CASE WHEN count(*) FILTER (s > 0.015 AND s < 0.985 AND d > 0 AND d < 1) >= 32 THEN round(sum(s * d) FILTER (s > 0.015 AND s < 0.985 AND d > 0 AND d < 1) / sum(s * s) FILTER (s > 0.015 AND s < 0.985 AND d > 0 AND d < 1), 6)
  WHEN count(*) FILTER (s > 0.015) >= 32 THEN round(sum(s * d) FILTER (s > 0.015) / sum(s * s) FILTER (s > 0.015), 6) ELSE 1.0 END AS gain FROM t GROUP BY frame_id, ch""",
)
def channel_gain_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    pairs = F.array(*(F.struct(F.lit(i).alias("ch"), F.col(n).alias("s"), F.least(F.col(n) * k, F.lit(1.0)).alias("d")) for i, (n, k) in enumerate((("r", 1.1), ("g", 0.95), ("b", 1.02)))))
    e = px.select("frame_id", F.inline(pairs))
    return fits.gains_through_origin(e, ["frame_id", "ch"], "s", "d").withColumn("gain", F.round("gain", 6))
