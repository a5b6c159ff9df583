"""Queries of side effects, strengths of protection and the ensemble of gains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import effects, regional
from . import views
from .pixel_queries import LUMA601
from .registry import query

CORRECTION = {"r": 0.10, "g": -0.01, "b": -0.06}


def _effects_sql() -> str:
    after = LUMA601.replace("r *", "ar *").replace("g *", "ag *").replace("b *", "ab *")
    tests = (
        "luma BETWEEN 0.62 AND 0.97 AND down <= 0.72 AND b >= r * 1.01 AND b >= g * 0.97 AND sat BETWEEN 0.035 AND 0.32", "g > r * 1.04 AND g > b * 1.08 AND luma >= 0.12 AND sat >= 0.18",
        "r > g * 1.08 AND r > b * 1.15 AND luma >= 0.16 AND sat >= 0.28", "luma BETWEEN 0.025 AND 0.22",
    )
    regions = " UNION ALL ".join(f"SELECT *, {i} AS region FROM e WHERE {t}" for i, t in enumerate(tests))
    med = ", ".join(f"median({n} - luma) AS m{n}, median(a{n} - al) AS n{n}" for n in "rgb")
    noise = ", ".join(f"median(sqrt({' + '.join(f'power({p}{n} - {l} - {m}{n}, 2)' for n in 'rgb')})) AS z{o}" for p, l, m, o in (("", "luma", "m", "b"), ("a", "al", "n", "a")))
    flat = ", ".join(f"m{n} - ml AS f{n}, n{n} - nl AS h{n}" for n in "rgb")
    lim = lambda k: f"[{', '.join(str(r[k]) for r in effects.REGIONS)}][region + 1]::DOUBLE"
    return f"""WITH {views.RASTER}, r4 AS (SELECT frame_id // 4 AS frame_id, y, r, g, b FROM rs), z AS (SELECT frame_id, max(y) AS h, count(*) AS al_ FROM r4 GROUP BY frame_id),
e0 AS (SELECT r4.*, al_, y / greatest(h, 1)::DOUBLE AS down, {LUMA601} AS luma, (greatest(r, g, b) - least(r, g, b)) / greatest(greatest(r, g, b), 1e-6) AS sat, {', '.join(f'least({n} * (1 + frame_id % 5 * {k}::DOUBLE), 1) AS a{n}' for n, k in CORRECTION.items())} FROM r4 JOIN z USING (frame_id) WHERE al_ >= 128),
e AS (SELECT *, {after} AS al FROM e0), m AS ({regions}), md AS (SELECT frame_id, region, count(*) AS n, any_value(al_) AS al_, {med} FROM m GROUP BY frame_id, region),
ns AS (SELECT frame_id, region, {noise} FROM m JOIN md USING (frame_id, region) GROUP BY frame_id, region),
g0 AS (SELECT *, mr * 0.299 + mg * 0.587 + mb * 0.114 AS ml, nr * 0.299 + ng * 0.587 + nb * 0.114 AS nl FROM md JOIN ns USING (frame_id, region) WHERE n >= {lim(4)} AND n / al_::DOUBLE >= {lim(5)}),
g1 AS (SELECT *, {flat} FROM g0), g2 AS (SELECT *, sqrt(fr * fr + fg * fg + fb * fb) AS sb, sqrt(hr * hr + hg * hg + hb * hb) AS sa, sqrt(power(hr - fr, 2) + power(hg - fg, 2) + power(hb - fb, 2)) AS dr, {lim(2)} AS ld, {lim(3)} AS lc FROM g1),
g3 AS (SELECT frame_id, region, CASE WHEN region = 3 THEN CASE WHEN za - zb > 0.018 THEN least(1, (za - zb) / 0.06) ELSE 0 END WHEN sa > sb + lc OR dr > ld THEN least(1, greatest(0, 0.55 * greatest(0, (sa - sb) / greatest(lc * 2.5, 1e-6)) + 0.45 * dr / greatest(ld * 2, 1e-6))) ELSE 0 END AS risk FROM g2),
w AS (SELECT * FROM g3 WHERE risk >= 0.30 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(risk, 9) DESC, region) = 1)
SELECT f.frame_id, round(coalesce(risk, 0), 6) AS risk, coalesce([{', '.join(f"'{r[1]}'" for r in effects.REGIONS)}][region + 1], '') AS warning FROM (SELECT DISTINCT frame_id FROM r4) f LEFT JOIN w USING (frame_id)"""


@query("side_effects", _effects_sql())
def side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of corrections of five strengths; four suppliers make a frame, so that its regions have pixels enough."""
    r = views.raster(spark, sf_dir).withColumn("frame_id", F.floor(F.col("frame_id") / 4))
    r = r.withColumns({f"a{n}": F.least(F.col(n) * (1 + F.col("frame_id") % 5 * k), F.lit(1.0)) for n, k in CORRECTION.items()})
    return effects.side_effects(r).withColumn("risk", F.round("risk", 6))


STRENGTHS = (0.35, 0.50, 0.65, 0.80, 0.92, 1.0)


@query(
    "protection_strength",
    f"""WITH RECURSIVE t AS (SELECT p_partkey // 6 AS frame_id, p_partkey % 6 AS pos, {list(STRENGTHS)}[p_partkey % 6 + 1]::DOUBLE AS strength, (p_partkey // 6 % 7 + 1) / 50.0::DOUBLE AS before, (p_partkey * 13 % 29) / 90.0::DOUBLE AS after, ['', 'green', 'green', 'dark'][p_partkey * 7 % 11 % 4 + 1] AS warning FROM part),
f AS (SELECT *, warning = '' AND after <= before + greatest(0.003, before * 0.08) AS fine, row_number() OVER (PARTITION BY frame_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM t),
w AS (SELECT frame_id, k, n, strength, after, warning, fine FROM f WHERE k = 1 UNION ALL SELECT f.frame_id, f.k, f.n, CASE WHEN u.s THEN f.strength ELSE u.strength END, CASE WHEN u.s THEN f.after ELSE u.after END, CASE WHEN u.s THEN f.warning ELSE u.warning END, CASE WHEN u.s THEN f.fine ELSE u.fine END
  FROM (SELECT w.*, x.k AS k2, NOT w.fine AND (x.fine OR (x.warning = '' AND w.warning <> '') OR (x.warning = w.warning AND x.after < w.after)) AS s FROM w JOIN f x ON x.frame_id = w.frame_id AND x.k = w.k + 1) u JOIN f ON f.frame_id = u.frame_id AND f.k = u.k2)
SELECT frame_id, strength, round(after, 6) AS after, warning FROM w WHERE k = n""",
)
def protection_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))
    d = views.table(spark, sf_dir, "part").select(
        F.floor(k / 6).alias("frame_id"), (k % 6).alias("pos"), pick(STRENGTHS, k % 6).alias("strength"), ((F.floor(k / 6) % 7 + 1) / 50.0).alias("before"), (k * 13 % 29 / 90.0).alias("after"), pick(("", "green", "green", "dark"), k * 7 % 11 % 4).alias("warning"),
    )
    return effects.chosen_strength(d).withColumn("after", F.round("after", 6))


ALGORITHMS = ("identity", "grey", "neutral", "regional", "edge", "bright")


def _ensemble_sql() -> str:
    wm = lambda n: f"(SELECT frame_id, min({n}) AS {n} FROM (SELECT frame_id, {n}, sum(w) OVER (PARTITION BY frame_id ORDER BY {n} RANGE UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY frame_id) AS total FROM kp) WHERE upto >= total * 0.5 GROUP BY frame_id)"
    luma = "(exp(cr) * 0.299::DOUBLE + exp(cg) * 0.587::DOUBLE + exp(cb) * 0.114::DOUBLE)"
    return f"""WITH ca AS (SELECT vec_id // 6 AS frame_id, vec_id % 6 AS pos, {list(ALGORITHMS)}[vec_id % 6 + 1] AS algorithm, {', '.join(f'exp(0.5 * embedding[{i + 1}]::DOUBLE) AS g{n}' for i, n in enumerate('rgb'))}, least(1, abs(embedding[4]::DOUBLE) * 4) AS confidence, least(1, abs(embedding[5]::DOUBLE) * 4) AS score, abs(embedding[6]::DOUBLE) * 0.3 AS after, CASE WHEN vec_id % 5 = 0 THEN 'weak' ELSE '' END AS warning FROM embeddings),
va AS (SELECT frame_id, pos, algorithm, confidence, score, warning, gr, gg, gb, {', '.join(f'ln(least(greatest(g{n}, 0.05), 20)) AS {n}' for n in 'rgb')}, greatest(0.01, confidence) * greatest(0.01, score) AS w FROM ca WHERE algorithm <> 'identity' AND confidence >= 0.18 AND score >= 0.12 AND after < 0.06),
nr AS (SELECT a.frame_id, a.pos AS ap, b.pos, b.w, sqrt((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) AS d FROM va a JOIN va b ON a.frame_id = b.frame_id),
sc AS (SELECT frame_id, ap, round(sum(w), 12) AS w, count(*) AS n, round(sum(d * w) / sum(w), 12) AS sp FROM nr WHERE d <= 0.20 GROUP BY frame_id, ap HAVING count(*) >= 2),
bs AS (SELECT frame_id, ap, n FROM sc QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY w DESC, n DESC, sp, ap) = 1), tt AS (SELECT frame_id, count(*) AS t FROM va GROUP BY frame_id),
kp AS (SELECT va.* FROM va JOIN tt USING (frame_id) LEFT JOIN bs USING (frame_id) LEFT JOIN nr ON nr.frame_id = va.frame_id AND nr.ap = bs.ap AND nr.pos = va.pos WHERE CASE WHEN t > 2 AND n IS NOT NULL AND n >= greatest(2, ceil(t * 0.25)) THEN d <= 0.20 ELSE true END),
ce AS (SELECT frame_id, r AS cr, g AS cg, b AS cb FROM {wm('r')} JOIN {wm('g')} USING (frame_id) JOIN {wm('b')} USING (frame_id)),
st AS (SELECT frame_id, count(*) AS k, string_agg(algorithm, '+' ORDER BY pos) AS names, sum(sqrt((r - cr) ** 2 + (g - cg) ** 2 + (b - cb) ** 2) * w) / sum(w) AS sp, sum(confidence * w) / sum(w) AS tr, any_value(cr) AS cr, any_value(cg) AS cg, any_value(cb) AS cb, any_value(score) AS score, any_value(warning) AS warning, {', '.join(f'any_value(g{n}) AS g{n}' for n in 'rgb')} FROM kp JOIN ce USING (frame_id) GROUP BY frame_id),
bw AS (SELECT frame_id, warning AS bw FROM ca QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, pos) = 1),
al AS (SELECT bw.frame_id, bw, coalesce(t, 0) AS t, coalesce(k, 0) AS k, names, tr, score, warning, gr, gg, gb, least(1, greatest(0, 1 - sp / 0.22)) AS ag, least(1, k / 3.0::DOUBLE) AS nu, {', '.join(f'exp(c{n}) / {luma} AS e{n}' for n in 'rgb')} FROM bw LEFT JOIN tt USING (frame_id) LEFT JOIN st USING (frame_id))
SELECT frame_id, CASE WHEN t = 0 THEN 'identity' WHEN k >= 2 THEN 'ensemble(' || names || ')' ELSE names END AS algorithm, {', '.join(f'round(CASE WHEN t = 0 THEN 1 WHEN t = 1 THEN g{n} ELSE e{n} END, 6) AS gain_{n}' for n in 'rgb')},
  round(CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN score ELSE round_even(ag * nu, 4) END, 4) AS score, round(CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN tr ELSE round_even(tr * (0.55 + 0.45 * ag) * (0.75 + 0.25 * nu), 3) END, 3) AS confidence,
  CASE WHEN t = 0 THEN coalesce(nullif(bw, ''), 'no candidate consensus') WHEN t = 1 THEN warning WHEN k >= 2 THEN '' ELSE 'single candidate cluster' END AS warning, k AS counted FROM al"""


@query("ensemble_gains", _ensemble_sql())
def ensemble_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six made-up candidates a frame, the first of them identity."""
    v = F.col("vec_id")
    e = lambda i: F.element_at("embedding", i).cast("double")
    d = views.table(spark, sf_dir, "embeddings").select(
        F.floor(v / 6).alias("frame_id"), (v % 6).alias("pos"), F.get(F.array(*(F.lit(a) for a in ALGORITHMS)), (v % 6).cast("int")).alias("algorithm"), *(F.exp(0.5 * e(i + 1)).alias(f"gain_{n}") for i, n in enumerate("rgb")),
        F.least(F.lit(1.0), F.abs(e(4)) * 4).alias("confidence"), F.least(F.lit(1.0), F.abs(e(5)) * 4).alias("score"), (F.abs(e(6)) * 0.3).alias("after"), F.when(v % 5 == 0, "weak").otherwise("").alias("warning"), F.lit(0.06).alias("before"),
    )
    out = regional.ensemble(d)
    places = {**{f"gain_{n}": 6 for n in "rgb"}, "score": 4, "confidence": 3}
    return out.withColumns({n: F.round(n, k) for n, k in places.items()})
