"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, embed_dedup, fingerprint, language, mixing, near_dedup, quality, resample, secret_scan, spelling, suffix_dedup, url_rules
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_draws(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can express."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents")).filter("pass = 0")
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), without=("text", "source"))
    return out.select("doc_id", F.col("lid_lang").alias("lang"), F.col("lid_text").alias("text_lang"), F.round("lid_posterior", 6).alias("posterior"), F.col("lid_kept").alias("kept"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return out.select("page_id", "declared", "suffix", "host", F.col("lid_lang").alias("lang"), F.col("lid_text").alias("text_lang"), F.round("lid_posterior", 6).alias("posterior"), F.col("lid_kept").alias("kept"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_features(table(spark, sf_dir, "documents"))
    return out.withColumn("seconds", F.round("seconds", 6))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_removed(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.vector_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_source_mix, op2_near_dedup, op3_language_id, op4_url_rules, op5_audio_features, op6_secret_scan, op7_bpe, op8_quality, op9_suffix_dedup, op10_fingerprints, op11_spelling_variants, op12_importance_resample, op13_embedding_dedup)
    return {f.__name__: f for f in own} | {"llm_page_language": page_language, "llm_mix_targets": mix_targets}


#: Sources in the order of what they may take a unit of weight; the first whose fair share is below that sets the level.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS most, sum(source_size) OVER () AS total FROM s),
l AS (SELECT most, (total - coalesce(sum(3 * source_size) OVER (ORDER BY most, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY most, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit,
  row_number() OVER (ORDER BY most, w, source) AS k FROM r)
SELECT doc_id, size, source_size, round(least(3.0::DOUBLE * source_size, w * (SELECT arg_min(unit, k) FROM l WHERE unit <= most)), 6) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.com/en/7' THEN 'allow' WHEN 'net/de/' THEN 'allow' WHEN 'com/en/' THEN 'block' WHEN 'example.net/de/8' THEN 'block' WHEN 'org/es/' THEN 'block'
    ELSE CASE WHEN regexp_matches(host, '(^|[.-])(cheap-pills|spam-farm|casino|payday-loans|replica-watches|torrent|warez|xxx)([.-]|$)') THEN 'block' ELSE 'allow' END END AS verdict
FROM fits
"""


#: All pairs; the hashing finds the same ones but for the stated chance.
OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT a, min(b) AS least_ FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least_, vec_id)) AS component_id, vec_id <= coalesce(least_, vec_id) AS kept FROM v LEFT JOIN l ON l.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_rules": OP4_SQL, "llm_mix_targets": TARGETS_SQL, "op13_embedding_dedup": OP13_SQL}
