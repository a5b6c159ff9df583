"""A corpus pipeline: language ID, near-dedup, secret scan, source mix, BPE.

Each stage works on the whole table that the one before it kept, and all but the last return the columns of ``documents``.
More columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsion.llm import bpe, language, mixing, near_dedup, secret_scan
from emulsion.llm.common import settle, table
from emulsion.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay, with that language as lang; those without words or a likely language go.

    A null text has no words. A null lang or source is no evidence. Repeated rows are judged alike; an empty table stays empty.
    """
    kept = language.identify_documents(docs).filter("lid_kept").withColumn("lang", F.col("lid_lang"))
    return kept.select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): that of the least doc_id.

    Rows alike in doc_id and text are one. Texts without words are alike with nothing and stay. Of a group with null ids only,
    all its different texts stay.
    """
    return near_dedup.near_dedup(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark. A null text stays null, and n_chars follows the text."""
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' targets: some not at all, some up to three times, the last of a source cut short.

    The rows are written in the order of the draws: each file holds chunks of output shards, by shard and place. Null sources are
    a source; a null or empty text isn't drawn; an empty table stays empty; repeated rows are drawn each on its own.
    """
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each drawn document; a null or empty text has no ids."""
    return bpe.encode_decode(docs, tokenizer_path(), with_ids=True)


STAGES = [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("secret_redaction", secret_redaction), ("source_mix", source_mix), ("bpe", tokens)]
#: The trained models and the draws of the mix can't be written in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
