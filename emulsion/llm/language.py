"""Language identification by Bayesian evidence fusion.

Text likelihoods come from byte trigrams. To them are added, in logarithms: how often a text of a language declares the
language it does (markup attribute), how often its address has the suffix it has, and the share of each language among the
host's texts. Host shares are smoothed towards those of the parent domain, and these towards all texts. All tables but the
trigram model are grouped counts over every row, by the language that the text alone suggests.

A text is rejected where the best language isn't likely enough, and where it is no language of the model at all: where an
even distribution of trigrams explains it better than the best language, by ``LEAST_FIT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, settle
from .grams import SIZE, trigram_codes

#: Labelled rows of each language, in expectation, that its model is fitted on.
SAMPLE = 4000
#: Shares of the mean of all languages and of an even distribution in a language's model.
MEAN_SHARE, EVEN_SHARE = 0.08, 0.02
#: Strength of the prior of a host, a domain and the counts of declared languages and suffixes, in texts.
HOST_PRIOR, DOMAIN_PRIOR, TABLE_PRIOR = 20.0, 50.0, 1.0
#: A text's likelihood counts as that of so many independent trigrams at most: neighbours overlap, and long texts aren't surer.
MOST_GRAMS = 400
#: A text whose log-likelihood, counted so, is below that of evenly distributed trigrams by more than this is of no known language.
LEAST_FIT = 20.0
#: Trigrams looked up at once.
CHUNK = 1 << 18
#: Languages whose models are held at once: a broadcast of 1 MB each. Texts of more languages are scored a block after the other.
BLOCK = 64


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            code, n = np.unique(trigram_codes(text.as_py()), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["lang", "code", "n"])


@dataclass
class Model:
    """Trigram models of any number of languages: a table with a row (lang, codes, n) for each, and the mean of all."""

    langs: list[str]
    counts: DataFrame | None
    mean: np.ndarray

    def blocks(self) -> Iterator[np.ndarray]:
        """(SIZE, languages) log-probabilities of ``BLOCK`` languages after the other; only one block comes to the driver at once."""
        for first in range(0, len(self.langs), BLOCK):
            names = self.langs[first : first + BLOCK]
            at = {x: i for i, x in enumerate(names)}
            own = np.zeros((SIZE, len(names)), np.float32)
            got = self.counts.filter((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).toArrow()
            for lang, codes, n in zip(*got.columns, strict=True):
                share = n.values.to_numpy()
                own[codes.values.to_numpy(), at[lang.as_py()]] = share / share.sum()
            own *= 1 - MEAN_SHARE - EVEN_SHARE
            own += (MEAN_SHARE * self.mean + EVEN_SHARE / SIZE)[:, None].astype(np.float32)
            yield np.log(own, out=own)


def fit_model(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> Model:
    """The model of each language in ``label``, from about ``sample`` rows of each drawn by a hash.

    The languages are those of a grouped count over all rows, and the rate of a draw is the language's own, so each labelled
    language has a model at every size; of one with ``sample`` rows or fewer all are drawn. Only rows with a letter count. Each
    distribution is mixed in fixed shares with the mean of all languages and an even one: a language of few rows isn't
    smoothed more than one of many. The names of the languages and the mean, a number for each of SIZE trigrams, come to the
    driver.
    """
    known = docs.filter(F.col(label).isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col(label).alias("lang"), "text", F.xxhash64("doc_id", label, "text").alias("_hash"))
    rates = settle(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_least")), "language-rates")
    # the least hash is there for languages whose rows are all equal, which a draw could miss as one
    drawn = known.join(rates, "lang").filter((F.pmod("_hash", F.col("_n")) < sample) | (F.col("_hash") == F.col("_least"))).select("lang", "text")
    grams = settle(bounded_batches(drawn).mapInArrow(_gram_counts, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "language-grams")
    held = grams.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("x"))  # at most SIZE entries each
    held = settle(held.select("lang", F.col("x.code").alias("codes"), F.col("x.n").alias("n")), "language-models")
    langs = sorted(r["lang"] for r in held.select("lang").collect())
    share = held.select(F.explode(F.arrays_zip("codes", F.transform("n", lambda x: x / F.aggregate("n", F.lit(0).cast("long"), lambda a, y: a + y)).alias("share"))).alias("x"))
    got = share.groupBy("x.codes").agg(F.sum("x.share").alias("share")).toArrow()
    mean = np.zeros(SIZE)
    mean[got.column(0).to_numpy()] = got.column(1).to_numpy() / max(1, len(langs))
    discard(rates, grams)
    return Model(langs, held, mean)


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their (SIZE, languages) log-probabilities in one matrix; for models of few languages."""
    model = fit_model(docs, label, sample)
    return model.langs, np.hstack(list(model.blocks())) if model.langs else np.zeros((SIZE, 1), np.float32)


def text_evidence(docs: DataFrame, table: np.ndarray):
    """A pandas UDF: log-likelihoods of a text by language of ``table``, and last that of even trigrams; all 0 without text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        t, out = shared.value, []
        for text in texts:
            codes = trigram_codes(text) if text and not text.isspace() else np.zeros(0, np.int32)
            weight = min(1.0, MOST_GRAMS / max(1, len(codes)))
            ll = sum((t[codes[i : i + CHUNK]].sum(axis=0, dtype=np.float64) for i in range(0, len(codes), CHUNK)), np.zeros(t.shape[1])) * weight
            out.append([*ll.tolist(), -weight * len(codes) * np.log(SIZE)])
        return pd.Series(out)

    return evidence.asNondeterministic()  # else a filter on its result is pushed down with a second call of it


def parent_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def _shares(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """Counts by language as an array in the order of ``langs``, for each key."""
    by = counts.groupBy(key, "best").agg(F.sum("n").cast("double").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("of"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.coalesce(F.element_at("of", i), F.lit(0.0))).alias(f"{key}_counts"))


def identify(
    docs: DataFrame, langs: list[str], table: np.ndarray | Model, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None,
    least: float = 0.5, without: tuple[str, ...] = (),
) -> DataFrame:
    """``docs`` plus lid_lang, lid_posterior, lid_text (the text's own best), lid_fit and lid_kept; one row out for each row in.

    A piece of evidence that is null or not given says nothing. A text that is null, empty or white space has no evidence of
    its own, and isn't kept; nor is one whose best posterior is below ``least``, or whose lid_fit (log-likelihood of the best
    language above that of even trigrams) is below -``LEAST_FIT``. Ties go to the first language by name. With no languages
    (nothing was labelled) lid_lang is null and nothing is kept. Columns of those names in ``docs`` are replaced, others stay as
    they are, but for those named in ``without``, which are left out. ``table`` is what ``fit`` or ``fit_model`` gave; a Model
    may have any number of languages: those after the first block are scored in further passes over the texts, each a table in
    the shared folder.
    """
    new = {"lid_lang": "string", "lid_posterior": "double", "lid_text": "string", "lid_fit": "double", "lid_kept": "boolean"}
    docs = bounded_batches(docs.drop(*new))
    stay = [c for c in docs.columns if c not in without]
    if not langs:
        return docs.select(*stay, *((F.lit(False) if n == "lid_kept" else F.lit(None).cast(t)).alias(n) for n, t in new.items()))
    nothing = F.lit(None).cast("string")
    blocks = iter([table]) if isinstance(table, np.ndarray) else table.blocks()
    has_text = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.select(
        F.struct(*stay).alias("_row"), has_text.alias("_has_text"), (F.lower(F.substring_index(declared, "-", 1)) if declared is not None else nothing).alias("_declared"),
        (F.lower(suffix) if suffix is not None else nothing).alias("_suffix"), (host if host is not None else nothing).alias("_host"), F.col("text").alias("_text"), text_evidence(docs, next(blocks))("text").alias("_said"),
    )
    for k, block in enumerate(blocks):
        one = settle(marked, "language-block")
        even = F.slice("_said", -1, 1)
        marked = one.withColumn("_more", text_evidence(docs, block)("_text")).withColumn("_said", F.concat(F.slice("_said", 1, (k + 1) * BLOCK), F.slice("_more", 1, block.shape[1]), even)).drop("_more")
    top = F.array_max(F.slice("_said", 1, len(langs)))
    marked = marked.withColumn("_top", top).withColumns({"_ll": F.transform(F.slice("_said", 1, len(langs)), lambda x: F.round(x - F.col("_top"), 9)), "_fit": F.col("_top") - F.element_at("_said", -1), "_domain": parent_of(F.col("_host"))})
    marked = marked.drop("_said", "_text", "_top")
    if "text" in without:  # else the table would be as large as the texts; they are scored once more instead
        marked = settle(marked, "language-evidence")
    best = F.array_position("_ll", 0.0) - 1
    told = marked.filter(F.aggregate("_ll", F.lit(0.0), lambda a, x: a + x) < 0)
    counts = settle(told.select(best.cast("int").alias("best"), *(f"_{k}" for k in ("declared", "suffix", "host", "domain"))).groupBy("_declared", "_suffix", "_host", "_domain", "best").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    totals = {r["best"]: r["n"] for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    every = sum(totals.values())
    overall = [(totals.get(i, 0) + 1) / (every + len(langs)) for i in range(len(langs))]
    whole, language_total = F.lit(overall), F.lit([float(totals.get(i, 0)) for i in range(len(langs))])

    def towards(own: Column, prior: Column, weight: float) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, prior, lambda x, p: (x + weight * p) / (n + weight))

    domains = _shares(counts.filter("_domain is not null"), "_domain", langs)
    domains = domains.select("_domain", towards(F.col("_domain_counts"), whole, DOMAIN_PRIOR).alias("domain_share"))
    hosts = _shares(counts.filter("_host is not null"), "_host", langs).withColumn("_domain", parent_of(F.col("_host"))).join(domains, "_domain", "left")
    hosts = settle(hosts.select("_host", towards(F.col("_host_counts"), F.coalesce("domain_share", whole), HOST_PRIOR).alias("host_share")), "language-hosts")

    def said(key: str) -> DataFrame:
        """log P(what is said | language), for each thing said."""
        kinds = counts.filter(F.col(key).isNotNull()).agg(F.countDistinct(key).alias("kinds")).first()["kinds"]
        given = F.zip_with(f"{key}_counts", language_total, lambda x, n: F.log((x + TABLE_PRIOR) / (n + TABLE_PRIOR * (kinds + 1))))
        return settle(_shares(counts.filter(F.col(key).isNotNull()), key, langs).select(key, given.alias(f"{key}_given")), "language-said")

    out = marked.join(hosts, "_host", "left").join(said("_declared"), "_declared", "left").join(said("_suffix"), "_suffix", "left")
    none = F.lit([0.0] * len(langs))
    total = F.transform(F.coalesce("host_share", whole), lambda p: F.log(p))
    for c in ("_ll", "_declared_given", "_suffix_given"):
        total = F.zip_with(total, F.coalesce(c, none), lambda a, b: a + b)
    out = out.withColumn("_total", total)
    top = F.array_max("_total")
    posterior = 1 / F.aggregate(F.transform("_total", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    names = F.lit(langs)
    told = (
        F.element_at(names, F.array_position("_total", top).cast("int")), posterior, F.when(F.col("_has_text"), F.element_at(names, best.cast("int") + 1)), F.col("_fit"),
        F.col("_has_text") & (posterior >= least) & (F.col("_fit") >= -LEAST_FIT),
    )
    return out.select("_row.*", *(c.alias(n) for c, n in zip(told, new, strict=True)))


def identify_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) judged with lang as the declared language and source as the host."""
    model = fit_model(docs)
    return identify(docs, model.langs, model, declared=F.col("lang"), host=F.col("source"), **how)


def identify_pages(pages: DataFrame, docs: DataFrame, markup: bool = True) -> DataFrame:
    """``pages`` (url, html) judged by what the html shows, its lang attribute, the address and the host; model from ``docs``.

    Without ``markup`` the attribute is shown, but no evidence.

    The address's suffix is the first path segment of two letters, else the host's last label.
    """
    model = fit_model(docs)
    shown = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    attribute = F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^[^:]*://([^/?#]*)", 1), F.lit(""))
    segment = F.nullif(F.regexp_extract(F.lower("url"), r"^[^:]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(F.lower("url"), r"^[^:]*://[^/?#]*\.([a-z]+)(?:[:/?#]|$)", 1), F.lit(""))
    text = pages.select("page_id", F.trim(shown).alias("text"), attribute.alias("declared"), F.coalesce(segment, last).alias("suffix"), host.alias("host"))
    return identify(text, model.langs, model, F.col("declared") if markup else None, F.col("suffix"), F.col("host"), without=("text",))
