"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host || path`` with the literal tokens that any match must contain. The rule is
indexed under the one of them that the fewest distinct addresses hold; an address fetches candidates by its own tokens, and
only candidates run their expression. Which rule wins is decided per distinct address, so a hot address is judged once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_az

TOKEN_BREAK = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host || path; ``literals`` are whole tokens (runs of A-Z, a-z, 0-9) of every match."""

    label: str
    pattern: str
    action: str
    literals: tuple[str, ...]
    listed: bool


def host_path_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (empty, or beginning with a slash)."""
    whole = re.split(TOKEN_BREAK, path)
    if whole and whole[-1]:
        whole = whole[:-1]  # a longer token may go on from here
    literals = tuple(dict.fromkeys(x for x in (*re.split(TOKEN_BREAK, host), *whole) if x))
    quoted = "".join(c if c.isalnum() or c == "/" else "\\" + c for c in host), "".join(c if c.isalnum() or c == "/" else "\\" + c for c in path)
    return UrlRule(host + path, rf"^(?:[^/]*\.)?{quoted[0]}(?:$|(?=/)){quoted[1]}", action, literals, True)


def site_pattern(words: str) -> UrlRule:
    """Blocks hosts that hold the hyphenated ``words`` as a whole part of a label."""
    return UrlRule(words, rf"^(?:[^/]*[.-])?{words}(?:[.-]|$|(?=/))", "block", tuple(words.split("-")), False)


LISTED = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)
#: What the method itself blocks where no listed rule fits: hosts by name.
PATTERNS = tuple(site_pattern(x) for x in ("cheap-pills", "spam-farm", "casino", "payday-loans", "replica-watches", "torrent", "warez", "xxx"))


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_rows(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.label!r} has no literal token to index it by")
    rows = [(i, r.label, r.pattern, r.action, r.listed, len(r.label), list(r.literals)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, label string, pattern string, action string, listed boolean, length int, literals array<string>")


def rarest_token(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with the literal that the fewest rows of ``tokens`` (address, token) hold; then the longest, then the first."""
    literals = rules.select("rule_id", F.explode("literals").alias("token"))
    held = tokens.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("rule_id").orderBy("held", F.desc(F.length("token")), "token")
    best = literals.join(held, "token", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("place", F.row_number().over(order)).filter("place = 1")
    return rules.drop("literals").join(best.select("rule_id", "token"), "rule_id")


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = LISTED + PATTERNS, url: str = "url") -> DataFrame:
    """``pages`` plus url_host, url_path, url_rule, url_pattern, url_verdict; one row out for each row in.

    The longest listed rule that fits decides (ties: the first label); else any fitting pattern of the method; else allow.
    A null url, or one without ``://``, has empty host and path, fits nothing and is allowed. Repeated rows stay. Columns of
    those names in ``pages`` are replaced. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    new = ("url_host", "url_path", "url_rule", "url_pattern", "url_verdict", "url_subject")
    cut = pages.drop(*new).withColumns({"url_host": host_of(F.col(url)), "url_path": path_of(F.col(url))}).withColumn("url_subject", F.concat("url_host", "url_path"))
    subjects = cut.filter("url_subject != ''").select(F.col("url_subject").alias("subject")).distinct()
    tokens = subjects.select("subject", F.explode(F.array_distinct(F.split("subject", TOKEN_BREAK))).alias("token")).filter("token != ''")
    index = rarest_token(rule_rows(spark, rules), tokens)
    fits = tokens.join(index, "token").filter("subject rlike pattern")
    won = fits.groupBy("subject").agg(
        F.max(F.when(F.col("listed"), F.struct("length", "label", "action"))).alias("won"),
        F.min(F.when(~F.col("listed"), F.col("label"))).alias("url_pattern"),
    )
    out = cut.join(won.withColumnRenamed("subject", "url_subject"), "url_subject", "left")
    verdict = F.coalesce(F.col("won.action"), F.when(F.col("url_pattern").isNotNull(), "block"), F.lit("allow"))
    return out.withColumns({"url_rule": F.col("won.label"), "url_verdict": verdict}).drop("won", "url_subject")
