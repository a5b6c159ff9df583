from __future__ import annotations

import re

import pytest
from emulsion.llm import url_rules
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7?x#y", "http://example.com/en/70", "http://example.com/EN/7", "http://notexample.com/en/7", "http://com/en/", "http://a.b.com/en", "http://com", "x://y://z/en/1",
    "http://example.net/de/8", "http://example.net/de/9", "http://m.example.net/de/88#q", "http://spam-farm.example.org/fr/", "http://www.cheap-pills.example.com/de/1", "http://xcheap-pills.example.com/de/1", "http://a.org/es/", "http://a.org/es",
    "http://a.com?/en/7", "http://a.com#/en/7", "http://ÄB.com/en/ü\n1", "http://user@example.com:80/en/7", "http://example.com:80/en/7", "http://casino.net/x", "http://my-casino/x", "http://casinos.net/x",
]


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for action, rule_host, rule_path in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")):
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path) and (best is None or len(rule_host + rule_path) > len(best[0])):
            best = (rule_host + rule_path, action)
    spam = re.search(r"(^|[.-])(cheap-pills|spam-farm|casino|payday-loans|replica-watches|torrent|warez|xxx)([.-]|$)", host)
    return host, path, best and best[0], best[1] if best else "block" if spam else "allow"


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumn("token", F.lit("t")).withColumn("pattern", F.lit("p")).withColumn("url_rule", F.lit("old"))
    out = url_rules.url_filter(df)
    assert out.count() == 2 * len(URLS)
    for r in out.collect():
        assert (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) == brute(URLS[r["page_id"] % len(URLS)]), URLS[r["page_id"] % len(URLS)]


def test_rarest_token_indexes_a_rule(spark):
    tokens = spark.createDataFrame([("u1", "com"), ("u2", "com"), ("u1", "en"), ("u3", "zz")], "subject string, token string")
    rules = url_rules.rule_rows(spark, (url_rules.host_path_rule("block", "com", "/en/"), url_rules.host_path_rule("block", "never.com", "/x")))
    assert {r["label"]: r["token"] for r in url_rules.rarest_token(rules, tokens).collect()} == {"com/en/": "en", "never.com/x": "never"}
    with pytest.raises(ValueError):
        url_rules.rule_rows(spark, (url_rules.UrlRule("any", ".*", "block", (), False),))


def test_empty(spark):
    assert url_rules.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
