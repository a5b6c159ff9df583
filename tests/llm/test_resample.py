from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from emulsion.llm import queries, resample
from pyspark.sql import functions as F

from . import corpus


def features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(docs, target, percent=25):
    """(doc_id, n_features, weight, score) and rank by position, as the contract says it."""
    rows = [(i, *features(t)) for i, t in docs]
    wanted = [features(t)[1] for t in target]
    s, t = Counter(x for r in rows for x in r[2]), Counter(x for f in wanted for x in f)
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10000)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


def ran(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in frame.collect()), key=str)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.op12_importance_resample(spark, sf)
    assert ran(got) == plain(docs, target)
    ranks = sorted(r["rank"] for r in got.filter("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_joined_crc_is_that_of_the_whole():
    words = [b"", b"a", b"quartz", "été".encode(), b"x" * 1000, b"y" * 100_003]
    pairs = [(a, b) for a in words for b in words]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    got = resample.joined_crc(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_streams_hold_all_features_in_order(spark):
    texts = ["One two THREE", "", "two", "naïve-café 7_8", "\x00\x7f"]
    stream, start, words = resample.feature_buckets(texts)
    for i, t in enumerate(texts):
        n, want = features(t)
        assert words[i] == n and stream[start[i] : start[i + 1]].tolist() == want
    counts = {r["bucket"]: r["n"] for r in resample.bucket_counts(resample.bucket_streams(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))).collect()}
    assert counts == Counter(x for t in texts for x in features(t)[1])


def test_edges_ties_and_clashing_columns(spark):
    docs = corpus.documents(spark).withColumn("score", F.lit(5)).withColumn("rank", F.lit(1)).withColumn("ids", F.lit("x"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [corpus.sentence(1, 50), None, ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = ran(resample.resample(docs, frame, percent=60))
    want = plain(rows, target, 60)
    # of repeated rows either may have the better rank, so they are compared as a list
    assert got == want
    assert sum(r[4] is not None for r in got) == 60 * sum(features(t)[0] >= 20 for _, t in rows) // 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(corpus.empty(spark), none).collect() == []
    assert resample.resample(corpus.empty(spark), none).columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    rows = [(r["doc_id"], r["text"]) for r in corpus.documents(spark).collect()]
    assert ran(resample.resample(corpus.documents(spark), none)) == plain(rows, [])


def test_towards_the_target(spark):
    """A draw takes the target's kind of text far more often than the rest."""
    like = [(i, corpus.sentence(i, 40)) for i in range(200)]
    other = [(1000 + i, " ".join(f"w{(i * 37 + k * 11) % 400}" for k in range(40))) for i in range(600)]
    target = spark.createDataFrame([(corpus.sentence(5000 + i, 60),) for i in range(50)], "text string")
    drawn = resample.resample(spark.createDataFrame(like + other, "doc_id long, text string"), target).filter("rank is not null")
    assert drawn.count() == 200
    assert drawn.filter("doc_id < 1000").count() > 125  # 50 by chance


def test_very_long_text(spark):
    text = "alpha beta gamma " * 600_000
    rows = [(1, text), (2, "z" * 3_000_000), (3, "alpha beta")]
    got = ran(resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("beta gamma",)], "text string")))
    assert got == plain(rows, ["beta gamma"])


def test_buckets_must_fit(spark):
    with pytest.raises(ValueError):
        resample.bucket_streams(spark.createDataFrame([], "id long, text string"), 1 << 17)
