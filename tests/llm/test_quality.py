from __future__ import annotations

import zlib

import numpy as np
from emulsion.llm import quality
from emulsion.llm.common import table
from pyspark.sql import functions as F

from . import corpus


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    scored = quality.quality_scores(docs, labels)
    rows = scored.join(labels.groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id").select("doc_id", "held_out", "score", "predicted", "y").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["y"] for r in out]) > 0.93
    good, bad = ([r["score"] for r in out if r["y"] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.choice(np.arange(40) + 40 * (i % 2), 12)).astype(np.int32) for i in range(200)]
    y = np.array([i % 2 for i in range(200)])
    w, slope, offset = quality.nbsvm(rows, y)
    margin = np.array([w[i].sum() / np.sqrt(len(i)) for i in rows])
    assert ((slope * margin + offset > 0) == (y == 1)).all()


def test_scores_match_a_plain_fit(spark):
    rows = [(i, corpus.sentence(i, 20 + i % 30) if i % 2 else " ".join(f"w{i * 7 % 13}ab{j % 5}" for j in range(25)), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    grams = {i: sorted({int(x) for x in quality.trigram_codes(t)}) for i, t, _ in rows}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    train.sort(key=lambda r: (grams[r[0]], r[2]))
    count = np.ones((2, quality.SIZE))
    for i, _, y in train:
        for g in grams[i]:
            count[y, g] += 1
    ratio = np.log(count[1] / count[1].sum() / (count[0] / count[0].sum()))
    used = sorted({g for i, *_ in train for g in grams[i]})
    at = {g: k for k, g in enumerate(used)}
    dense = np.zeros((len(train), len(used) + 1))
    for k, (i, *_) in enumerate(train):
        for g in grams[i]:
            dense[k, at[g]] = ratio[g] / len(grams[i]) ** 0.5
    dense[:, -1] = 1  # the bias
    sign = np.array([1 if y else -1 for *_, y in train])
    limit = np.array([quality.C / (2 * np.mean([z == y for *_, z in train])) for *_, y in train])
    alpha, rng = np.zeros(len(train)), np.random.default_rng(8)
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(train)):
            w = (alpha * sign) @ dense
            alpha[k] = min(max(alpha[k] - (sign[k] * (w @ dense[k]) - 1) / (dense[k] @ dense[k]), 0), limit[k])
    w = ((alpha * sign) @ dense)[:-1]
    w = (quality.BETA * w + (1 - quality.BETA) * np.abs(w).sum() / quality.SIZE * np.sign(w)) * ratio[used]
    margin = {i: sum(w[at[g]] for g in grams[i] if g in at) / len(grams[i]) ** 0.5 for i, *_ in rows}
    slope, offset = quality.logistic_fit(np.array([margin[i] for i, *_ in train]), np.array([y for *_, y in train]))
    for i, *_ in rows:
        assert np.isclose(got[i]["score"], 1 / (1 + np.exp(-(slope * margin[i] + offset))), atol=1e-4)


def test_edges(spark):
    docs = corpus.documents(spark).withColumn("score", F.lit(2.0)).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, 0), (8, 0, 1), (10, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.filter("score is null or held_out is null").count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(corpus.empty(spark), labels).count() == 0


def test_text_of_ten_megabytes(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**9, "a fair and plain sentence about the weather " * 230_000)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, table(spark, "/root/testdata/sf0.001", "labels")).collect()}
    assert len(got) == docs.count() and 0 <= got[10**9]["score"] <= 1
