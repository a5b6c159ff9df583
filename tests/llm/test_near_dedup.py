from __future__ import annotations

import re

import duckdb
import numpy as np
from emulsion.llm import near_dedup
from pyspark.sql import functions as F

from . import corpus


def brute(rows, k, percent):
    """component by row index, over all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held: dict = {}
    for i, s in enumerate(sets):
        near: dict = {}
        for x in s:
            for j in held.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            held[x].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    parts: dict = {}
    for i in range(len(rows)):
        parts.setdefault(find(i), []).append(i)
    out = {}
    for own in parts.values():
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        for i in own:
            out[i] = (rows[i][0], len(sets[i]), least if sets[i] else rows[i][0])
    return sorted(out.values(), key=str)


def test_matches_brute_force(spark):
    for k, percent in ((3, 85), (5, 80)):
        rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
        got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, k, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_families_in_blocks(spark, monkeypatch):
    base = corpus.sentence(5, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for j in range(i % 12):
            w[(i * 37 + j * 13) % len(w)] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 7)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 85)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in corpus.rows()]
    docs = corpus.documents(spark).withColumn("family", F.lit("x")).withColumn("id", F.lit(1))
    got = near_dedup.near_classes(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 85)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_classes(corpus.empty(spark)).count() == 0 and near_dedup.near_dedup(corpus.empty(spark)).count() == 0


def test_near_copies_of_one_text_need_no_blocks(spark, monkeypatch):
    base = corpus.sentence(6, 200).split()
    rows = []
    for i in range(600):
        w = list(base)
        w[i % 200] = f"edit{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 50)
    monkeypatch.setattr(near_dedup, "in_families", lambda *_: 1 / 0)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 600


def test_chains_and_templates_that_heads_cannot_settle(spark, monkeypatch):
    rows, w = [], corpus.sentence(8, 120).split()
    for i in range(90):  # each is near the one before, far ones are not alike
        w[i * 7 % 120] = f"step{i}"
        rows.append((i, " ".join(w)))
    base = corpus.sentence(9, 100)
    rows += [(200 + i, base + " " + corpus.sentence(3000 + i, 35)) for i in range(60)]  # one template, below the limit
    rows += [(300 + i, base + " " + corpus.sentence(3000 + i, 34)) for i in range(60)]
    for few in (False, True):
        if few:  # all by blocks
            monkeypatch.setattr(near_dedup, "with_heads", lambda asked, sets, percent: asked.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
        monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 11)
        got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 85)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    from emulsion.llm import shingles

    texts = [corpus.sentence(i, 40).encode() for i in range(9)] + [b"x" * 900 + b" end", b"", b"  one\ttwo ", ("é" * 500).encode() + b" y"]
    want, counts = shingles.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    got, same = shingles.word_hashes(texts)
    assert (got == want).all() and (same == counts).all()
    single = [shingles.word_hashes([w])[0][0] for t in texts for w in t.split()]
    assert (np.array(single) == want).all()
