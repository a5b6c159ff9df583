from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from emulsion.llm import suffix_dedup
from emulsion.llm.anchors import LENGTH, Q, anchors

from . import corpus


def brute(texts):
    count: dict[int, int] = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - LENGTH + 1):
            w = hash(d[i : i + LENGTH])
            count[w] = count.get(w, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - LENGTH + 1):
            if count[hash(d[i : i + LENGTH])] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats_removed(df).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_anchors_are_in_their_windows_and_chosen_by_content():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 100, 3000, dtype=np.uint8)) + b"ab" * 400
    key, place, first = anchors(data)
    last = np.append(first[1:] - 1, len(data) - LENGTH)
    assert first[0] == 0 and (place >= last).all() and (place <= first + LENGTH - Q).all()
    k2, p2, f2 = anchors(data[1234:2800])
    one = {int(w): (int(k), int(p) - int(w)) for k, p, f, e in zip(key, place, first, last, strict=True) for w in range(f, e + 1)}
    last2 = np.append(f2[1:] - 1, 2800 - 1234 - LENGTH)
    two = {int(w): (int(k), int(p) - int(w)) for k, p, f, e in zip(k2, p2, f2, last2, strict=True) for w in range(f, e + 1)}
    assert all(one[w + 1234] == x for w, x in two.items())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_driver_documents(spark, folder):
    check(spark, duckdb.sql(f"select doc_id, text from '/root/testdata/{folder}/documents.parquet'").fetchall())


def test_refined_order_and_common_lengths():
    rng = np.random.default_rng(9)
    for width in (200, 168, 13):
        side = rng.integers(0, 2, (300, width), dtype=np.uint8)
        side[50:250] = side[:200]
        side[100:200, rng.integers(0, width, 100)] ^= 1
        side[:, : width // 2] = side[0, : width // 2]  # many suffixes that begin alike
        bucket = rng.integers(0, 4, 300)
        order, common = suffix_dedup.refined(bucket, side)
        keys = [(bucket[i], side[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for j in range(1, 300):
            (a, x), (b, y) = keys[j - 1], keys[j]
            same = next((k for k in range(width) if x[k] != y[k]), width)
            assert common[j] == (same if a == b else -1)


def test_long_text_hot_passage_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 20)
    passage, long = corpus.sentence(40, 60), corpus.sentence(43, 40_000)
    rows = [(i, corpus.sentence(1000 + i, 12) + " " + passage + " " + corpus.sentence(2000 + i, 12)) for i in range(150)] + [(900, long), (901, long[5000:9000] + " x " + passage)]
    names = ("text_key", "row_id", "asked", "whole", "spans", "key", "n_bytes")
    df = spark.createDataFrame([(*r, *range(7)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats_removed(df).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("most", [2_000, 2])
def test_passages_edits_and_edges(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    passage, base = corpus.sentence(40, 70), corpus.sentence(41, 150)
    rows = [(i, corpus.sentence(100 + i, 20 + i) + " " + passage[i % 5 : len(passage) - i % 7] + " " + corpus.sentence(200 + i, 15)) for i in range(12)]
    for i in range(10):
        w = base.split()
        w[10 + 11 * i % 120] = f"edit{i}"
        rows.append((50 + i, " ".join(w)))
    x = corpus.sentence(42, 80)
    rows += [(70, x[:199]), (71, x[:200]), (72, x[:200] + "!"), (73, x[1:201]), (74, x + x), (75, "é" * 300), (76, "ab" * 500), (77, "a" * 199), (78, "a" * 200), (79, "a" * 450), (80, "line of text\n" * 60)]
    rows += [(r[0], r[1]) for r in corpus.rows() if r[0] not in (7, 8)]
    check(spark, rows)


def test_repeated_rows_share_a_passage_with_one_other(spark):
    rows = []
    for i in range(12):
        passage = corpus.sentence(300 + i, 60)
        whole = corpus.sentence(400 + i, 30) + " " + passage + " " + corpus.sentence(500 + i, 30)
        rows += [(None if i == 3 else i, whole)] * 6 + [(100 + i, corpus.sentence(600 + i, 30) + " " + passage + " " + corpus.sentence(700 + i, 30))]
    check(spark, rows)


def test_empty(spark):
    assert suffix_dedup.repeats_removed(corpus.empty(spark)).count() == 0
