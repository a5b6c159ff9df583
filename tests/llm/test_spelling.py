from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from emulsion.llm import queries, spelling
from pyspark.sql import functions as F

from . import corpus


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_words(rows, least_length=5, least_count=3):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        around = [y for y in words if abs(len(y) - len(w)) < 2 and near(w, y)]
        best = min(around, key=lambda y: (-words[y], y), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(around), words[form] if form else None]
    for w, row in out.items():
        end = w
        while out[end][0] is not None:
            end = out[end][0]
        row[1] = end
    return {w: tuple(r) for w, r in out.items()}


def ran(frame):
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in frame.collect()}


def spelled(spark, counts):
    """Documents in which each word stands so often; their ids are chosen so that no letter is lost."""
    free = next(i for i in range(10_000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in counts))
    return spark.createDataFrame([(free, " ".join([w] * n)) for w, n in counts.items()], "doc_id long, text string")


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_words(rows)
    got = ran(queries.op11_spelling_variants(spark, sf))
    few = {w for w in want if zlib.crc32(w.encode()) % 40 == 0}  # all pairs of a few words with all others
    assert {w: got[w][2] for w in got} == want
    for w in few:
        assert got[w][3] == sum(near(w, y) for y in want)


def test_chains_ties_and_repeated_letters(spark):
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaaab": 12, "aaaabb": 24, "zebra": 10, "zebras": 20, "zebrä": 20, "zebre": 5, "alone": 3, "aabbaa": 4, "aabaa": 4, "abbaa": 9, "aaabbaa": 3, "áaaaa": 7, "ab" * 8: 3, "ab" * 8 + "a": 8}
    docs = spelled(spark, counts)
    got, want = ran(spelling.variants(docs)), plain_variants(counts)
    assert got == want
    assert got["aaaaa"][1] == "aaaabb" and got["zebra"][0] == "zebras" and got["zebre"][0] == "zebrä"


@pytest.mark.parametrize("size", [62, 63, 64, 65, 66, 67, 300])
def test_long_words_meet_over_the_limit(spark, size):
    base = (corpus.sentence(3, 400).replace(" ", "").translate(str.maketrans("0123456789", "qrstuvwxyz")))[:size]
    counts = {base: 9, base[:10] + base[11:]: 4, base[:-1] + "é": 3, "é" + base: 4, base[:30] + "ü" + base[30:]: 3, base[:30] + "üü" + base[30:]: 5, base + base[-1]: 3}
    assert ran(spelling.variants(spelled(spark, counts))) == plain_variants(counts)


def test_neighbourhood_has_each_string_once():
    import numpy as np

    letters = np.array([ord(c) for c in "abcé"], np.uint32)
    for word in ("aabca", "éabb", "aaaa", "b"):
        code = np.array([word]).view(np.uint32).reshape(1, -1)
        for whole in (True, False):
            m = len(word) if whole else len(word) - 1
            if not m:
                continue
            made = Counter(int(h) for at in range(0, m, 2) for near_, ok in spelling.neighbourhood(code, at, whole, letters) for h, o in zip(near_.ravel(), np.broadcast_to(ok, near_.shape).ravel(), strict=True) if o)
            if whole:
                want = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abcé"} - {word} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abcé"}
            else:
                want = {word[:i] + word[i + 1 :] for i in range(len(word))}
            hashed = {int(spelling.word_hash(np.array([w]).view(np.uint32).reshape(1, -1))[0]) for w in want}
            assert set(made) == hashed and max(made.values()) == 1


def test_edges(spark):
    docs = corpus.documents(spark).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("form", F.lit("y"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ran(spelling.variants(docs)) == plain_variants(plain_words(rows))
    assert spelling.variants(corpus.empty(spark)).collect() == []
    assert spelling.variants(corpus.empty(spark)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_very_long_texts_and_words(spark):
    long = "b" * 50_000
    text = "hello " * 400_000 + long
    docs = spark.createDataFrame([(1, text), (2, long + " " + long), (3, f"{'b' * 49_999} " * 3)], "doc_id long, text string")
    got = ran(spelling.variants(docs))
    assert got == plain_variants(plain_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert any(len(w) > 40_000 and r[3] == 1 for w, r in got.items())
