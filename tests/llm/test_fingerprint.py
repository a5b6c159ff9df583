from __future__ import annotations

import hashlib

from emulsion.llm import fingerprint
from pyspark.sql import functions as F

from . import corpus


def test_edited_text_and_order(spark):
    docs = [(i * 7 % 101, corpus.sentence(i, 5 + i * 3 % 90)) for i in range(101)] + [(500, ""), (501, "a"), (502, "👍é" * 9)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    order = sorted(docs)
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 200]
    far = [r["near_next"] for r in got.values() if r["n_chars"] > 200]
    assert sum(near) / len(near) > 0.25 + sum(far) / len(far)


def _word_hashes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", fingerprint.kmer_hashes(F.col("text")).alias("k"), fingerprint.fingerprint(F.col("text")).alias("f")).orderBy("i").collect()
    return [(r["k"], r["f"]) for r in rows]


def test_matches_brute_force(spark):
    texts = [corpus.sentence(1, 200), "same " * 300, "a b a b a b a b", "one", "", corpus.sentence(3, 7), "x y z x y z x y z w"]
    got = _word_hashes(spark, texts)
    mask, need, cells = ~fingerprint.PLACE, {}, []
    for k, _ in got:  # number the occurrences by hand, then let Spark hash the pairs
        seen, own = {}, []
        for place, h in enumerate(k):
            head = h & mask
            own.append((head, seen.get(head, 0), place))
            seen[head] = seen.get(head, 0) + 1
        cells.append(own)
    pairs = sorted({(h, o) for own in cells for h, o, _ in own})
    df = spark.createDataFrame(pairs, "h long, o int").withColumn("x", F.xxhash64("h", "o"))
    need = {(r["h"], r["o"]): r["x"] & mask for r in df.collect()}
    tuples, wanted, anew = set(), [], 0
    for own in cells:
        placed = [(need[h, o], place) for h, o, place in own]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        picked = {}
        for b in range(-32, 32) if own else ():
            flipped = sorted(((x ^ b << 58) & (2**64 - 1), place) for x, place in placed)[:2]
            anew += sum(x >> 58 == b for x, _ in placed) < 2
            picked[b] = tuple(signed(x ^ 1 << 63) for x, _ in sorted(flipped, key=lambda p: p[1]))
        tuples |= set(picked.values())
        wanted.append(picked)
    assert 0 < anew < 64 * len(texts)
    two = [t for t in tuples if len(t) == 2]
    one = [t for t in tuples if len(t) == 1]
    hashed = {(r["a"], r["b"]): r["x"] for r in spark.createDataFrame(two, "a long, b long").withColumn("x", F.xxhash64("a", "b")).collect()}
    hashed |= {(r["a"],): r["x"] for r in spark.createDataFrame(one, "a long").withColumn("x", F.xxhash64("a")).collect()}
    for (_, f), picked in zip(got, wanted, strict=True):
        want = [(b << 26 | (hashed[picked[b]] & (2**64 - 1)) >> 38) for b in sorted(picked)]
        assert f == [x if x < 2**31 else x - 2**32 for x in want]


def test_likeness_is_the_share_of_equal_values(spark):
    docs = [(i, corpus.sentence(i // 2, 30 + i * 3 % 200)) for i in range(60)] + [(100, ""), (101, ""), (102, "one")]
    got = sorted(fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    values = lambda x: {x[i : i + 8] for i in range(0, len(x), 8)}
    like = lambda a, b: 1.0 if not a and not b else len(values(a) & values(b)) / 64
    for r, n in zip(got, got[1:] + got[:1], strict=True):
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == like(r["fingerprint"], n["fingerprint"])


def test_order_counts_in_short_and_long_texts(spark):
    for n in (12, 40, 400):
        halves = [corpus.sentence(2000 + i, n // 2) for i in range(60)]
        pairs = [(i, f"{a} {b}", f"{b} {a}", f"{a} {corpus.sentence(9000 + i, n // 2)}") for i, (a, b) in enumerate(zip(halves, halves[30:], strict=False))]
        df = spark.createDataFrame(pairs, "i int, a string, swapped string, half string").select(*(fingerprint.fingerprint(F.col(c)).alias(c) for c in ("a", "swapped", "half")))
        swapped, half = df.select(F.avg(fingerprint.likeness(F.col("a"), F.col("swapped"))), F.avg(fingerprint.likeness(F.col("a"), F.col("half")))).first()
        assert half < swapped < 0.75, (n, swapped, half)  # nearly the same k-mers, half of the pairs in the other order


def test_edge_rows(spark):
    docs = corpus.documents(spark).withColumn("fp", F.lit(1)).withColumn("next", F.lit(2))
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == docs.count()
    by_text: dict = {}
    for (i, t, *_), key in zip(corpus.rows(), range(99), strict=False):
        by_text.setdefault(t or "", []).append(i)
    prints = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    assert prints[1, len(corpus.sentence(1, 120))] == prints[2, len(corpus.sentence(1, 120))]
    assert fingerprint.fingerprints(corpus.empty(spark)).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_short_texts_that_are_edited_are_still_alike(spark):
    """From three words on, texts that keep three quarters are far more alike than the next ones, without a gap at any length."""
    for n in (3, 4, 8, 12, 16, 20, 26, 40, 70, 120, 150):
        docs = [(i, corpus.sentence(100 * n + i, n)) for i in range(60)]
        near, far = fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).select(F.avg("near_edited"), F.avg("near_next")).first()
        assert near > 0.2 and near > far + 0.12, (n, near, far)


def test_text_of_ten_megabytes(spark):
    docs = [(1, "alpha beta gamma delta " * 450_000), (2, "x" * 2_000_000), (3, "alpha beta gamma delta " * 450_000)]
    got = sorted(fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    assert got[0]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"] and len(got[0]["fingerprint"]) == 64 * 8
    assert got[0]["edited_sha256"] == hashlib.sha256((docs[0][1][: -(len(docs[0][1]) // 4)] + docs[1][1]).encode()).hexdigest()
