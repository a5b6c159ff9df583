from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from emulsion.llm import mixing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from . import corpus

NAMES = st.one_of(st.none(), st.text("abcÄ", min_size=1, max_size=2))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(NAMES, st.integers(0, 10_000), max_size=9))
def test_allocation(sizes):
    got = mixing.allocate(list(sizes.items()))
    assert set(got) == set(sizes)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()), abs=1e-6)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [s for s in sizes if got[s] < 3 * sizes[s] - 1e-6]
    for s in sizes:
        assert got[s] <= 3 * sizes[s] + 1e-6
    if free:  # what isn't stopped shares by weight, and what is stopped would have had as much or more
        unit = got[free[0]] / weight[free[0]]
        assert all(got[s] / weight[s] == pytest.approx(unit) for s in free)
        assert all(3 * sizes[s] / weight[s] <= unit + 1e-6 for s in sizes if s not in free)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=6), st.integers(1, 33), st.integers(0, 5))
def test_splitting_tree_keeps_quotas(blocks, shards, seed):
    tree = mixing.split_tree(np.array(blocks), shards, seed)
    assert (tree.sum(axis=0) == blocks).all() and (tree >= 0).all()
    rows = tree.sum(axis=1)
    assert rows.max() - rows.min() <= max(1, np.ceil(np.log2(shards)))
    assert (tree == mixing.split_tree(np.array(blocks), shards, seed)).all()


def test_split_is_hypergeometric_on_average():
    share = np.mean([mixing.split_tree(np.array([300, 100]), 2, s)[0] for s in range(400)], axis=0)
    assert np.allclose(share, [150, 50], atol=1.5)


def words(t):
    return len((t or "").split())


def test_plan_takes_the_targets(spark):
    rows = [(i, corpus.sentence(i, 1 + i * 37 % 90), "en", s, 0) for i in range(400) for s in [(["a", "b", "c", None, "z"] + ["a"] * 3)[i % 8]]]
    df = spark.createDataFrame(rows, corpus.SCHEMA)
    plan = mixing.mix_plan(df.repartition(5), shards=8, block_words=50).collect()
    again = mixing.mix_plan(df.repartition(2), shards=8, block_words=50).collect()
    key = lambda r: (r["doc_id"], r["pass"], r["taken"], r["shard"], r["place"])
    assert sorted(map(key, plan), key=str) == sorted(map(key, again), key=str)
    size, taken, target = Counter(), Counter(), {}
    for i, t, _, s, _ in rows:
        size[s] += words(t)
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["source_size"] == size[r["source"]]
    want = mixing.allocate(list(size.items()))
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) < 1
    by_doc: Counter = Counter()
    for r in plan:
        by_doc[r["doc_id"]] += r["taken"]
    assert all(by_doc[i] <= 3 * words(t) for i, t, *_ in rows)
    load = Counter(r["shard"] for r in plan if r["taken"])
    assert set(load) == set(range(8))


def test_mixed_rows_and_edges(spark):
    docs = corpus.documents(spark).withColumn("pass", F.lit("p")).withColumn("size", F.lit(3)).withColumn("mix_pass", F.lit(9))
    out = mixing.mix(docs, shards=4, block_words=16)
    assert [c for c in out.columns if not c.startswith("mix_")] == [c for c in docs.columns if c != "mix_pass"]
    got: Counter = Counter()
    for r in out.collect():
        got[r["source"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"])
    size: Counter = Counter()
    for _, t, _, s, _ in corpus.rows():
        size[s] += words(t)
    want = mixing.allocate(list(size.items()))
    assert all(abs(got[s] - want[s]) < 1 for s in size)
    assert mixing.mix(corpus.empty(spark)).count() == 0 and mixing.mix_plan(corpus.empty(spark)).count() == 0
    n = sum(r[3] == "a" for r in corpus.rows())
    assert mixing.mix_plan(docs).filter("source = 'a' and pass = 0").count() == n  # repeated rows are rows of their own


def test_every_draw_by_walking_blocks_and_tree(spark):
    rows = [(i, corpus.sentence(i, 1 + i * 37 % 90), "en", s, 0) for i in range(300) for s in [(["a", "b", "c", None, "z"] + ["a"] * 3)[i % 8]]]
    df = spark.createDataFrame(rows + rows[:3], corpus.SCHEMA)
    shards, unit, seed = 8, 50, 20
    got = mixing.mix_draws(df, shards=shards, block_words=unit, seed=seed)
    keyed = df.select("doc_id", "source", F.xxhash64("text").alias("key"))
    copies = keyed.collect()
    seen: Counter = Counter()
    docs = []
    for r in copies:
        seen[r["doc_id"]] += 1
        docs.append((r["doc_id"], r["source"], r["key"], seen[r["doc_id"]]))
    text = {r[0]: r[1] for r in rows}
    hashed = spark.createDataFrame([(*d, p) for d in docs for p in range(3)], "doc_id long, source string, text_key long, copy int, pass int")
    h = F.xxhash64(F.lit(seed), "pass", "doc_id", "text_key", "copy")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), h, "pass"), 1)
    hashes = {(r["doc_id"], r["copy"], r["pass"]): (r["h"], r["place"]) for r in hashed.select("*", h.alias("h"), place.alias("place")).collect()}
    size: Counter = Counter()
    for i, s, _, _ in docs:
        size[s] += words(text[i])
    target = mixing.allocate(list(size.items()))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    quota = {s: min(int(target[s] + 0.5), 3 * size[s]) for s in order}
    tree = mixing.split_tree(np.array([-(-quota[s] // unit) for s in order]), shards, seed)
    want = Counter()
    for at, s in enumerate(order):
        owner = [shard for shard in range(shards) for _ in range(tree[shard, at])]  # of each block of the stream
        cells = 1 << max(0, int(np.ceil(np.log2(len(docs)) / 2)))
        word = 0
        for p in range(3):
            mine = [d for d in docs if d[1] == s]
            for i, _, key, copy in sorted(mine, key=lambda d: (hashes[d[0], d[3], p][0] % cells, hashes[d[0], d[3], p][0], d[0], d[2], d[3])):
                n = min(words(text[i]), quota[s] - word)
                if n > 0:
                    want[i, owner[word // unit], hashes[i, copy, p][1], p, n] += 1
                word += words(text[i])
    have = Counter((r["doc_id"], d["shard"], d["place"], d["pass"], d["words"]) for r in got.collect() for d in r["draws"])
    assert have == want
    assert all(r["taken"] == sum(d["words"] for d in r["draws"]) for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "shard_ends" in plan


def test_mixed_rows_lie_by_shard_and_place(spark, tmp_path):
    rows = [(i, corpus.sentence(i, 1 + i * 37 % 90), "en", "abz"[i % 3], 0) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, corpus.SCHEMA), shards=8, block_words=50)
    parts = out.select(F.spark_partition_id().alias("part"), "mix_shard", "mix_place").collect()
    where: dict = {}
    for r in parts:
        assert where.setdefault(r["mix_shard"], r["part"]) == r["part"]
    by_part: dict = {}
    for r in parts:
        by_part.setdefault(r["part"], []).append((r["mix_shard"], r["mix_place"]))
    assert all(x == sorted(x) for x in by_part.values())


def test_targets_match_sql(spark):
    import duckdb
    from emulsion.llm import queries

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = sorted(con.execute(queries.TARGETS_SQL).fetchall())
    assert sorted(map(tuple, queries.mix_targets(spark, folder).collect())) == want


def test_many_sources_in_groups(spark, monkeypatch):
    """Groups of sources split their own quotas: targets as before, shards even, and each source takes what it may."""
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 7)
    rows = [(i, corpus.sentence(i, 20 + i % 60), None, None if i % 53 == 0 else f"s{i % 53:02d}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    plan = mixing.mix_plan(docs, shards=8, block_words=100).collect()
    size, taken, target, shard = Counter(), Counter(), {}, Counter()
    for r in plan:
        size[r["source"]] = r["source_size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        shard[r["shard"]] += r["taken"]
    assert target == mixing.allocate(list(size.items()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    del shard[None]
    assert len(shard) == 8 and max(shard.values()) < 2 * min(shard.values())
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs.repartition(3), shards=8, block_words=100).collect()))


def test_three_hundred_thousand_sources(spark):
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("host"), F.col("id").cast("string")).alias("source"))
    taken, target, sources = mixing.mix_plan(docs).agg(F.sum("taken"), F.sum(F.when(F.col("pass") == 0, F.col("target"))), F.countDistinct("source")).first()
    assert sources == 300_000 and target == pytest.approx(1_200_000) and abs(taken - target) < 300_000


def test_groups_keep_the_tree_of_the_sums():
    totals = np.array([5, 9, 1, 15])
    tree = mixing.split_tree(np.array([10, 20]), 4, 3, totals, 2)
    assert (tree.sum(axis=1) == totals).all() and (tree.sum(axis=0) == [10, 20]).all()
