from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from emulsion.llm import embed_dedup, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) over all pairs."""
    unit = []
    for _, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        ok = x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        unit.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    parts: dict = {}
    for i in range(n):
        parts.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i in range(n):
        least = min((x for x in parts[find(i)] if x is not None), default=None)
        out.append((rows[i][0], links[i], least, rows[i][0] == least))
    return sorted(out, key=str)


def ran(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in frame.collect()), key=str)


def family(rng, n, noise, dim=48):
    base = rng.standard_normal(dim)
    base /= np.linalg.norm(base)
    out = base + noise * rng.standard_normal((n, dim)) / math.sqrt(dim)
    return out.astype(np.float32).tolist()


def test_query_matches_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert ran(queries.op13_embedding_dedup(spark, sf)) == plain(rows)


@pytest.mark.parametrize("block", [1000, 7])
def test_families_of_all_widths(spark, monkeypatch, block):
    """Tight families become cells, wide ones are compared; buckets over the size of a block give the same."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "UNIT_ROWS", 200)
    rng = np.random.default_rng(4)
    vectors = family(rng, 60, 0.05) + family(rng, 60, 0.12) + family(rng, 40, 0.2) + family(rng, 20, 0.28) + rng.standard_normal((150, 48)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in rows]
    assert ran(embed_dedup.vector_links(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    """Of 600 planted pairs between 0.9 and 0.93 three at most are missed, and nothing below 0.9 is linked."""
    rng = np.random.default_rng(8)
    rows, want = [], 0
    for i in range(700):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.885 + 0.045 * (i / 700)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
        u, v = (np.array(x[1]) for x in rows[-2:])
        want += u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9
    got = embed_dedup.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    links = {r["vec_id"]: r["n_links"] for r in got.collect()}
    exact = {r[0]: r[1] for r in plain(rows)}
    assert all(links[i] <= exact[i] for i in links)
    assert sum(links.values()) >= 2 * want - 6 and want > 400


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [
        (1, v), (2, [2 * x for x in v]), (3, [1e-30 * x for x in v]), (4, [1e30 * x for x in v]), (5, None), (6, []), (7, [0.0] * 4), (8, [nan, 1.0, 1.0, 1.0]), (9, [inf, 1.0, 1.0, 1.0]), (10, [None, 1.0, 1.0, 1.0]),
        (11, v[:3]), (12, v[:3]), (13, w), (13, w), (13, v), (None, w), (None, None), (None, [0.0, 0.0, -1.0, 0.0]), (None, [-0.0, 0.0, -1.0, 0.0]), (20, [-0.0, -1.0, 0.0, 0.0]), (21, [0.0, -1.0, 0.0, 0.0]), (22, [-x for x in v]),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumn("digest", F.lit("x")).withColumn("n_links", F.lit(1)).withColumn("id", F.lit(2))
    got = ran(embed_dedup.vector_links(docs))
    seen = [(r["vec_id"], r["embedding"]) for r in docs.collect()]
    # kept of rows without an id is true where the whole group has none
    want = sorted((((a, b, c, a == c)) for a, b, c, _ in plain(seen)), key=str)
    assert got == want


def test_empty_and_single(spark):
    assert embed_dedup.vector_links(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ran(embed_dedup.vector_links(spark.createDataFrame([(3, [1.0])], SCHEMA))) == [(3, 0, 3, True)]


def test_hot_copies(spark):
    """A third of the rows are one vector, a third one vector with little noise."""
    rng = np.random.default_rng(2)
    rows = [(i, [0.5] * 32) for i in range(300)] + [(1000 + i, v) for i, v in enumerate(family(rng, 300, 0.05, 32))] + [(2000 + i, rng.standard_normal(32).tolist()) for i in range(100)]
    got = {r["vec_id"]: r for r in embed_dedup.vector_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i]["n_links"] for i in range(300)} == {299} and {got[i]["component_id"] for i in range(1000, 1300)} == {1000}
    assert {got[i]["n_links"] for i in range(1000, 1300)} == {299}


def test_design_keeps_recall_at_every_size():
    for n in (0, 10, 1000, 10**6, 10**9):
        k, tables = embed_dedup.design(n, 0.9)
        assert (1 - embed_dedup.shared_chance(math.sqrt(0.2)) ** k) ** tables <= embed_dedup.MISS
        assert n * embed_dedup.shared_chance(math.sqrt(2)) ** k <= embed_dedup.MATES


def test_sql_gives_the_same(spark):
    rng = np.random.default_rng(12)
    vectors = family(rng, 30, 0.1) + family(rng, 20, 0.15) + rng.standard_normal((60, 48)).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(200, None), (201, []), (202, [0.0] * 48), (203, [float("nan")] * 48), (204, [float("inf"), 1.0]), (205, vectors[0])]
    duck = duckdb.connect()
    duck.execute("create table embeddings (vec_id bigint, embedding float[])")
    duck.executemany("insert into embeddings values (?, ?)", rows)
    want = sorted(((r[0], r[1], r[2], r[3]) for r in duck.sql(queries.OP13_SQL).fetchall()), key=str)
    assert ran(embed_dedup.vector_links(spark.createDataFrame(rows, SCHEMA))) == want
