from __future__ import annotations

import random

from emulsion.llm.graph import components


def brute(edges):
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rnd = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(0, i) for i in range(1, 60)] + [(90, 59)]
    edges = chain + star + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(5, 5), (7, 3), (3, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
