"""Summed-area tables against sums over cells, edge support against a loop over samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from emulsion.operators import areas
from pyspark.sql import functions as F


def frame(spark, arrays):
    parts = []
    for k, a in arrays.items():
        y, x = np.nonzero(np.isfinite(a))
        parts.append(pd.DataFrame({"frame_id": k, "y": y.astype("int32"), "x": x.astype("int32"), "v": a[y, x]}))
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(2)
    a, b = rng.random((23, 31)), rng.random((12, 9))
    a[-1, 20:] = np.nan  # the last row isn't whole
    a[5, 5] = np.nan
    return {1: a, 2: b}


def test_table_and_sums(spark, pictures):
    df = frame(spark, pictures)
    table = areas.summed_area(df, "v")
    for k, a in pictures.items():
        got = np.zeros(a.shape)
        rows = table.filter(F.col("frame_id") == k).collect()
        assert len(rows) == a.size
        for r in rows:
            got[r["y"], r["x"]] = r["v"]
        assert np.allclose(got, np.nancumsum(np.nancumsum(a, axis=0), axis=1))
    rng = np.random.default_rng(9)
    rects = [(int(rng.integers(1, 3)), i, int(rng.integers(-5, 25)), int(rng.integers(-5, 20)), int(rng.integers(1, 20)), int(rng.integers(1, 20))) for i in range(150)] + [(1, 900, -20, -20, 100, 100), (2, 901, 50, 50, 4, 4), (7, 902, 0, 0, 3, 3)]
    got = areas.rectangle_sums(table, spark.createDataFrame(rects, "frame_id long, cand_pos long, x0 int, y0 int, width int, height int"), ["v"], 2.0)
    seen = {r["cand_pos"]: (r["in_v"], r["out_v"]) for r in got.collect()}
    assert 902 not in seen
    for k, i, x0, y0, w, h in rects[:-1]:
        a = pictures[k]
        yy, xx = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        pad = max(2.0, min(w, h) * 0.075)
        inner = (xx >= x0) & (xx < x0 + w) & (yy >= y0) & (yy < y0 + h)
        outer = (xx >= x0 - pad) & (xx < x0 + w + pad) & (yy >= y0 - pad) & (yy < y0 + h + pad)
        assert seen[i] == pytest.approx((np.nansum(a[inner]), np.nansum(a[outer & ~inner])), abs=1e-9)


def test_few_cells_tell_nothing(spark):
    cells = spark.createDataFrame([(1, y, x, 0.01, 0.5, 0.5) for y in range(6) for x in range(6)], "frame_id long, y int, x int, r double, g double, b double")
    rects = spark.createDataFrame([(1, 1, 0, 0, 3, 5), (1, 2, 0, 0, 4, 4)], "frame_id long, cand_pos long, x0 int, y0 int, width int, height int")
    got = {r["cand_pos"]: r for r in areas.rectangle_statistics(cells, rects, F.col("r"), F.col("g"), F.col("b") > 0.4, 1.0).collect()}
    assert (got[1]["in_n"], got[1]["in_mean"], got[1]["in_black"], got[1]["in_edges"]) == (15, 0.0, 1.0, 0.0)
    assert (got[2]["in_n"], got[2]["in_mean"], got[2]["in_black"], got[2]["in_edges"]) == (16, pytest.approx(0.01), 1.0, 1.0)
    assert got[2]["in_valid"] == pytest.approx(16 / 36) and got[2]["in_std"] == pytest.approx(0, abs=1e-9)


def test_side_support_of_turned_rectangles(spark):
    rng = np.random.default_rng(4)
    edge = rng.random((60, 80)) < 0.4
    cells = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(edge), strict=True)], "frame_id long, y int, x int")
    sizes = spark.createDataFrame([(1, 60, 80)], "frame_id long, height int, width int")
    rects = [(1, i, float(rng.uniform(-10, 50)), float(rng.uniform(-10, 40)), float(rng.uniform(5, 70)), float(rng.uniform(5, 50)), float(rng.uniform(-45, 45))) for i in range(60)] + [(1, 77, 200.0, 200.0, 10.0, 10.0, 0.0)]
    got = {r["cand_pos"]: r for r in areas.side_support(cells, sizes, spark.createDataFrame(rects, "frame_id long, cand_pos long, x double, y double, width double, height double, angle double")).collect()}
    for _, i, x, y, w, h, angle in rects:
        a = math.radians(angle)
        p = [(x + w / 2 + sx * w / 2 * math.cos(a) - sy * h / 2 * math.sin(a), y + h / 2 + sx * w / 2 * math.sin(a) + sy * h / 2 * math.cos(a)) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        want = []
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            n = max(8, int(math.hypot(bx - ax, by - ay) / 5))
            at = [(round(ay * (1 - k / (n - 1)) + by * (k / (n - 1))), round(ax * (1 - k / (n - 1)) + bx * (k / (n - 1)))) for k in range(n)]
            hits = [edge[q] for q in at if 0 <= q[0] < 60 and 0 <= q[1] < 80]
            want.append(sum(hits) / len(hits) if hits else 0.0)
        assert [got[i][s] for s in ("top", "right", "bottom", "left")] == pytest.approx(want) and got[i]["support"] == pytest.approx(sum(want) / 4)
