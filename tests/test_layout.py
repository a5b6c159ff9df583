"""Flips and turns against numpy and back, strokes, labels, inverse curves."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from emulsion.functions import color as c
from emulsion.operators import layout, stats
from pyspark.sql import functions as F

H, W = 3, 5


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(x, y, y * W + x) for y in range(H) for x in range(W)], "x int, y int, v int")


def test_turns_match_numpy_and_their_inverse(spark, cells):
    a = np.arange(H * W).reshape(H, W)
    for across, down, k in itertools.product((False, True), (False, True), range(-1, 5)):
        b = a[:, ::-1] if across else a
        b = b[::-1] if down else b
        want = np.rot90(b, -k)
        shown = layout.laid_out(cells, F.lit(W), F.lit(H), across, down, k)
        x, y = layout.source_place((F.col("x"), F.col("y")), F.lit(W), F.lit(H), across, down, k)
        for r in shown.withColumns({"sx": x, "sy": y}).collect():
            assert want[r["y"], r["x"]] == r["v"] and a[r["sy"], r["sx"]] == r["v"]
    x, y = layout.source_place((F.lit(99), F.lit(-4)), F.lit(W), F.lit(H))
    assert tuple(cells.select(x, y).first()) == (W - 1, 0)  # outside goes to the border


def test_stroke_and_label(cells):
    one = cells.filter(layout.in_stroke(F.col("x"), F.col("y"), (1, 1), (1, 1), 1.0)).count()
    line = cells.filter(layout.in_stroke(F.col("x"), F.col("y"), (0, 1), (4, 1), 0.5)).count()
    assert (one, line) == (5, 5)
    label = layout.rectangle_label(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(-7.25))
    assert cells.select(label).first()[0] in ("x=1, y=2, w=3, h=4, angle=-7.3", "x=1, y=2, w=3, h=4, angle=-7.2")


def test_inverse_curve_undoes_the_curve(spark):
    d = spark.createDataFrame([(i / 50,) for i in range(1, 50)], "t double")
    for mode in ("linear", "filmic_hable", "standard", "contrast"):
        back = d.select("t", c.curve_value(c.inverse_curve(F.col("t"), mode), mode).alias("v")).collect()
        assert all(r["v"] == pytest.approx(r["t"], abs=1e-4) for r in back)


def test_stretch_leaves_flat_channels(spark):
    d = spark.createDataFrame([(1, i / 100, 0.4, 1.0) for i in range(101)], "frame_id int, r double, g double, b double")
    got = stats.channel_stretch(d, ["frame_id"], 0.1, 0.9).agg(F.min("r"), F.max("r"), F.min("g"), F.max("g")).first()
    assert tuple(got) == pytest.approx((0.0, 1.0, 0.4, 0.4))


def test_split_is_the_same_again_and_near_its_share(spark):
    d = spark.range(4000).select(layout.held_back(F.col("id")).cast("int").alias("t"))
    assert d.agg(F.avg("t")).first()[0] == pytest.approx(0.25, abs=0.03)
