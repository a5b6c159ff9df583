"""Column expressions against numpy versions written from the formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from emulsion.functions import color as c
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

GRID = [0.0, 1e-7, 0.01, 0.02, 0.1, 0.25, 0.46, 0.5, 0.62, 0.75, 0.9, 0.99, 1.0]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return np.array([r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()], dtype=float)


def step(lo, hi, x):
    t = np.clip((x - lo) / max(hi - lo, 1e-5), 0, 1)
    return t * t * (3 - 2 * t)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@pytest.mark.parametrize("mode", ["linear", "soft", "standard", "contrast", "other"])
@pytest.mark.parametrize("soft", [False, True])
def test_print_response(spark, mode, soft):
    curve = c.print_curve(mode, exposure=15, contrast=-10, soft_shadows=soft, soft_highlights=soft)
    x = np.array(GRID) + 0.013
    v = np.clip(GRID, 0, 1) + 0.013
    d = v - curve.pivot
    toe, sh = logistic(2.5 * (d / (1 - curve.pivot) - 0.5)), logistic(-2.5 * (d / curve.pivot + 0.5))
    tt, ss = np.clip(4 * toe * (1 - toe), 0, 1), np.clip(4 * sh * (1 - sh), 0, 1)
    k = 0.2 if soft else 0.0
    adj = d - k * 0.28 * tt + k * 0.25 * ss + curve.highlight_bias * step(0, 0.55, 0.55 - np.clip(v, 0, 1))
    want = np.clip(10 ** (-4 * logistic(curve.slope * adj * np.clip(1 - k * 0.55 * tt - k * 0.45 * ss, 0.1, 2))), 0, 1)
    got = column(spark, GRID, lambda v: c.print_response(v, curve, 0.013))
    assert np.allclose(got, want, atol=1e-12) and len(x) == len(got)
    assert (np.diff(got) <= 1e-12).all()  # more exposure of the negative, less light in the print


def test_custom_curve_is_clamped():
    p = c.print_curve("soft", 50, 50, custom={"density": 9, "grade": 0, "shadow_bias": 1})
    assert (p.density, p.grade, p.shadow_bias, p.highlight_bias) == (1.5, 1.0, 0.3, 0.12)


@pytest.mark.parametrize("mode", list(c.BEZIER_POINTS))
def test_bezier_curve(spark, mode):
    (x1, y1), (x2, y2) = c.BEZIER_POINTS[mode]
    at = lambda t, a, b: 3 * (1 - t) ** 2 * t * a + 3 * (1 - t) * t * t * b + t**3
    t = np.linspace(0, 1, 200_001)
    want = np.interp(GRID, at(t, x1, x2), at(t, y1, y2))
    assert np.allclose(column(spark, GRID, lambda v: c.bezier_curve(v, mode)), want, atol=2e-4)


def test_rational_curves_keep_one(spark):
    for mode in ("filmic_hable", "filmic_aces"):
        got = column(spark, [0.0, 0.5, 1.0, 2.0], lambda v, m=mode: c.rational_curve(v, m))
        assert got[2] == got[3] == 1.0 and 0 <= got[0] < got[1] < 1


def test_levels_and_encoding(spark):
    x = np.array(GRID)
    gamma = math.log(0.5) / math.log((0.42 - 0.08) / 0.87)
    got = column(spark, GRID, lambda v: c.unit_levels(c.RGB(v, v, v), 8, 42, 95).r)
    assert np.allclose(got, np.clip(np.maximum((x - 0.08) / 0.87, 0) ** gamma, 0, 1), atol=1e-12)
    same = column(spark, GRID, lambda v: c.unit_levels(c.RGB(v, v, v), 40, 50, 40).r)
    assert np.allclose(same, x)
    assert column(spark, GRID, lambda v: c.encoded(v)).tolist() == np.floor(x ** (1 / 2.2) * 255 + 0.5).tolist()
    assert np.allclose(column(spark, GRID, lambda v: c.linear_to_srgb(c.srgb_to_linear(v))), x, atol=1e-7)


def test_not_finite_values(spark):
    got = column(spark, [float("nan"), float("inf"), float("-inf"), -1.0], lambda v: c.finite(v, 0.0, 9.0, -9.0))
    assert got.tolist() == [0.0, 9.0, -9.0, -1.0]


def test_on_table_rounds_half_to_even(spark):
    got = column(spark, [0.5 / 4, 1.5 / 4, 2.5 / 4], lambda v: c.on_table(v, 4))
    assert got.tolist() == [0.0, 0.5, 0.5]


def pixels(spark, values):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "i int, r double, g double, b double")


def test_gamut_compression(spark):
    values = [(1.2, 0.5, -0.1), (0.3, 0.3, 0.3), (0.0, 1.0, 0.5), (0.02, -0.01, 0.03), (2.0, 2.0, 2.0)]
    df = pixels(spark, values)
    out = np.array([list(r)[1:] for r in c.compressed_gamut(df, F.lit(True)).select("i", "r", "g", "b").orderBy("i").collect()])
    assert (out >= 0).all() and (out <= 1).all()
    luma = lambda p: p @ np.array([0.2126, 0.7152, 0.0722])
    v = np.array(values)
    assert np.allclose(luma(out), np.clip(luma(v), 1e-5, 1 - 1e-5), atol=1e-9)  # hue and luma stay
    untouched = c.compressed_gamut(df, F.lit(False)).select("r", "g", "b").collect()
    assert [tuple(r) for r in untouched] == [tuple(map(float, x)) for x in values]


def hermite(xs, ys, x):
    s = np.diff(ys) / np.diff(xs)
    m = np.array([s[0], (s[0] + s[1]) / 2, s[1]])
    for i in range(2):
        if s[i] <= 1e-8:
            m[i] = m[i + 1] = 0
            continue
        m[i], m[i + 1] = max(0, m[i]), max(0, m[i + 1])
        r = math.hypot(m[i] / s[i], m[i + 1] / s[i])
        if r > 3:
            m[i], m[i + 1] = 3 / r * m[i], 3 / r * m[i + 1]
    j = 0 if x < xs[1] else 1
    h, t = xs[j + 1] - xs[j], (x - xs[j]) / (xs[j + 1] - xs[j])
    return (2 * t**3 - 3 * t**2 + 1) * ys[j] + (t**3 - 2 * t**2 + t) * h * m[j] + (3 * t**2 - 2 * t**3) * ys[j + 1] + (t**3 - t**2) * h * m[j + 1]


@pytest.mark.parametrize("shadows,highlights", [(0, 0), (60, 0), (-100, 0), (0, 80), (0, -100), (40, -55), (100, 100)])
def test_highlights_and_shadows(spark, shadows, highlights):
    values = [(v, v, v) for v in (*GRID, 1.3)]
    df = pixels(spark, values).withColumn("anchor", F.lit(0.44))
    got = np.array([r["g"] for r in c.highlights_and_shadows(df, shadows, highlights).orderBy("i").collect()])
    a, s, h = 0.44, shadows / 100, highlights / 100
    for x, g in zip((*GRID, 1.3), got, strict=True):
        q = round(min(x, 1) * 16383) / 16383
        y = q
        if s and q <= a:
            sx, d = a * 0.62, a * 0.24 * abs(s)
            y = hermite((0, sx, a), (0, min(a - 1e-4, sx + d) if s > 0 else max(1e-5, sx - min(d, sx * 0.92)), a), q)
        if h and q >= a:
            hx, d = a + (1 - a) * 0.38, (1 - a) * 0.27 * abs(h)
            y = hermite((a, hx, 1), (a, min(1 - 1e-5, hx + d) if h > 0 else max(a + 1e-4, hx - d), 1), q)
        y = 0.0 if q <= 0 else 1.0 if q >= 1 else min(max(y, 0), 1)
        slope = 1.0 if h >= 0 else max(0.18, 0.55 * (1 + h))
        ratio = (y + max(x - 1, 0) * slope) / x if x > 1e-5 else 1.0
        if s > 0:
            ratio = min(ratio, 1 + 2.8 * s)
        assert g == pytest.approx(x * ratio if (shadows or highlights) else x, abs=1e-9)
    assert (np.diff(got) >= -1e-9).all()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-1, 30) for _ in range(3)]), min_size=1, max_size=20))
def test_normalised_gains_have_unit_luma(spark, gains):
    df = pixels(spark, gains)
    p = c.unit_luma_gains(c.rgb())
    for r in df.select(*(x.alias(n) for x, n in zip(p, "rgb", strict=True))).collect():
        assert 0.299 * r["r"] + 0.587 * r["g"] + 0.114 * r["b"] == pytest.approx(1.0)


def test_neutral_balance_changes_nothing(spark):
    p = c.rgb()
    assert c.colour_balance(p, c.ColourBalance()) is p
    assert c.manual_offsets(c.Balance(100, -200, 0)) == (-0.09, 0.09, 0.0)
