"""Robust statistics at their thresholds, on small frames, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from emulsion.operators import ordered, stats
from pyspark.sql import functions as F

W = np.array([0.299, 0.587, 0.114])


def frame(spark, frames):
    rows = [(k, *map(float, p)) for k, ps in frames.items() for p in ps]
    return spark.createDataFrame(rows, "frame_id long, r double, g double, b double")


def neutral_np(p, clean, sat, spread):
    if clean.sum() < 16:
        return clean & False
    first = min(0.30, max(0.055, np.quantile(sat[clean], 0.35)))
    if (clean & (sat <= first)).sum() >= 64:
        return clean & (sat <= first)
    second = min(0.42, max(first, np.quantile(sat[clean], 0.55)))
    if (clean & (sat <= second)).sum() >= 64:
        return clean & (sat <= second)
    return clean & (spread <= min(0.14, max(0.045, np.quantile(spread[clean], 0.30))))


def cast_np(p):
    p = np.array(p, dtype=float)
    luma, hi, lo = p @ W, p.max(axis=1), p.min(axis=1)
    sat = (hi - lo) / np.maximum(hi, 1e-6)
    spread = np.abs(p - luma[:, None]).max(axis=1)
    clean = (luma >= 0.08) & (luma <= 0.94) & (lo >= 0.01) & (hi <= 0.985)
    sel = neutral_np(p, clean, sat, spread)
    if sel.sum() < 16:
        sel = clean
    if sel.sum() < 16:
        return 0.0
    res = p[sel] - luma[sel, None]
    far = np.linalg.norm(res - np.median(res, axis=0), axis=1)
    if len(far) >= 32:
        keep = far <= np.quantile(far, 0.85)
        if keep.sum() >= 16:
            res = res[keep]
    cast = np.median(res, axis=0)
    return float(np.linalg.norm(cast - cast @ W))


@pytest.mark.parametrize("seed", range(3))
def test_cast_metrics_at_every_count(spark, seed):
    rng = np.random.default_rng(seed)
    frames = {}
    for k, n in enumerate((1, 15, 16, 31, 32, 63, 64, 95, 96, 127, 128, 300)):
        base = rng.uniform(0.1, 0.9, (n, 1))
        frames[k] = np.clip(base + rng.normal(0, 0.05, (n, 3)) + [0.03, 0, -0.02], 0, 1)
    frames[50] = np.zeros((40, 3))
    frames[51] = np.ones((40, 3))
    frames[52] = np.tile([[0.9, 0.1, 0.1]], (200, 1))
    got = {r["frame_id"]: r["magnitude"] for r in stats.cast_metrics(frame(spark, frames), ["frame_id"]).collect()}
    for k, p in frames.items():
        assert got[k] == pytest.approx(cast_np(p), abs=1e-9), k


def test_exposure_of_odd_frames(spark):
    rows = {1: [(0.5, 0.5, 0.5)], 2: [(0.0, 0.0, 0.0)] * 5, 3: [(float("nan"), 0.1, 0.1), (float("inf"), 0, 0)], 4: [(1.0, 1.0, 1.0)] * 3}
    df = stats.exposure_metrics(frame(spark, rows), ["frame_id"]).withColumn("k", stats.exposure_class())
    got = {r["frame_id"]: r for r in df.collect()}
    assert got[3]["p50"] == 0.0 and got[3]["k"] == "extreme protected"
    assert got[2]["shadow_clip"] == 1.0 and got[4]["highlight_clip"] == 1.0
    empty = stats.exposure_metrics(frame(spark, {1: [(0.1, 0.1, 0.1)]}).limit(0), ["frame_id"])
    assert empty.count() == 0


def test_histogram_has_every_bin_and_closed_end(spark):
    df = frame(spark, {7: [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]})
    got = {r["bin"]: r["n"] for r in stats.luma_histogram(df, ["frame_id"], 16).collect()}
    assert len(got) == 16 and got[15] == 1 and got[0] == 1 and sum(got.values()) == 3


def test_flat_frame_normalises_without_dividing_by_zero(spark):
    df = frame(spark, {1: [(0.3, 0.3, 0.3)] * 10})
    out = stats.normalised_log(df, ["frame_id"], stats.log_bounds(df, ["frame_id"])).collect()
    assert all(r["r"] == 0.0 for r in out)


def weighted_median_np(v, w):
    order = np.argsort(v)
    upto = np.cumsum(w[order])
    return v[order][min(len(v) - 1, np.searchsorted(upto, w.sum() * 0.5))]


def test_weighted_median(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v), float(w)) for k in range(6) for v, w in zip(rng.integers(0, 9, k + 1), rng.integers(1, 4, k + 1), strict=True)]
    rows += [(9, 1.0, 1.0), (9, 2.0, 1.0)]  # half is reached exactly: the lower one
    got = {r["k"]: r["v"] for r in ordered.weighted_median(spark.createDataFrame(rows, "k int, v double, w double"), ["k"], ["v"], "w").collect()}
    for k in {r[0] for r in rows}:
        v, w = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        assert got[k] == weighted_median_np(v, w)
    assert got[9] == 1.0


@pytest.mark.parametrize("window", [3, 4, 17])
def test_moving_sum_at_the_edges(spark, window):
    v = np.arange(1.0, 9.0)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    got = [r["s"] for r in df.select("i", ordered.moving_sum(df, ["k"], "i", "v", window).alias("s")).orderBy("i").collect()]
    w = window if window % 2 else window + 1
    padded = np.concatenate([np.zeros(w), v, np.zeros(w)])
    want = [padded[w + i - w // 2 : w + i + w // 2 + 1].sum() / w for i in range(len(v))]
    assert np.allclose(got, want)


def test_bin_edges_follow_the_cut_of_even_spacing():
    assert ordered.bin_edges(832, 48)[27] == int(np.linspace(0, 832, 49)[27])
    assert ordered.bin_edges(100, 48)[-1] == 100


def test_curve_lookup_ends_and_knots(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 2.0)], "v double")
    curve = spark.createDataFrame([(0.0, 1.0), (0.5, 3.0), (1.0, 4.0)], "x double, y double")
    got = [r["toned"] for r in ordered.interpolated(df, "v", curve).orderBy("v").collect()]
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0, 3.5, 4.0, 4.0])


def test_white_balance_sample_falls_back(spark):
    rng = np.random.default_rng(1)
    few = frame(spark, {1: rng.uniform(0.2, 0.8, (100, 3))})
    s = stats.white_balance_sample(few, ["frame_id"], F.col("g"), (0.22, 0.78), (0.04, 0.96), 0.45)
    assert s.filter("sampled").count() == 100  # never under 128 rows by choice
