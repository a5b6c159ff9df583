"""The regional candidate against numpy, tile by tile."""

from __future__ import annotations

import numpy as np
import pytest
from emulsion.operators import regional
from emulsion.operators.scratch import settled

from .test_roll import cluster, logs, weighted_median
from .test_stats import W, neutral_np

SIDE = 104


def pictures():
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:SIDE, 0:SIDE] / (SIDE - 1)
    base = np.clip(0.2 + 0.5 * (x + y) / 2 + rng.normal(0, 0.06, (SIDE, SIDE)), 0.06, 0.9)
    even = np.clip(base[..., None] * [1.05, 1.0, 0.95] + rng.normal(0, 0.01, (SIDE, SIDE, 3)), 0, 1)
    mixed = even.copy()
    mixed[:26, :52] = np.clip(base[:26, :52, None] * [0.6, 0.8, 1.2], 0, 1)  # sky
    mixed[52:78, :26] = 0.02  # night
    mixed[52:78, 26:52] = np.clip(base[52:78, 26:52, None] * [0.5, 1.0, 0.4], 0, 1)  # leaves
    mixed[78:, 78:] = 0.5  # flat
    dark = np.full((SIDE, SIDE, 3), 0.03)
    return {1: np.round(even, 6), 2: np.round(mixed, 6), 3: dark, 4: np.round(even[:90, :90], 6)}


def vote(p):
    p = p.reshape(-1, 3)
    luma, hi, lo = p @ W, p.max(axis=1), p.min(axis=1)
    sat = (hi - lo) / np.maximum(hi, 1e-6)
    p25, p50, p75, p95 = np.percentile(luma, [25, 50, 75, 95])
    if p50 <= 0.08 or p50 >= 0.88:
        return "extreme midtone"
    if p95 <= 0.28 or p95 >= 0.992:
        return "extreme highlight"
    if np.mean(luma <= 0.01) >= 0.08 or np.mean(luma >= 0.99) >= 0.05:
        return "clipping"
    if p75 - p25 <= 0.045:
        return "low dynamic range"
    r, g, b = p.T
    sky = np.mean((b > r * 1.05) & (b >= g * 0.98) & (luma >= 0.34) & (sat >= 0.08))
    leaf = np.mean((g > r * 1.04) & (g > b * 1.08) & (luma >= 0.12) & (sat >= 0.30))
    red = np.mean((r > g * 1.08) & (r > b * 1.15) & (luma >= 0.16) & (sat >= 0.42))
    if np.mean(luma <= 0.18) >= 0.70 or (p50 <= 0.18 and p75 <= 0.34):
        return "shadow dominant"
    for share, limit, text in ((sky, 0.46, "sky dominated"), (leaf, 0.46, "foliage dominated"), (red, 0.40, "skin or red object dominated"), (np.mean(sat >= 0.48), 0.42, "high saturation scene")):
        if share >= limit:
            return text
    scene = 0.55 if sky >= 0.28 else 0.50 if leaf >= 0.28 else 0.55 if red >= 0.24 else 1.0
    clean = (luma >= 0.07) & (luma <= 0.95) & (lo >= 0.008) & (hi <= 0.988)
    if clean.sum() < 96:
        return "too few clean pixels"
    if np.median(sat[clean]) >= 0.40:
        return "high saturation"
    sel = neutral_np(p, clean, sat, np.abs(p - luma[:, None]).max(axis=1))
    if sel.sum() < 64:
        return "not enough neutral pixels"
    if sel.sum() / clean.sum() < 0.045:
        return "low neutral fraction"
    q, ql = p[sel], luma[sel]
    d = np.linalg.norm(q - np.median(q, axis=0), axis=1)
    if len(d) >= 96 and (d <= np.quantile(d, 0.78)).sum() >= 64:
        keep = d <= np.quantile(d, 0.78)
        q, ql = q[keep], ql[keep]
    gains = logs(np.median(ql) / np.median(q, axis=0))
    weight = (0.30 + 0.30 * np.clip(1 - np.median(sat[sel]) / 0.32, 0, 1) + 0.25 * np.clip((p75 - p25) / 0.22, 0, 1) + 0.15 * min(1, sel.sum() / 800)) * scene
    return gains, weight


def test_votes_and_candidate(spark):
    frames = pictures()
    rows = [(k, int(y), int(x), *map(float, a[y, x])) for k, a in frames.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    raster = spark.createDataFrame(rows, "frame_id long, y int, x int, r double, g double, b double")
    votes = settled(regional.tile_votes(raster))
    got = {(r["frame_id"], r["tile_row"], r["tile_col"]): r for r in votes.collect()}
    assert {k[0] for k in got} == {1, 2, 3} and len(got) == 48
    out = {r["frame_id"]: r for r in regional.regional_candidate(votes).collect()}
    for k in (1, 2, 3):
        a, n = frames[k], SIDE // 4
        told = {(i, j): vote(a[i * n : (i + 1) * n, j * n : (j + 1) * n]) for i in range(4) for j in range(4)}
        good = {t: v for t, v in told.items() if not isinstance(v, str)}
        for (i, j), v in told.items():
            r = got[k, i, j]
            if isinstance(v, str):
                assert r["reject"] == v, (k, i, j)
            else:
                assert r["reject"] == "" and np.allclose([r["l_r"], r["l_g"], r["l_b"]], v[0], atol=1e-9) and r["weight"] == pytest.approx(v[1])
        assert (out[k]["accepted"], out[k]["rejected"]) == (len(good), 16 - len(good))
        if len(good) < 3:
            assert out[k]["gain_r"] is None
            continue
        v, w = np.array([x[0] for x in good.values()]), np.array([x[1] for x in good.values()])
        keep = cluster(v, w)
        if keep.sum() < 3:
            keep[:] = True
        centre = np.array([weighted_median(v[keep][:, i], w[keep]) for i in range(3)])
        spread = np.average(np.linalg.norm(v[keep] - centre, axis=1), weights=w[keep])
        assert out[k]["counted"] == keep.sum() and out[k]["agreement"] == pytest.approx(max(0, min(1, 1 - spread / 0.26)))
        assert np.allclose(logs([out[k][f"gain_{c}"] for c in "rgb"]), logs(np.exp(centre)), atol=1e-9)
    assert out[1]["accepted"] >= 12 and out[2]["rejected"] >= 4 and out[3]["accepted"] == 0
