"""The roll plan against numpy, frame by frame."""

from __future__ import annotations

import math

import numpy as np
import pytest
from emulsion.operators.scratch import settled
from emulsion.plans import roll, views
from emulsion.plans.roll_queries import with_rolls

SF = "/root/testdata/sf0.01"
W = np.array([0.299, 0.587, 0.114])


def logs(g):
    g = np.clip(np.asarray(g, float), 0.05, 20)
    return np.log(g / (g @ W))


def weighted_median(v, w):
    order = np.argsort(v, kind="stable")
    upto = np.cumsum(w[order])
    return v[order][min(len(v) - 1, int(np.searchsorted(upto, w.sum() * 0.5 - 1e-12)))]


def cluster(v, w):
    best, score = np.ones(len(v), bool), (-1.0, -1.0, -1.0)
    if len(v) <= 2:
        return best
    for i in range(len(v)):
        d = np.linalg.norm(v - v[i], axis=1)
        m = d <= 0.20
        s = (round(w[m].sum(), 12), float(m.sum()), -round(float(np.average(d[m], weights=w[m])), 12))
        if m.sum() >= 2 and s > score:
            best, score = m, s
    return best if best.sum() >= max(2, math.ceil(len(v) * 0.25)) else np.ones(len(v), bool)


@pytest.fixture(scope="module")
def planned(spark):
    px, fr = with_rolls(spark, SF)
    work = settled(roll.frame_work(px, fr))
    base = settled(roll.baseline(work))
    return px, work, base, settled(roll.frame_plans(px, work, base))


def test_baseline(planned):
    _, work, base, _ = planned
    frames = sorted(work.collect(), key=lambda r: r["frame_id"])
    for b in base.collect():
        own = [r for r in frames if r["roll_id"] == b["roll_id"]]
        used = [r for r in own if r["used"]]
        assert b["analysed"] == len(own)
        if len(used) < 2:
            assert b["warning"] == "not enough reliable frames for roll baseline"
            continue
        v, w = np.array([logs([r[f"frame_{c}"] for c in "rgb"]) for r in used]), np.array([max(0.01, r["confidence"]) for r in used])
        keep = cluster(v, w)
        first = np.array([weighted_median(v[keep][:, i], w[keep]) for i in range(3)])
        d = np.linalg.norm(v - first, axis=1)
        mid = np.median(d[keep])
        mad = np.median(np.abs(d[keep] - mid))
        kept = keep & (d <= max(0.16, mid + 2.5 * max(mad, 0.018)))
        if kept.sum() < 2:
            kept[:] = True
        final = np.array([weighted_median(v[kept][:, i], w[kept]) for i in range(3)])
        assert np.allclose(logs([b[f"roll_{c}"] for c in "rgb"]), logs(np.exp(final)), atol=1e-9)
        assert b["kept_frames"] == [r["frame_id"] for r, k in zip(used, kept, strict=True) if k]
        spread = np.average(np.linalg.norm(v[kept] - final, axis=1), weights=w[kept])
        n = int(kept.sum())
        want = 0.35 * min(1, n / 8) + 0.30 * min(1, n / len(own) / 0.55) + 0.35 * max(0, min(1, 1 - spread / 0.18))
        assert b["confidence"] == pytest.approx(want, abs=6e-4)


def test_plans_keep_their_promises(planned, spark):
    _, work, base, plans = planned
    rows = plans.collect()
    assert len(rows) == work.count() == views.frames(spark, SF).count()
    for r in rows:
        gains = np.array([r[f"safe_{c}"] for c in "rgb"])
        assert gains @ W == pytest.approx(1.0)
        assert 0 <= r["membership"] <= 1
        if r["color_action"] in roll.IDENTITY:
            assert np.allclose(gains, 1.0) and r["safe_after_cast"] == r["before_cast"]
        assert r["color_action"] in {"none", "review", "roll", "frame-only", "roll+frame"}
    rolls = {b["roll_id"]: b for b in base.collect()}
    for r in rows:
        if r["color_action"] == "roll":
            assert len(rolls[r["roll_id"]]["kept_frames"]) >= 2
    applied = plans.select("frame_id", "color_action", *(c.alias(n) for n, c in zip("rgb", roll.combined_gains(), strict=True))).collect()
    assert all(np.allclose([a[c] for c in "rgb"], 1.0) for a in applied if a["color_action"] in roll.IDENTITY)


def test_rolls_of_no_one_and_two_usable_frames(spark):
    rng = np.random.default_rng(4)

    def frame(k, tint):
        base = rng.uniform(0.15, 0.85, (900, 1))
        return [(k, *map(float, p)) for p in np.clip(base * tint + rng.normal(0, 0.004, (900, 3)), 0.012, 0.98)]

    tint = np.array([1.06, 1.0, 0.94])
    px = [*frame(1, np.ones(3)), *frame(2, tint), *frame(3, np.ones(3)), *frame(4, tint), *frame(5, tint * [1.01, 1, 1])]
    px = settled(spark.createDataFrame(px, "frame_id long, r double, g double, b double"))
    fr = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)], "frame_id long, roll_id int")
    work = settled(roll.frame_work(px, fr))
    assert {r["frame_id"]: r["used"] for r in work.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    base = {b["roll_id"]: b for b in settled(roll.baseline(work)).collect()}
    assert base[0]["used_count"] == 0 and base[0]["confidence"] == 0.0 and base[0]["roll_r"] == pytest.approx(1.0)
    assert base[1]["used_count"] == 1 and 0 < base[1]["confidence"] < 0.45
    assert base[2]["used_count"] == 2 and base[2]["roll_r"] < 1.0 < base[2]["roll_b"]
