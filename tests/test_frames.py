"""Neighbourhood work against direct sums, and relations of rectangles, masks and plans."""

from __future__ import annotations

import math

import numpy as np
import pytest
from emulsion.operators import fits, frames, relate
from emulsion.sources import rasters
from pyspark.sql import functions as F

RNG = np.random.default_rng(7)


def test_gaussian_is_a_weighted_mean():
    a = RNG.random((9, 14))
    got = frames.gaussian(a, 1.0)
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    k /= k.sum()
    p = np.pad(a, 4, mode="reflect")
    want = sum(k[i] * k[j] * p[i : i + 9, j : j + 14] for i in range(9) for j in range(9))
    assert np.allclose(got, want) and np.allclose(frames.gaussian(np.full((6, 6), 0.3), 2.0), 0.3)


def test_components_by_flood_fill():
    for seed in range(8):
        mask = np.random.default_rng(seed).random((17, 23)) < 0.35
        got = frames.labelled(mask)
        seen = np.zeros_like(mask, int)
        n = 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            seen[y, x] = n
            while todo:
                a, b = todo.pop()
                for u in range(max(0, a - 1), min(17, a + 2)):
                    for v in range(max(0, b - 1), min(23, b + 2)):
                        if mask[u, v] and not seen[u, v]:
                            seen[u, v] = n
                            todo.append((u, v))
        assert (got == seen).all()
        big = np.bincount(seen.reshape(-1)) >= 3
        big[0] = False
        assert (frames.cleaned(mask, dilate=False) == big[seen]).all()
    assert (frames.labelled(np.ones((3, 3), bool)) == 1).all() and not frames.labelled(np.zeros((3, 3), bool)).any()


def test_area_resize_keeps_the_mean():
    a = RNG.random((30, 48))
    small = frames.area_resized(a, 16)
    assert small.shape == (10, 16) and np.allclose(small[0, 0], a[:3, :3].mean()) and math.isclose(small.mean(), a.mean(), rel_tol=1e-9)
    assert frames.area_resized(a, 99) is a


def test_upright_warp_is_a_crop():
    a = RNG.random((20, 30))
    got = frames.warped(a, (5, 4, 8, 6, 0.0))
    assert got.shape == (6, 8)
    for i, j in ((0, 0), (5, 7), (2, 3)):
        y, x = 4 + 6 * i / 5, 5 + 8 * j / 7
        y0, x0 = int(y), int(x)
        fy, fx = y - y0, x - x0
        want = (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy
        assert got[i, j] == pytest.approx(want)


def test_greedy_peaks():
    v = np.array([1, 9, 8, 1, 7, 1, 1, 7, 0.5])
    assert frames.greedy_peaks(v, 2.0, 2, 5) == [1, 4, 7]
    assert frames.greedy_peaks(v, 2.0, 4, 1) == [1] and frames.greedy_peaks(v, 99.0, 1, 5) == []


def plain_overlap(spark, pairs):
    names = [f"{p}_{n}" for p in "ab" for n in ("x", "y", "width", "height", "angle")]
    df = spark.createDataFrame([(i, *(float(v) for v in (*a, *b))) for i, (a, b) in enumerate(pairs)], "i int, " + ", ".join(f"{n} double" for n in names))
    return [r["iou"] for r in relate.rotated_overlaps(df, "a", "b").orderBy("i").collect()]


def test_rotated_overlap(spark):
    rng = np.random.default_rng(12)
    rects = [(*rng.uniform(0, 20, 2), *rng.uniform(2, 20, 2), rng.uniform(-45, 45)) for _ in range(60)]
    pairs = list(zip(rects, rects[1:] + rects[:1], strict=True))
    got, back = plain_overlap(spark, pairs), plain_overlap(spark, [(b, a) for a, b in pairs])
    assert plain_overlap(spark, [(r, r) for r in rects]) == pytest.approx([1.0] * 60) and got == pytest.approx(back, abs=1e-9)

    def inside(r, x, y):
        t = math.radians(r[4])
        dx, dy = x - r[0] - r[2] / 2, y - r[1] - r[3] / 2
        u, v = dx * math.cos(t) + dy * math.sin(t), -dx * math.sin(t) + dy * math.cos(t)
        return (abs(u) <= r[2] / 2) & (abs(v) <= r[3] / 2)

    x, y = np.meshgrid(np.linspace(-20, 60, 800), np.linspace(-20, 60, 800))
    for (a, b), iou in zip(pairs, got, strict=True):
        ia, ib = inside(a, x, y), inside(b, x, y)
        assert iou == pytest.approx((ia & ib).sum() / max(1, (ia | ib).sum()), abs=0.03)


def test_axis_overlap_matches_rotated(spark):
    rows = [tuple(float(v) for v in RNG.integers(1, 20, 8)) for _ in range(30)]
    rows += [(1.0, 1.0, 4.0, 4.0, 5.0, 1.0, 4.0, 4.0), (1.0, 1.0, 4.0, 4.0, 1.0, 1.0, 2.0, 4.0), (0.0, 0.0, 1.0, 1.0, 9.0, 9.0, 1.0, 1.0)]  # sides in common
    names = [f"{p}_{n}" for p in "ab" for n in ("x", "y", "width", "height")]
    got = [r["i"] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} double" for n in names)).select("k", relate.axis_iou("a", "b").alias("i")).orderBy("k").collect()]
    assert got == pytest.approx(plain_overlap(spark, [((*r[:4], 0.0), (*r[4:], 0.0)) for r in rows]), abs=1e-9)


def test_gain_cluster_against_all_pairs(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        rows = [(k, i, *map(float, rng.normal(0, 0.12, 3)), float(rng.uniform(0.1, 1))) for k, n in enumerate((1, 2, 3, 9, 40)) for i in range(n)]
        rows += [(9, i, float(i), 0.0, 0.0, 1.0) for i in range(5)] + [(10, i, 0.5, 0.5, 0.5, 1.0) for i in range(4)]
        df = spark.createDataFrame(rows, "k int, pos int, r double, g double, b double, w double")
        got = {(r["k"], r["pos"]): r["in_cluster"] for r in relate.gain_cluster(df, ["k"], "pos", ["r", "g", "b"], "w").collect()}
        for k in {r[0] for r in rows}:
            v, w = np.array([r[2:5] for r in rows if r[0] == k]), np.array([r[5] for r in rows if r[0] == k])
            best, score = np.ones(len(v), bool), (-1.0, -1.0, -1.0)
            if len(v) > 2:
                for i in range(len(v)):
                    d = np.linalg.norm(v - v[i], axis=1)
                    m = d <= 0.20
                    s = (round(w[m].sum(), 12), float(m.sum()), -round(float(np.average(d[m], weights=w[m])), 12))
                    if m.sum() >= 2 and s > score:
                        best, score = m, s
                if best.sum() < max(2, math.ceil(len(v) * 0.25)):
                    best[:] = True
            assert [got[k, i] for i in range(len(v))] == best.tolist(), (seed, k)


def test_pairing_prefers_by_suffix_and_drops_doubles(spark):
    names = ["A.CR3", "a.png", "A.tif", "A.jpg", "B.nef", "B.dng", "B.png", "C.raf", "C.jpg", "C.jpeg", "D.arw", "D_positive.dng", "D.TIFF", "E.txt"]
    files = spark.createDataFrame([(i, "f", n) for i, n in enumerate(names)], "file_id long, folder string, name string")
    got = {(r["stem"], r["negative_id"], r["positive_id"]) for r in relate.pair_files(files).collect()}
    assert got == {("A", 0, 2), ("D", 10, 12)}
    assert {r["name"] for r in relate.supported(files).collect()} == {"A.CR3", "B.nef", "B.dng", "C.raf", "D.arw"}


def test_restoring_null_matches_null(spark):
    files = spark.createDataFrame([("a", 1, 5), ("b", None, 5), ("c", 2, 5)], "name string, size long, mtime_ns long")
    saved = spark.createDataFrame([("a", 1, 5, 7), ("b", None, 5, 8), ("c", 3, 5, 9)], "name string, size long, mtime_ns long, rating int")
    assert {(r["name"], r["saved_rating"]) for r in relate.restored(files, saved).collect()} == {("a", 7), ("b", 8)}


def test_percent_values(spark):
    cases = {"20": 20, "20%": 20, "0.2": 20, "1": 100, "x": None, " 0.5% ": 50, "2.5": 2, "-3": -3}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", relate.percent_value(F.col("t")).alias("p")).collect()} == cases


def test_masks_follow_set_algebra(spark):
    mask = lambda cells: spark.createDataFrame([(y, x) for y, x in cells], "y int, x int")
    auto, added, protected = {(0, 0), (1, 1)}, {(1, 1), (2, 2)}, {(2, 2), (9, 9)}
    got = {tuple(r) for r in relate.composed_mask(mask(auto), mask(added), mask(protected), ["y", "x"]).collect()}
    assert got == (auto | added) - protected
    assert relate.composed_mask(mask([]), mask([]), mask(protected), ["y", "x"]).count() == 0


def test_fits_find_a_known_matrix(spark):
    m = np.array([[0.8, 0.1, 0.0], [0.05, 0.7, 0.1], [0.0, 0.1, 0.75]])
    x = RNG.uniform(0.05, 0.95, (500, 3))
    y = x @ m + 0.02
    y[:40] = RNG.uniform(0.01, 0.9, (40, 3))  # outliers
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y, strict=True)], "r double, g double, b double, tr double, tg double, tb double")
    assert np.allclose(fits.colour_matrix(df, ["r", "g", "b"], ["tr", "tg", "tb"]), np.vstack([m, np.full(3, 0.02)]), atol=2e-3)
    rows = fits.density_matrix(df, ["r", "g", "b"], ["tr", "tg", "tb"], ridge=1.0)
    assert np.allclose(rows.sum(axis=1), 1.0)
    assert (fits.camera_matrix(df.limit(3), ["r", "g", "b"], ["tr", "tg", "tb"]) == np.eye(3)).all()


def test_rasters_round_trip(spark, tmp_path):
    rows = [(y, x, (y * 7 + x) / 100, y / 10, x / 10) for y in range(5) for x in range(8)]
    file = tmp_path / "a.flat"
    file.write_bytes(rasters.flat_bytes(rows, 8, 5))
    spark.dataSource.register(rasters.FlatImages)
    got = spark.read.format("flat_image").option("paths", str(file)).load()
    assert got.count() == 40
    assert all(abs(r["r"] - (r["y"] * 7 + r["x"]) / 100) < 1e-4 for r in got.collect())
    px = got.withColumns({"roll_id": F.lit(1), "frame_id": F.lit(2)})
    rasters.write_pixels(px, str(tmp_path / "px"))
    back = rasters.read_pixels(spark, str(tmp_path / "px"), [1])
    assert rasters.cropped(back, 2, 1, 3, 2).count() == 6
    assert rasters.inset(back, ["frame_id"], 0.25).count() == 3 * 4 and rasters.inset(back, ["frame_id"], 0.0).count() == 40
    assert {(r["y"] * 8 + r["x"]) % 4 for r in rasters.strided(back, ["frame_id"], 10).collect()} == {0}


def slow_blur(a, sigma, reach):
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    h, w = a.shape
    at = lambda i, n: abs(i) if i < n else 2 * (n - 1) - i
    rows = np.array([[sum(k[o + reach] * a[at(y + o, h), x] for o in range(-reach, reach + 1)) for x in range(w)] for y in range(h)])
    return np.array([[sum(k[o + reach] * rows[y, at(x + o, w)] for o in range(-reach, reach + 1)) for x in range(w)] for y in range(h)])


def test_flat_field_gain_by_hand():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:24, 0:30]
    field = 0.9 - 0.02 * np.hypot(y - 12, x - 15) + rng.random((24, 30)) * 0.01
    got = frames.flat_field_gain(field, 4)
    safe = np.maximum(slow_blur(field, 2.0, 4), 1e-5)
    patch = np.s_[24 // 2 - 2 : 24 // 2 + 2, 30 // 2 - 3 : 30 // 2 + 3]
    gain = np.percentile(safe[patch], 70) / safe
    want = np.clip(gain / np.median(gain[patch]), 1.0, 2.0)
    assert np.allclose(got, want) and got.min() == 1.0 and got[0, 0] > 1.2
    assert (frames.flat_field_gain(np.full((20, 20), 0.5)) == 1.0).all() and frames.flat_field_gain(field * 0.0 + 1e-9, 4).max() == 1.0
    assert frames.flat_field_gain(np.where(x < 2, 1e-4, 0.9), 3).max() == 2.0


def test_protected_blend_by_hand():
    rng = np.random.default_rng(4)
    before, after = [rng.random((30, 26)) for _ in range(3)], [rng.random((30, 26)) for _ in range(3)]
    mask = np.zeros((30, 26), bool)
    mask[4:15, 6:18] = True
    got = frames.protected_blend(before, after, mask, 0.8)
    soft = np.minimum(np.maximum(mask, slow_blur(mask.astype(float), 1.2, 5)) * 0.8, 1.0)
    for a, b, g in zip(after, before, got, strict=True):
        assert np.allclose(g, a * (1 - soft) + b * soft)
    assert np.allclose(got[0][mask], 0.2 * after[0][mask] + 0.8 * before[0][mask]) and np.allclose(got[0][25:, 24:], after[0][25:, 24:])
    none = frames.protected_blend(before, after, np.zeros_like(mask), 0.8)
    assert all(np.allclose(a, b) for a, b in zip(none, after, strict=True))


def test_visual_midpoint_meets_its_target(spark):
    """Levels by the percentiles of the print, and a middle at which the rendered brightness crosses the target."""
    rng = np.random.default_rng(5)
    slope, pivot, bias = 7.0, 0.36, 0.12
    rows, pictures = [], {}
    for k, (lo, hi) in enumerate(((0.1, 0.9), (0.3, 0.6), (0.02, 0.4), (0.5, 0.98))):
        p = rng.uniform(lo, hi, (400, 3))
        pictures[k] = p
        rows += [(k, *map(float, v)) for v in p]
    got = {r["frame_id"]: r for r in frames.visual_midpoint(spark.createDataFrame(rows, "frame_id long, r double, g double, b double"), slope, pivot, bias).collect()}

    def brightness(p, black, mid, white):
        v = (np.clip(1 - p, 0, 1) - black) / (white - black)
        gamma = np.clip(np.log(0.5) / np.log(np.clip((mid - black) / (white - black), 0.01, 0.99)), 0.2, 8.0)
        v = 1 - np.clip(np.maximum(v, 0) ** gamma, 0, 1)
        t = np.clip((0.55 - v) / 0.55, 0, 1)
        density = 4 / (1 + np.exp(-slope * (v - pivot + bias * t * t * (3 - 2 * t))))
        y = 10**-density @ [0.2126, 0.7152, 0.0722]
        a, b, c, d = np.percentile(y, [12, 50, 60, 88])
        return 0.55 * b + 0.25 * c + 0.2 * y[(y >= a) & (y <= d)].mean()

    for k, p in pictures.items():
        y = np.clip(1 - p, 0, 1) @ [0.2126, 0.7152, 0.0722]
        black, white = np.percentile(y, [0.25, 99.75])
        black, white = black - 0.06 * (white - black), white + 0.085 * (white - black)
        if white - black < 0.54:
            black, white = (black + white) / 2 - 0.27, (black + white) / 2 + 0.27
        black = min(max(black, 0.0), 0.96)
        white = min(max(white, black + 0.04), 1.0)
        b, m, w = (got[k][n] for n in ("black_point", "mid_point", "white_point"))
        assert b == round(black * 100) and w == max(b + 4, round(white * 100))
        grid = np.linspace(black + 0.04 * (white - black), black + 0.74 * (white - black), 4001)
        shown = np.array([brightness(p, black, x, white) for x in grid[::40]])
        crossed = grid[::40][min(int((shown > 0.28).sum()), len(shown) - 1)]  # brightness falls as the middle rises
        assert (np.diff(shown) < 1e-9).all() and abs(m / 100 - crossed) < 0.02, (k, m, crossed)


def test_roll_summary_by_hand(spark):
    from collections import Counter
    from statistics import median

    from emulsion.plans import roll

    rng = np.random.default_rng(6)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [(i % 3, i, pick(["roll", "none", "review"]), pick(["none", "exposure brighten"]), pick(["normal", "extreme protected"]), round(float(rng.random()) * 0.1, 5), round(float(rng.random()) * 0.1, 5), bool(rng.random() < 0.4)) for i in range(41)]
    df = spark.createDataFrame(rows, "roll_id long, frame_id long, color_action string, exposure_action string, exposure_class string, before_cast double, safe_after_cast double, used boolean")
    got = {r["roll_id"]: r for r in roll.summary(df).collect()}
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        text = lambda i, own=own: ",".join(f"{a}={n}" for a, n in sorted(Counter(r[i] for r in own).items()))
        assert (got[k]["actions"], got[k]["exposures"], got[k]["classes"]) == (text(2), text(3), text(4))
        assert (got[k]["frames"], got[k]["used"], got[k]["worsened"]) == (len(own), sum(r[7] for r in own), sum(r[6] > r[5] + 0.003 for r in own))
        assert got[k]["median_before"] == pytest.approx(round(median(r[5] for r in own), 5)) and got[k]["max_after"] == max(r[6] for r in own)
