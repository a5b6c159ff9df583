"""Grids and corner rectangles against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from emulsion.operators import grids

WIDTH, HEIGHT = 300, 200


def plain_clamp(x, y, w, h):
    w, h = max(1, min(w, WIDTH)), max(1, min(h, HEIGHT))
    return max(0, min(x, WIDTH - w)), max(0, min(y, HEIGHT - h)), w, h


def plain_angle(a):
    a = (a + 45) % 90
    return 45.0 if a == 0 else a - 45


def plain_grid(x, y, w, h, angle, count):
    x, y, w, h = plain_clamp(x, y, w, h)
    angles = []
    for a in (angle, 0.0, angle - 1.2, angle + 1.2):
        a = plain_angle(a)
        if all(abs(a - b) >= 0.35 for b in angles):
            angles.append(a)
    sx, sy = max(1, round(w * 0.018)), max(1, round(h * 0.018))
    out, seen = [], set()
    for i, j in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1), (-2, 0), (2, 0), (0, -2), (0, 2)):
        for s in (1.0, 0.985, 1.015, 0.97, 1.03):
            nw, nh = max(12, round(w * s)), max(12, round(h * s))
            box = plain_clamp(round(x + w / 2 + i * sx - nw * 0.5), round(y + h / 2 + j * sy - nh * 0.5), nw, nh)
            for a in angles:
                if (*box, round(a * 10)) not in seen:
                    seen.add((*box, round(a * 10)))
                    out.append((*box, round(a, 6)))
    return out[:count]


def test_grid_is_that_of_a_loop(spark):
    rng = np.random.default_rng(1)
    guesses = [(i, int(rng.integers(-20, 250)), int(rng.integers(-20, 150)), int(rng.integers(5, 320)), int(rng.integers(5, 220)), float(rng.choice([0.0, 0.2, -1.2, 44.0, 45.0, 12.3, -44.9, 90.0]))) for i in range(25)]
    df = spark.createDataFrame(guesses, "frame_id long, x int, y int, width int, height int, angle double")
    for count in (40, 260):
        got: dict = {}
        for r in grids.prior_grid(df, WIDTH, HEIGHT, count).orderBy("frame_id", "place").collect():
            got.setdefault(r["frame_id"], []).append((r["x"], r["y"], r["width"], r["height"], round(r["angle"], 6)))
        assert got == {i: plain_grid(*g, count) for i, *g in guesses}


def score_of(a, b):
    return 1 - min(max(abs(math.log(max(a, 0.05)) - math.log(max(b, 0.05))) / 0.42, 0), 1)


def centre(x, y, w, h):
    return 1 - min(max((abs((x + w / 2) / WIDTH - 0.5) * 2 + abs((y + h / 2) / HEIGHT - 0.5) * 2) / 1.45, 0), 1)


def plain_corner_rectangles(corners):
    by: dict = {}
    for c in corners:
        _, x, y, _, _ = c
        if x != WIDTH / 2 and y != HEIGHT / 2:
            by.setdefault(("t" if y < HEIGHT / 2 else "b") + ("l" if x < WIDTH / 2 else "r"), []).append(c)
    by = {q: sorted(v, key=lambda c: (not c[4], -c[3], c[0]))[:5] for q, v in by.items()}
    out = []
    for kind, p, q in (("falling", "tl", "br"), ("rising", "tr", "bl")):
        for _, ax, ay, sa, _ in by.get(p, []):
            for _, bx, by_, sb, _ in by.get(q, []):
                left, top, bw, bh = min(ax, bx), min(ay, by_), abs(ax - bx), abs(ay - by_)
                if bw < WIDTH * 0.24 or bh < HEIGHT * 0.24 or not 0.10 <= bw * bh / (WIDTH * HEIGHT) <= 0.94:
                    continue
                for r in grids.RATIOS:
                    fw, fh = (bh * r, bh) if bw / bh >= r else (bw, bw / r)
                    box = plain_clamp(round(left + bw / 2 - fw / 2), round(top + bh / 2 - fh / 2), max(12, round(fw)), max(12, round(fh)))
                    out.append((kind, *box, (sa + sb) * 0.38 + score_of(bw / bh, r) * 0.25 + box[2] * box[3] / (bw * bh) * 0.22 + centre(*box) * 0.15))
    for kind, p, q in (("top", "tl", "tr"), ("bottom", "bl", "br"), ("left", "tl", "bl"), ("right", "tr", "br")):
        flat = kind in ("top", "bottom")
        for _, ax, ay, sa, _ in by.get(p, []):
            for _, bx, by_, sb, _ in by.get(q, []):
                (a1, a2), (b1, b2) = ((ax, ay), (bx, by_)) if flat else ((ay, ax), (by_, bx))
                span, at = abs(a1 - b1), round((a2 + b2) / 2)
                if span < (WIDTH if flat else HEIGHT) * 0.24:
                    continue
                for r in grids.RATIOS:
                    deep = span / r if flat else span * r
                    start = at if kind in ("top", "left") else at - deep
                    if not start <= (HEIGHT if flat else WIDTH) / 2 <= start + deep:
                        continue
                    box = (min(a1, b1), round(start), span, round(deep)) if flat else (round(start), min(a1, b1), round(deep), span)
                    box = plain_clamp(*box)
                    clear = min(max(min(box[0], box[1], WIDTH - box[0] - box[2], HEIGHT - box[1] - box[3]) / max(8.0, min(WIDTH, HEIGHT) * 0.04), 0), 1)
                    out.append((kind, *box, (sa + sb) * 0.42 + score_of(box[2] / max(box[3], 1), r) * 0.25 + centre(*box) * 0.18 + clear * 0.15))
    return sorted((*o[:-1], round(o[-1], 9)) for o in out)


def test_corner_rectangles_by_loops(spark):
    rng = np.random.default_rng(3)
    corners = {k: [(i, int(rng.integers(0, WIDTH)), int(rng.integers(0, HEIGHT)), float(np.round(rng.uniform(0.34, 1), 3)), bool(rng.random() < 0.6)) for i in range(n)] for k, n in ((1, 40), (2, 6), (3, 1), (4, 90))}
    df = spark.createDataFrame([(k, *c) for k, cs in corners.items() for c in cs], "frame_id long, pos long, x int, y int, score double, bright boolean")
    best = grids.best_corners(df, WIDTH, HEIGHT).groupBy("frame_id", "quadrant").count().collect()
    assert max(r["count"] for r in best) == 5
    got: dict = {}
    for r in grids.corner_rectangles(df, WIDTH, HEIGHT).collect():
        got.setdefault(r["frame_id"], []).append((r["kind"], r["x"], r["y"], r["width"], r["height"], round(r["score"], 9)))
    for k, cs in corners.items():
        have, want = sorted(got.get(k, [])), plain_corner_rectangles(cs)
        assert [x[:5] for x in have] == [x[:5] for x in want]
        assert [x[5] for x in have] == pytest.approx([x[5] for x in want], abs=1e-8)
    assert len(got[4]) > 100
