"""Film base, inner frames, side effects, the choice of strength and the ensemble on small made-up cases, and stored masks and sessions."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
from emulsion.operators import detect, effects, layout, regional
from emulsion.sources import profiles, session
from pyspark.sql import functions as F

RASTER = "frame_id bigint, y int, x int, r double, g double, b double"


def plain_raster(frame, colour, size=40):
    return [(frame, y, x, *colour) for y in range(size) for x in range(size)]


def test_base_of_even_frames_dark_ones_and_none(spark):
    rows = plain_raster(1, (0.6, 0.5, 0.4)) + plain_raster(2, (0.01, 0.01, 0.01)) + plain_raster(3, (1.0, 1.0, 1.0))
    r = spark.createDataFrame(rows, RASTER)
    size = r.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    p = detect.base_patches(r, detect.edge_points(size))
    assert {x["frame_id"]: x["n"] for x in p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 28, 3: 28}
    got = {x["frame_id"]: x for x in detect.film_base(p).collect()}
    luma = 0.6 * 0.2126 + 0.5 * 0.7152 + 0.4 * 0.0722
    trust = 0.44 + 0.24 * (luma - 0.02) / 0.55 + 0.22 + 0.10 * (1 - 0.2 / 0.55)
    assert math.isclose(got[1]["confidence"], round(trust * 0.72 + 0.20 + 0.08, 3), abs_tol=1e-9)
    assert (got[1]["source"], got[1]["px"], got[1]["py"], got[1]["level"]) == ("edge-top", 4, 5, "high")
    none = spark.createDataFrame([], RASTER)
    assert detect.film_base(detect.base_patches(none, detect.edge_points(size))).count() == 0


def test_points_of_a_turned_frame_lie_outside_it(spark):
    r = spark.createDataFrame([(1, 100, 100, 200, 100, 30.0), (2, 10, 10, 0, 0, 0.0)], "frame_id bigint, x int, y int, width int, height int, angle double")
    got = detect.frame_points(r).collect()
    assert {x["frame_id"] for x in got} == {1} and len(got) == 20
    a = math.radians(30)
    for x in got:
        dx, dy = x["px"] - 200, x["py"] - 150
        u, v = dx * math.cos(a) + dy * math.sin(a), -dx * math.sin(a) + dy * math.cos(a)
        assert abs(u) > 100 or abs(v) > 50


def test_inner_frame_against_all_four_loops(spark):
    rng = random.Random(3)
    edges, want = [], {}
    for frame in range(12):
        side = {"left": [rng.randrange(20, 200) for _ in range(3)], "right": [rng.randrange(350, 620) for _ in range(3)], "top": [rng.randrange(15, 120) for _ in range(2)], "bottom": [rng.randrange(250, 460) for _ in range(4)]}
        side = {k: [(float(v), float(rng.randrange(20, 60))) for v in vs] for k, vs in side.items()}
        edges += [(frame, k, i, at, s) for k, vs in side.items() for i, (at, s) in enumerate(vs)]
        best = None
        for (le, a), (ri, b), (to, c), (bo, d) in itertools.product(*(side[k] for k in ("left", "right", "top", "bottom"))):
            w, h = ri - le + 1, bo - to + 1
            area = w * h / (640 * 480)
            clear = np.clip(min(le, to, 640 - le - w, 480 - to - h) / 12.0, 0, 1)
            if w < 179 or h < 134 or not 0.10 <= area <= 0.70 or min(w, h) < 76.8 or (clear < 0.12 and area > 0.62):
                continue
            fit = max(1 - np.clip(abs(math.log(w / h) - math.log(t)) / 0.42, 0, 1) for _, t in detect.INNER_FORMATS)
            centre = 1 - np.clip((abs((le + w / 2) / 640 - 0.5) * 2 + abs((to + h / 2) / 480 - 0.5) * 2) / 1.35, 0, 1)
            score = min((a + b + c + d) / 4 / 38, 1) * 0.28 + 0.5 * 0.20 + fit * 0.22 + clear * 0.10 + (1 - min(abs(area - 0.38) / 0.38, 1)) * 0.12 + centre * 0.08
            score = min(score, 0.98)
            if score >= 0.68 and (best is None or score > best[0] + 1e-9):
                best = (score, le, to, w, h)
        if best:
            want[frame] = best
    d = spark.createDataFrame(edges, "frame_id int, side string, pos int, at double, strength double")
    got = {r["frame_id"]: r for r in detect.inner_frame(d, 640, 480, F.lit(0.5)).collect()}
    assert set(got) == set(want) and len(want) > 5
    for k, (score, *rect) in want.items():
        assert math.isclose(got[k]["confidence"], score, abs_tol=1e-9) and [got[k][n] for n in ("x", "y", "width", "height")] == rect
    assert detect.inner_frame(d.limit(0), 640, 480).count() == 0


def test_distinct_values_keep_their_order(spark):
    d = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.2), (1, 2, 4.0), (1, 3, 4.34), (1, 4, 4.36), (2, 0, 1.0), (2, 1, 1.0)], "k int, o int, v double")
    got = [(r["k"], r["v"]) for r in detect.epsilon_distinct(d, ["k"], "v", "o").collect()]
    assert sorted(got) == [(1, 4.0), (1, 4.36), (1, 5.0), (2, 1.0)]


def test_strength_against_a_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for frame in range(60):
        before, kept = rng.random() * 0.1, None
        for i in range(rng.randrange(1, 7)):
            x = (float(i), rng.randrange(8) / 50, rng.choice(["", "", "green", "dark"]))
            rows.append((frame, i, x[0], before, x[1], x[2]))
            fine = x[2] == "" and x[1] <= before + max(0.003, before * 0.08)
            if kept is None or (kept[3] is False and (fine or (x[2] == "" and kept[2] != "") or (x[2] == kept[2] and x[1] < kept[1]))):
                kept = (*x, fine)
        want[frame] = kept[:3]
    d = spark.createDataFrame(rows, "frame_id int, pos int, strength double, before double, after double, warning string")
    assert {r["frame_id"]: (r["strength"], r["after"], r["warning"]) for r in effects.chosen_strength(d).collect()} == want


def test_no_harm_where_nothing_changes_or_frames_are_small(spark):
    rows = [(f, y, x, 0.3, 0.6, 0.2, k * 0.3, 0.6, k * 0.2) for f, k, n in ((1, 1.0, 20), (2, 1.6, 20), (3, 1.6, 5)) for y in range(n) for x in range(n)]
    d = spark.createDataFrame(rows, RASTER + ", ar double, ag double, ab double")
    got = {r["frame_id"]: (r["risk"], r["warning"]) for r in effects.side_effects(d).collect()}
    assert got[1] == (0.0, "") and got[3] == (0.0, "") and got[2][1] == "foliage hue drift" and got[2][0] >= 0.30


def test_ensemble_of_none_one_and_several(spark):
    names = "frame_id int, pos int, algorithm string, gain_r double, gain_g double, gain_b double, confidence double, score double, after double, warning string, before double"
    one = lambda f, p, a, g, c=0.5, s=0.5, after=0.01, w="": (f, p, a, g, 1.0, 1.0, c, s, after, w, 0.05)
    rows = [one(1, 0, "a", 1.1, s=0.05, w="weak"), one(1, 1, "b", 1.1, s=0.01), one(2, 0, "a", 1.3, c=0.4), one(2, 1, "identity", 1.0), one(3, 0, "a", 1.10), one(3, 1, "b", 1.12), one(3, 2, "c", 1.11), one(3, 3, "d", 3.0)]
    got = {r["frame_id"]: r for r in regional.ensemble(spark.createDataFrame(rows, names)).collect()}
    assert (got[1]["algorithm"], got[1]["gain_r"], got[1]["warning"], got[1]["counted"]) == ("identity", 1.0, "weak", 0)
    assert (got[2]["algorithm"], got[2]["gain_r"], got[2]["confidence"]) == ("a", 1.3, 0.4)
    assert got[3]["algorithm"] == "ensemble(a+b+c)" and got[3]["warning"] == ""
    luma = 1.11 * 0.299 + 0.587 + 0.114
    assert math.isclose(got[3]["gain_r"], 1.11 / luma, rel_tol=1e-9)


def test_masks_are_replaced_and_deleted(spark):
    cells = "mask string, y int, x int"
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], cells)
    changed = spark.createDataFrame([("b",), ("c",), ("d",), ("b",)], "mask string")
    new = spark.createDataFrame([("b", 2, 2), ("b", 2, 2), ("d", 3, 3), ("a", 9, 9)], cells)
    assert sorted(tuple(r) for r in profiles.replaced_masks(stored, changed, new).collect()) == [("a", 1, 1), ("b", 2, 2), ("d", 3, 3)]
    names = spark.createDataFrame([("IMG.1.cr3",), ("a/b\\c.nef",), ("x",)], "n string").select(profiles.mask_name(F.col("n"), "add")).collect()
    assert [r[0] for r in names] == ["IMG.1_dust_add", "a_b_c_dust_add", "x_dust_add"]


def test_documents_of_folders_with_only_exclusions(spark):
    states = spark.createDataFrame([("r1", "b.cr3", '{"file_size": 3}'), ("r1", "a.cr3", "{}")], "folder string, file_name string, j string").select("folder", "file_name", F.from_json("j", session.STATE).alias("state"))
    out = spark.createDataFrame([("r2", "z.cr3"), ("r2", "y.cr3"), ("r2", "z.cr3")], "folder string, file_name string")
    got = {r["folder"]: json.loads(r["document"]) for r in session.session_documents(states, out).collect()}
    assert list(got["r1"]) == sorted(got["r1"]) and list(got["r1"]["images"]) == ["a.cr3", "b.cr3"] and got["r1"]["images"]["b.cr3"] == {"file_size": 3}
    assert got["r2"] == {"app": "emulsion", "excluded_files": ["y.cr3", "z.cr3"], "images": {}, "schema_version": 1}


def test_timings_of_nothing_and_of_parts_alone(spark):
    d = spark.createDataFrame([([],), ([("Saturation", 1.26)],), ([("RAW decode", 2.0), ("PNG write", 0.5)],)], "s array<struct<name:string,seconds:double>>")
    assert [r[0] for r in d.select(layout.timings_text(F.col("s"))).collect()] == ["", "Saturation 1.3s, total 0.0s", "RAW decode 2.0s, PNG write 0.5s, total 2.5s"]


NAMES = "cx cy area angle_abs border format_score edge_support inside_range inside_std inside_luma outside_luma outside_std outside_black outside_valid".split()


def plain_score(v, transition):
    clip = lambda x: min(max(x, 0.0), 1.0)
    content = clip(v["inside_range"] / 0.34) * 0.55 + clip(v["inside_std"] / 0.18) * 0.45
    film = clip((v["outside_luma"] - 0.035) / 0.18) * 0.32 + clip(1 - v["outside_std"] / 0.2) * 0.23 + v["outside_valid"] * 0.15 + clip(1 - 1.2 * v["outside_black"]) * 0.1 + v["edge_support"] * 0.2
    step = clip((v["outside_luma"] - v["inside_luma"] + 0.015) / 0.24) * 0.58 + clip(v["edge_support"] / 0.32) * 0.22 + content * 0.2
    holder = clip(1.45 * v["outside_black"]) * 0.24 + v["edge_support"] * 0.26 + content * 0.25 + v["border"] * 0.1 + v["format_score"] * 0.15
    away = 2 * abs(v["cx"] - 0.5) + 2 * abs(v["cy"] - 0.5)
    shape = v["format_score"] * 0.36 + clip(1 - abs(v["area"] - 0.66) / 0.46) * 0.24 + v["border"] * 0.12 + clip(1 - away / 1.35) * 0.18 + clip(1 - v["angle_abs"] / 0.95) * 0.1
    around = max(0.62 * film + 0.38 * step, 0.82 * holder) if transition else max(film, holder)
    against = 0.18 * clip((v["area"] - 0.84) / 0.12) * clip((0.1 - v["border"]) / 0.1) + 0.12 * clip((0.2 - content) / 0.2)
    return 0.46 * around + 0.34 * shape + 0.2 * content - against


def test_prefilter_scores_by_cases(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    middle = dict.fromkeys(NAMES, 0.5) | {"outside_black": 0.1, "angle_abs": 0.1, "area": 0.66, "inside_luma": 0.2}
    cases = [middle] + [middle | {n: x} for n in NAMES for x in (0.0, 0.04, 0.12, 0.3, 0.85, 0.9, 1.0)]
    cases += [dict(zip(NAMES, rng.random(len(NAMES)).tolist(), strict=True)) for _ in range(300)]
    df = spark.createDataFrame([(i, *(c[n] for n in NAMES)) for i, c in enumerate(cases)], "cand_pos long, " + ", ".join(f"{n} double" for n in NAMES))
    for transition in (True, False):
        got = {r["cand_pos"]: r["score"] for r in detect.prefilter_score(df, transition).collect()}
        assert all(abs(got[i] - plain_score(c, transition)) < 1e-12 for i, c in enumerate(cases))
    score = lambda **v: plain_score(middle | v, True)
    assert score(area=0.99, border=0.0) < score(area=0.66) and score(inside_range=0.0, inside_std=0.0) < score() and score(outside_luma=0.1) < score()
    nulls = spark.createDataFrame([(1, *[None] * len(NAMES))], df.schema)
    assert detect.prefilter_score(nulls).first()["score"] is None
