"""The development chain: each stage on and off against the stages one by one, and how often it moves the pixels."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from emulsion.functions import color as c
from emulsion.operators import stats
from emulsion.plans import chain
from emulsion.plans import layout_queries as lq
from emulsion.plans import pixel_queries as px
from pyspark.sql import functions as F

KEY = ["frame_id"]


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, *map(float, rng.uniform(0.02 + 0.1 * k, 0.5 + 0.1 * k, 3) ** (1.0, 1.1, 1.3)), 1.0 + 0.01 * k, 1.0, 0.98) for k in range(4) for i in range(300)] + [(9, 0, 0.5, 0.5, 0.5, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "frame_id long, i long, r double, g double, b double, gain_r double, gain_g double, gain_b double")


def one_by_one(d, look):
    """Each stage by its own grouped limits and a join."""
    d = stats.normalised_log(d, KEY, stats.log_bounds(d, KEY))
    set_ = lambda d, p: d.withColumns({f"_{n}": x for n, x in zip("rgb", p, strict=True)}).drop("r", "g", "b").withColumnsRenamed({f"_{n}": n for n in "rgb"})
    if look.levels != (0, 50, 100) or look.soft_black:
        d = set_(d, c.unit_levels(c.rgb().map(lambda v: 1.0 - v), *look.levels, soft_black=look.soft_black).map(lambda v: c.unit(1.0 - v)))
    if look.auto_offsets > 0:
        d = stats.on(d, stats.auto_offsets(d, KEY, look.auto_offsets), KEY)
    else:
        d = d.withColumns({f"offset_{n}": F.lit(0.0) for n in "rgb"})
    shift = [c.effective_offset(F.col(f"offset_{n}"), m) if m else F.col(f"offset_{n}") for n, m in zip("rgb", look.manual_offsets, strict=True)]
    d = set_(d, c.RGB(*(c.print_response(c.on_table(F.col(n)), look.curve, o) for n, o in zip("rgb", shift, strict=True))))
    if look.camera is not None:
        d = set_(d, c.matrix_mix(c.rgb(), look.camera, look.camera_strength))
    if look.separation:
        d = set_(d, c.colour_separation(c.rgb(), look.separation))
    if look.balance is not None:
        d = set_(d, c.colour_balance(c.rgb(), look.balance))
    if look.roll:
        d = set_(d, c.RGB(*(F.col(n) * F.col(f"gain_{n}") for n in "rgb")))
    if look.shadows or look.highlights:
        d = c.highlights_and_shadows(stats.on(d, stats.tone_anchor(d, KEY), KEY), look.shadows, look.highlights)
    if look.saturation:
        d, p = px.gamut(d, c.saturated(c.rgb(), look.saturation))
        d = set_(d, p)
    return d


STAGES = ("levels", "soft_black", "auto_offsets", "manual_offsets", "camera", "separation", "balance", "roll", "shadows", "highlights", "saturation")


@pytest.mark.parametrize("off", [*STAGES, "none", "all"])
def test_each_stage_on_and_off(spark, pixels, off):
    plain = chain.Look(auto_offsets=0.0)
    look = plain if off == "all" else lq.FULL if off == "none" else dataclasses.replace(lq.FULL, **{off: getattr(plain, off)})
    d, p = chain.developed(pixels, look, px.gamut)
    got = {(r[0], r[1]): r[2:] for r in d.select("frame_id", "i", *p).collect()}
    want = {(r[0], r[1]): r[2:] for r in one_by_one(pixels, look).select("frame_id", "i", "r", "g", "b").collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)], atol=1e-9)
    if off in STAGES:  # and the stage does something
        full = {(r[0], r[1]): r[2:] for r in (lambda x: x[0].select("frame_id", "i", *x[1]))(chain.developed(pixels, lq.FULL, px.gamut)).collect()}
        assert not np.allclose([got[k] for k in sorted(got)], [full[k] for k in sorted(got)], atol=1e-4)


def test_one_exchange_and_one_scan(spark, sf):
    for name in ("display_chain", "export_chain", "full_chain"):
        plan = getattr(lq, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1, name


def test_what_is_missing_is_said_before_any_work(pixels):
    with pytest.raises(ValueError, match="gain_r"):
        chain.developed(pixels.drop("gain_r"), lq.FULL, px.gamut)
    with pytest.raises(ValueError, match="levels"):
        chain.developed(pixels, chain.Look(levels=(50, 20, 90)), px.gamut)
