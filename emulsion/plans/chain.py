"""The whole development of a negative as one plan: each stage on or off, all limits of a frame as windows over one exchange."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as c
from ..operators import stats

KEY = ["frame_id"]
LEVELS_OFF = (0, 50, 100)


@dataclass(frozen=True)
class Look:
    """What to do. A stage whose value is as it is here is off and adds nothing to the plan."""

    #: Black, middle and white point of the positive, in percent.
    levels: tuple[int, int, int] = LEVELS_OFF
    soft_black: bool = False
    #: Strength of the automatic offsets, 0 for none, and offsets of one's own for red, green and blue.
    auto_offsets: float = 0.65
    manual_offsets: tuple[float, float, float] = (0.0, 0.0, 0.0)
    curve: c.PrintCurve = field(default_factory=lambda: c.print_curve("standard"))
    camera: tuple[tuple[float, ...], ...] | None = None
    camera_strength: float = 1.0
    separation: float = 0.0
    balance: c.ColourBalance | None = None
    #: Gains of a roll's plan, from columns of the pixels.
    roll: tuple[str, str, str] | None = None
    shadows: int = 0
    highlights: int = 0
    saturation: int = 0


def checked(pixels: DataFrame, look: Look) -> DataFrame:
    """``pixels`` if it has what ``look`` needs; else an error before any work is done."""
    missing = [n for n in (*KEY, "r", "g", "b", *(look.roll or ())) if n not in pixels.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    black, mid, white = look.levels
    if not 0 <= black < mid < white <= 100:
        raise ValueError("levels must rise from 0 to 100")
    return pixels


def normalised(pixels: DataFrame, percent: float = 0.02) -> DataFrame:
    """r, g, b as logarithms between each frame's bounds."""
    logs = {n: stats.bounded_log(F.col(n)) for n in "rgb"}
    d = stats.beside(pixels, KEY, **{f"_q{n}": stats.bounds(v, percent) for n, v in logs.items()})
    scaled = {n: stats.between_bounds(v, F.get(f"_q{n}", 0), F.get(f"_q{n}", 1)) for n, v in logs.items()}
    return d.withColumns(scaled).drop(*(f"_q{n}" for n in "rgb"))


def with_offsets(d: DataFrame, strength: float) -> DataFrame:
    """offset_r, offset_g, offset_b of each frame's own sample beside its pixels."""
    s = stats.log_sample(d, KEY)
    s = stats.beside(s, KEY, **{f"_m{n}": F.median(F.when(F.col("sampled"), c.unit(F.col(n)))) for n in "rgb"})
    return s.withColumns(stats.offsets_of(c.rgb("_mr", "_mg", "_mb"), strength)).drop("sampled", *(f"_m{n}" for n in "rgb"))


def developed(pixels: DataFrame, look: Look, gamut) -> tuple[DataFrame, c.RGB]:
    """The pixels before they are encoded, and their channels; other columns of ``pixels`` stay.

    ``gamut`` brings saturated channels back into the gamut where a frame has some outside.
    """
    d = normalised(checked(pixels, look))
    if look.levels != LEVELS_OFF or look.soft_black:
        raised = c.unit_levels(c.rgb().map(lambda v: 1.0 - v), *look.levels, soft_black=look.soft_black)
        d = d.withColumns({n: c.unit(1.0 - v) for n, v in zip("rgb", raised, strict=True)})
    offsets: list[Column] = [F.lit(0.0)] * 3
    if look.auto_offsets > 0:
        d = with_offsets(d, look.auto_offsets)
        offsets = [F.col(f"offset_{n}") for n in "rgb"]
    offsets = [o if not own else c.effective_offset(o, own) for o, own in zip(offsets, look.manual_offsets, strict=True)]
    d = d.withColumns({n: c.print_response(c.on_table(F.col(n)), look.curve, o) for n, o in zip("rgb", offsets, strict=True)}).drop(*(f"offset_{n}" for n in "rgb"))

    def stage(d: DataFrame, p: c.RGB) -> DataFrame:
        return d.withColumns(dict(zip("rgb", p, strict=True)))

    if look.camera is not None:
        d = stage(d, c.matrix_mix(c.rgb(), look.camera, look.camera_strength))
    if look.separation > 0:
        d = stage(d, c.colour_separation(c.rgb(), look.separation))
    if look.balance is not None:
        d = stage(d, c.colour_balance(c.rgb(), look.balance))
    if look.roll is not None:
        d = stage(d, c.RGB(*(F.col(n) * F.col(g) for n, g in zip("rgb", look.roll, strict=True))))
    if look.shadows or look.highlights:
        d = stats.beside(d, KEY, _middle=stats.finite_quantile(c.luma709(c.rgb()), 0.55)).withColumn("anchor", stats.anchor_of(F.col("_middle")))
        d = c.highlights_and_shadows(d, look.shadows, look.highlights)
    d = d.select(*pixels.columns)
    if look.saturation:
        return gamut(d, c.saturated(c.rgb(), look.saturation))
    return d, c.rgb()
