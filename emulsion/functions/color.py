"""Tone and colour maths as column expressions.

An ``RGB`` is three double columns; a stage maps RGB to RGB. Nothing here is a UDF, so a chain of stages is one code-generated
projection. Parameters are Python numbers known when the plan is made, as sliders are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RGB(NamedTuple):
    r: Column
    g: Column
    b: Column

    def map(self, f: Callable[[Column], Column]) -> RGB:
        return RGB(*(f(c) for c in self))


def rgb(*names: str) -> RGB:
    return RGB(*(F.col(n) for n in (names or ("r", "g", "b"))))


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(c, num(low)), num(high))


def unit(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def finite(c: Column, nan: float, high: float, low: float) -> Column:
    """NaN and the infinities replaced."""
    return F.when(F.isnan(c), nan).when(c == float("inf"), high).when(c == float("-inf"), low).otherwise(c)


def luma709(p: RGB) -> Column:
    return p.r * 0.2126 + p.g * 0.7152 + p.b * 0.0722


def luma601(p: RGB) -> Column:
    return p.r * 0.299 + p.g * 0.587 + p.b * 0.114


def logistic(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, -60.0, 60.0)))


def smoothstep(low: float | Column, high: float | Column, c: Column) -> Column:
    t = unit((c - num(low)) / F.greatest(num(high) - num(low), F.lit(1e-5)))
    return t * t * (3.0 - 2.0 * t)


def hard_smoothstep(low: float | Column, high: float | Column, c: Column) -> Column:
    """A step where the edges meet."""
    span = num(high) - num(low)
    narrow = F.abs(span) <= 1e-6
    t = unit((c - num(low)) / F.when(narrow, 1.0).otherwise(span))
    return F.when(narrow, F.when(c >= num(high), 1.0).otherwise(0.0)).otherwise(t * t * (3.0 - 2.0 * t))


# Curve families, presets and limits of the print model.
LOG_FLOOR = 1e-6
MODE_CURVES = {
    "linear": (0.82, 1.25, 0.0),
    "filmic_hable": (1.0, 2.5, 0.0),
    "filmic_aces": (1.0, 2.5, 0.0),
    "soft": (1.0, 1.85, 0.0),
    "standard": (1.0, 3.0, 0.12),
    "contrast": (1.06, 3.35, 0.12),
    "contrast_shoulder": (1.06, 3.35, 0.12),
}
BEZIER_POINTS = {
    "soft": ((0.30, 0.16), (0.74, 0.86)),
    "standard": ((0.26, 0.11), (0.76, 0.92)),
    "contrast": ((0.20, 0.07), (0.82, 0.97)),
    "contrast_shoulder": ((0.20, 0.07), (0.70, 0.90)),
}
SEPARATION = ((1.0, -0.05, -0.02), (-0.04, 1.0, -0.08), (-0.01, -0.10, 1.0))
HABLE = {"a": 0.15, "b": 0.50, "c": 0.10, "d": 0.20, "e": 0.02, "f": 0.30}
ACES = {"a": 2.51, "b": 0.03, "c": 2.43, "d": 0.59, "e": 0.14}
TABLE_STEPS = 16383
CMY_PER_STEP, CMY_MANUAL_MAX, CMY_AUTO_MAX = 0.0009, 0.09, 0.04
GLOBAL_SCALE, TONAL_SCALE = 55.0, 75.0
GAMUT_LOW, GAMUT_HIGH = 1e-5, 1.0 - 1e-5


def bounded(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


@dataclass(frozen=True)
class PrintCurve:
    density: float
    grade: float
    highlight_bias: float = 0.0
    highlight_width: float = 0.55
    shadow_bias: float = 0.0
    shadow_width: float = 0.55
    soft_shadows: bool = False
    soft_highlights: bool = False

    @property
    def pivot(self) -> float:
        return bounded(0.99 - 0.2 * self.density, 0.02, 0.98)

    @property
    def slope(self) -> float:
        return bounded(1.0 + 1.75 * self.grade, 0.1, 16.0)


def print_curve(mode: str, exposure: int = 0, contrast: int = 0, custom: dict | None = None, **soft: bool) -> PrintCurve:
    """The curve of a mode and its sliders; with ``custom`` values the sliders don't count."""
    if custom is not None:
        limits = {"density": (0.5, 1.5), "grade": (1.0, 4.5), "highlight_bias": (-0.2, 0.3), "highlight_width": (0.2, 0.9), "shadow_bias": (-0.2, 0.3), "shadow_width": (0.2, 0.9)}
        start = {"density": 1.0, "grade": 3.0, "highlight_bias": 0.12, "highlight_width": 0.55, "shadow_bias": 0.0, "shadow_width": 0.55}
        return PrintCurve(**{k: bounded(custom.get(k, start[k]), *lim) for k, lim in limits.items()}, **soft)
    density, grade, bias = MODE_CURVES.get(mode, (1.0, 2.5, 0.0))
    return PrintCurve(bounded(density - exposure / 100.0, 0.05, 2.0), bounded(grade + contrast * 0.025, 0.1, 6.0), bias, **soft)


def on_table(c: Column, steps: int = TABLE_STEPS) -> Column:
    """``c`` on the nearest of evenly spaced values, halves to even: what a direct table look-up sees."""
    return F.rint(unit(c) * steps) / steps


def print_response(log_value: Column, curve: PrintCurve, offset: float | Column = 0.0) -> Column:
    """Print transmittance of a normalised log exposure: a logistic density with soft toe and shoulder and biased ends."""
    value = unit(log_value) + num(offset)
    away = value - curve.pivot
    toe_mask = logistic(2.5 * (away / max(1.0 - curve.pivot, LOG_FLOOR) - 0.5))
    shoulder_mask = logistic(-2.5 * (away / max(curve.pivot, LOG_FLOOR) + 0.5))
    shift, slope = away, F.lit(1.0)
    if curve.soft_shadows:
        turn = unit(4.0 * toe_mask * (1.0 - toe_mask))
        shift, slope = shift - 0.20 * 0.28 * turn, slope - 0.20 * 0.55 * turn
    if curve.soft_highlights:
        turn = unit(4.0 * shoulder_mask * (1.0 - shoulder_mask))
        shift, slope = shift + 0.20 * 0.25 * turn, slope - 0.20 * 0.45 * turn
    if curve.highlight_bias:
        knee = bounded(curve.highlight_width, 0.05, 0.95)
        shift = shift + curve.highlight_bias * smoothstep(0.0, knee, knee - unit(value))
    if curve.shadow_bias:
        shift = shift + curve.shadow_bias * smoothstep(1.0 - bounded(curve.shadow_width, 0.05, 0.95), 1.0, unit(value))
    density = 4.0 * logistic(curve.slope * shift * clip(slope, 0.1, 2.0))
    return unit(F.pow(F.lit(10.0), -density))


def hable(c: Column) -> Column:
    k = HABLE
    top = c * (k["a"] * c + k["c"] * k["b"]) + k["d"] * k["e"]
    return top / F.greatest(c * (k["a"] * c + k["b"]) + k["d"] * k["f"], F.lit(1e-6)) - k["e"] / k["f"]


def aces(c: Column) -> Column:
    k = ACES
    return c * (k["a"] * c + k["b"]) / F.greatest(c * (k["c"] * c + k["d"]) + k["e"], F.lit(1e-6))


def rational_curve(c: Column, mode: str) -> Column:
    """The filmic curves, scaled so that 1 stays 1; other modes leave the clipped value."""
    f = {"filmic_hable": hable, "filmic_aces": aces}.get(mode)
    return unit(c) if f is None else unit(f(unit(c)) / f(F.lit(1.0)))


def bezier_curve(c: Column, mode: str) -> Column:
    """y of a cubic curve from (0, 0) to (1, 1) at x, by six Newton steps."""
    (x1, y1), (x2, y2) = BEZIER_POINTS.get(mode, BEZIER_POINTS["standard"])

    def at(t: Column, a: float, b: float) -> Column:
        return 3.0 * (1.0 - t) * (1.0 - t) * t * a + 3.0 * (1.0 - t) * t * t * b + t * t * t

    def step(pair: Column, _: Column) -> Column:
        x, t = pair["x"], pair["t"]
        rise = 3.0 * (1.0 - t) * (1.0 - t) * x1 + 6.0 * (1.0 - t) * t * (x2 - x1) + 3.0 * t * t * (1.0 - x2)
        return F.struct(x.alias("x"), unit(t - (at(t, x1, x2) - x) / F.greatest(rise, F.lit(1e-5))).alias("t"))

    start = F.struct(unit(c).alias("x"), unit(c).alias("t"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda pair: unit(at(pair["t"], y1, y2)))


def curve_value(c: Column, mode: str) -> Column:
    if mode == "linear" or mode.startswith("filmic_"):
        return rational_curve(c, mode)
    return bezier_curve(c, mode)


def inverse_curve(target: Column, mode: str, steps: int = 24) -> Column:
    """Where a rising curve takes ``target``, by halving; meant for parameters, one row each."""

    def halve(span: Column, _: Column) -> Column:
        mid = (span["lo"] + span["hi"]) * 0.5
        low = curve_value(mid, mode) < unit(target)
        return F.struct(F.when(low, mid).otherwise(span["lo"]).alias("lo"), F.when(low, span["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda span: (span["lo"] + span["hi"]) * 0.5)


def hue_preserving(p: RGB, mode: str) -> RGB:
    """The least and greatest channel go through the curve; the third keeps its place between them."""
    q = p.map(unit)
    low, high = F.least(*q), F.greatest(*q)
    span = high - low
    bent = curve_value(low, mode)
    scale = F.when(span > 1e-6, (curve_value(high, mode) - bent) / F.when(span > 1e-6, span)).otherwise(0.0)
    return q.map(lambda c: unit(bent + (c - low) * scale))


def s_curve(c: Column, contrast: float = 1.85, strength: float = 0.58) -> Column:
    low, high = 1.0 / (1.0 + math.exp(contrast * 0.5)), 1.0 / (1.0 + math.exp(-contrast * 0.5))
    bent = unit((1.0 / (1.0 + F.exp(-contrast * (unit(c) - 0.5))) - low) / max(high - low, 1e-5))
    return unit(c) * (1.0 - strength) + bent * strength


def unit_levels(p: RGB, black: int, mid: int, white: int, soft_black: bool = False, clipped: bool = True) -> RGB:
    b, m, w = black / 100.0, mid / 100.0, white / 100.0
    if w > b + 1e-5:
        gamma = bounded(math.log(0.5) / math.log(bounded((m - b) / (w - b), 0.01, 0.99)), 0.2, 8.0)

        def level(c: Column) -> Column:
            x = (c - b) / (w - b)
            y = F.pow(F.greatest(x, F.lit(0.0)), F.lit(gamma))
            return F.when(x < 0.0, 0.004 * F.exp(F.least(x, F.lit(0.0)) / 0.10)).otherwise(0.004 + y * 0.996) if soft_black else y

        p = p.map(level)
    return p.map(unit) if clipped else p.map(lambda c: finite(c, 0.0, 1e12, 0.0))


def exposure(p: RGB, amount: int) -> RGB:
    return p.map(lambda c: F.greatest(c, F.lit(0.0)) * 2.0 ** (amount / 100.0))


def contrast(p: RGB, amount: int) -> RGB:
    return p.map(lambda c: unit((unit(c) - 0.5) * (1.0 + amount / 100.0) + 0.5))


def out_of_gamut(p: RGB) -> Column:
    return (F.least(*p) < 0.0) | (F.greatest(*p) > 1.0)


def compressed_gamut(df: DataFrame, frame_has_outside: Column) -> DataFrame:
    """``df`` with chroma of r, g, b pulled to the clamped luma by the largest scale that fits, and shadows' chroma some more.

    ``frame_has_outside`` tells whether any pixel of the image is out of gamut; if none is, all stay as they are. Each step is a
    projection of its own.
    """
    names = df.columns
    luma = F.col("_luma")
    limits = []
    for c in rgb():
        chroma = c - luma
        limits.append(F.when(chroma < -1e-6, (luma - GAMUT_LOW) / F.when(chroma < -1e-6, -chroma)))
        limits.append(F.when(chroma > 1e-6, (GAMUT_HIGH - luma) / F.when(chroma > 1e-6, chroma)))
    df = df.withColumn("_luma", clip(luma709(rgb()), GAMUT_LOW, GAMUT_HIGH)).withColumn("_scale", unit(F.coalesce(F.least(*limits), F.lit(1.0))))
    df = df.withColumns({f"_{n}": luma + (F.col(n) - luma) * F.col("_scale") for n in "rgb"})
    weight = F.when(out_of_gamut(rgb()), 1.0 - smoothstep(0.01, 0.12, luma)).otherwise(0.0)
    df = df.withColumns({"_again": clip(luma709(rgb("_r", "_g", "_b")), GAMUT_LOW, GAMUT_HIGH), "_weight": weight})
    pulled = lambda c: unit(F.when(F.col("_weight") > 0.0, F.col("_again") + (c - F.col("_again")) * (1.0 - 0.55 * F.col("_weight"))).otherwise(c))
    return df.withColumns({n: F.when(frame_has_outside, pulled(F.col(f"_{n}"))).otherwise(F.col(n)) for n in "rgb"}).select(*names)


def saturated(p: RGB, amount: int) -> RGB:
    """Chroma scaled around the luma, before the gamut is compressed; at 0 only clipped."""
    q = p.map(unit)
    if amount == 0:
        return q
    a = bounded(amount / 100.0, -1.0, 1.0)
    luma = luma709(q)
    return q.map(lambda c: luma + (c - luma) * (1.0 + a if a < 0 else 1.0 + 1.35 * a))


def matrix_mix(p: RGB, matrix: tuple[tuple[float, ...], ...], strength: float) -> RGB:
    """Row vector times the matrix, mixed with the identity."""
    s = bounded(strength, 0.0, 1.0)
    cell = [[(1.0 if i == j else 0.0) * (1.0 - s) + matrix[i][j] * s for j in range(3)] for i in range(3)]
    return RGB(*(p.r * cell[0][j] + p.g * cell[1][j] + p.b * cell[2][j] for j in range(3)))


def colour_separation(p: RGB, strength: float = 0.45) -> RGB:
    """A matrix of unit row sums on the densities."""
    if strength <= 0.0:
        return p
    rows = [[(1.0 if i == j else 0.0) * (1.0 - strength) + SEPARATION[i][j] * strength for j in range(3)] for i in range(3)]
    d = p.map(lambda c: -F.log10(clip(c, LOG_FLOOR, 1.0)))
    out = []
    for row in rows:
        total = max(sum(row), LOG_FLOOR)
        out.append(unit(F.pow(F.lit(10.0), -F.greatest(d.r * (row[0] / total) + d.g * (row[1] / total) + d.b * (row[2] / total), F.lit(0.0)))))
    return RGB(*out)


def tonal_weight(luma: Column, tonal_range: int, tone: str) -> Column:
    a = bounded(tonal_range / 100.0, 0.0, 1.0)
    if tone == "shadows":
        return 1.0 - smoothstep(0.0, 0.12 + 0.56 * a, luma)
    if tone == "highlights":
        return smoothstep(1.0 - (0.12 + 0.56 * a), 1.0, luma)
    return unit(1.0 - smoothstep(0.0, 1.0, F.abs(luma - 0.5) / (0.16 + 0.48 * a)))


@dataclass(frozen=True)
class Balance:
    """Slider steps of the three axes; for a tone also the range it covers."""

    red_cyan: int = 0
    green_magenta: int = 0
    blue_yellow: int = 0
    tonal_range: int = 50

    @property
    def axes(self) -> tuple[int, int, int]:
        return self.red_cyan, self.green_magenta, self.blue_yellow

    def gains(self, scale: float) -> tuple[float, float, float]:
        return tuple(2.0 ** (a / scale) for a in self.axes)


@dataclass(frozen=True)
class ColourBalance:
    overall: Balance = field(default_factory=Balance)
    tones: tuple[tuple[str, Balance], ...] = ()


def colour_balance(p: RGB, params: ColourBalance) -> RGB:
    """Gains over all, then gains weighted by tone, in logarithms; neutral axes change nothing."""
    tones = [(t, b) for t, b in params.tones if any(b.axes)]
    if not tones and not any(params.overall.axes):
        return p
    q = p.map(unit)
    luma = luma709(q)
    out = [c * g for c, g in zip(q, params.overall.gains(GLOBAL_SCALE), strict=True)]
    for tone, balance in tones:
        weight = tonal_weight(luma, balance.tonal_range, tone)
        for i, g in enumerate(balance.gains(TONAL_SCALE)):
            if abs(math.log(max(g, 1e-6))) > 1e-6:
                out[i] = out[i] * F.exp(weight * math.log(max(g, 1e-6)))
    return RGB(*(unit(c) for c in out))


def manual_offsets(balance: Balance) -> tuple[float, float, float]:
    return tuple(bounded(-a * CMY_PER_STEP, -CMY_MANUAL_MAX, CMY_MANUAL_MAX) for a in balance.axes)


def effective_offset(auto: Column, manual: float) -> Column:
    limit = CMY_AUTO_MAX + CMY_MANUAL_MAX
    return clip(F.coalesce(auto, F.lit(0.0)) + manual, -limit, limit)


def encoded(c: Column, full: int = 255) -> Column:
    """Gamma 2.2 to an integer of full scale ``full``, halves up."""
    return F.floor(F.pow(unit(c), F.lit(1.0 / 2.2)) * full + 0.5).cast("int")


def decoded(c: Column, full: int = 65535) -> Column:
    return F.pow(c.cast("double") / full, F.lit(2.2))


def srgb_to_linear(c: Column) -> Column:
    """The piecewise curve, not the power of 2.2 used elsewhere."""
    v = unit(c)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    v = unit(c)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)


def density(c: Column, floor: float = LOG_FLOOR) -> Column:
    return F.greatest(-F.log10(clip(c, floor, 1.0)), F.lit(0.0))


def radial_gain(x: Column, y: Column, width: Column, height: Column, strength: int = 0, radius: int = 100, centre: tuple[int, int] = (50, 50), smoothness: int = 200, max_gain: int = 200) -> Column:
    """Brightening that grows with the distance from the centre, for a lens that darkens its corners."""
    cx, cy = centre[0] / 100.0 * F.greatest(width - 1, F.lit(1)), centre[1] / 100.0 * F.greatest(height - 1, F.lit(1))
    reach = max(0.05, radius / 100.0) * F.greatest(width, height) * 0.5
    far = unit(F.sqrt(F.pow(x - cx, 2) + F.pow(y - cy, 2)) / reach)
    most = max(1.0, max_gain / 100.0)
    return clip(1.0 + max(0.0, strength / 100.0) * F.pow(far, F.lit(max(0.25, smoothness / 100.0))) * (most - 1.0), 1.0, most)


# Gains in logarithms, of unit luma.


def safe_gain(c: Column) -> Column:
    return clip(F.coalesce(F.when(F.isnan(c) | (F.abs(c) == float("inf")), 1.0).otherwise(c), F.lit(1.0)), 0.05, 20.0)


def unit_luma_gains(p: RGB) -> RGB:
    q = p.map(safe_gain)
    luma = F.greatest(luma601(q), F.lit(1e-6))
    return q.map(lambda c: c / luma)


def log_gain(c: Column) -> Column:
    return F.ln(safe_gain(c))


def scaled_gains(p: RGB, strength: float | Column) -> RGB:
    """Gains drawn towards identity."""
    return unit_luma_gains(unit_luma_gains(p).map(lambda c: F.exp(log_gain(c) * num(strength))))


def tone_knots(anchor: Column, shadows: int, highlights: int) -> dict[str, Column]:
    """Middle control point below (sx, sy) and above (hx, hy) the anchor, for the two sliders."""
    a = clip(anchor, 0.32, 0.62)
    s, h = bounded(shadows / 100.0, -1.0, 1.0), bounded(highlights / 100.0, -1.0, 1.0)
    sx, move = a * 0.62, a * 0.24 * abs(s)
    sy = F.least(a - 1e-4, sx + move) if s > 0 else F.greatest(F.lit(1e-5), sx - F.least(move, sx * 0.92))
    span = F.greatest(1.0 - a, F.lit(1e-5))
    hx, rise = a + span * 0.38, span * 0.27 * abs(h)
    hy = F.least(F.lit(1.0 - 1e-5), hx + rise) if h > 0 else F.greatest(a + 1e-4, hx - rise)
    return {"_a": a, "_sx": sx, "_sy": sy, "_hx": hx, "_hy": hy}


def knot_tangents(prefix: str, x: tuple[Column, Column, Column], y: tuple[Column, Column, Column]) -> list[dict[str, Column]]:
    """Columns to add in turn: tangents of a rising curve through three points (Fritsch and Carlson)."""
    s = [F.col(f"{prefix}s0"), F.col(f"{prefix}s1")]
    m = [F.col(f"{prefix}m{i}") for i in range(3)]

    def limit(i: int) -> dict[str, Column]:
        """Keeps the two tangents of segment i inside a circle of three slopes."""
        flat = s[i] <= 1e-8
        safe = F.when(flat, 1.0).otherwise(s[i])
        r2 = F.pow(F.greatest(m[i], F.lit(0.0)) / safe, 2) + F.pow(F.greatest(m[i + 1], F.lit(0.0)) / safe, 2)
        k = F.when(flat, 0.0).when(r2 > 9.0, 3.0 / F.sqrt(F.greatest(r2, F.lit(9.0)))).otherwise(1.0)
        return {f"{prefix}m{j}": F.greatest(m[j], F.lit(0.0)) * k for j in (i, i + 1)}

    slopes = {f"{prefix}s{i}": (y[i + 1] - y[i]) / (x[i + 1] - x[i]) for i in range(2)}
    return [slopes, {f"{prefix}m0": s[0], f"{prefix}m1": (s[0] + s[1]) * 0.5, f"{prefix}m2": s[1]}, limit(0), limit(1)]


def knot_value(prefix: str, x: Column, xs: tuple[Column, Column, Column], ys: tuple[Column, Column, Column]) -> Column:
    m = [F.col(f"{prefix}m{i}") for i in range(3)]

    def piece(i: int) -> Column:
        h = xs[i + 1] - xs[i]
        t = (x - xs[i]) / h
        return ys[i] + h * t * (m[i] + t * (3.0 * (ys[i + 1] - ys[i]) / h - 2.0 * m[i] - m[i + 1] + t * (m[i] + m[i + 1] - 2.0 * (ys[i + 1] - ys[i]) / h)))

    return F.when(x < xs[1], piece(0)).otherwise(piece(1))


def highlights_and_shadows(df: DataFrame, shadows: int, highlights: int) -> DataFrame:
    """``df`` (r, g, b, anchor) with its luma put through a tone table and the channels by the same ratio.

    The table has monotone cubic pieces through three points below and above the anchor. Above 1 the slope of what is left is
    lowered when highlights are recovered; lifted shadows have a largest ratio. Each step is a projection of its own, so that
    no expression is written out more than once.
    """
    if not shadows and not highlights:
        return df
    names = df.columns
    zero, one = F.lit(0.0), F.lit(1.0)
    a, sx, sy, hx, hy = (F.col(n) for n in ("_a", "_sx", "_sy", "_hx", "_hy"))
    low, high = ((zero, sx, a), (zero, sy, a)), ((a, hx, one), (a, hy, one))
    df = df.withColumns(dict(zip("rgb", (F.greatest(c, zero) for c in rgb()), strict=True)))
    df = df.withColumns(tone_knots(F.col("anchor"), shadows, highlights)).withColumn("_l", F.greatest(luma709(rgb()), zero)).withColumn("_x", on_table(F.col("_l")))
    for prefix, (xs, ys) in (("_lo", low), ("_hi", high)):
        for step in knot_tangents(prefix, xs, ys):
            df = df.withColumns(step)
    x = F.col("_x")
    y = F.when(x >= a, knot_value("_hi", x, *high) if highlights else x).otherwise(knot_value("_lo", x, *low) if shadows else x)
    df = df.withColumn("_y", F.when(x <= 0.0, 0.0).when(x >= 1.0, 1.0).otherwise(unit(y)))
    recovery = max(0.0, -highlights / 100.0)
    slope = 1.0 if recovery <= 0.0 else max(0.18, 0.55 * (1.0 - recovery))
    luma = F.col("_l")
    ratio = F.when(luma > 1e-5, (F.col("_y") + F.greatest(luma - 1.0, zero) * slope) / F.when(luma > 1e-5, luma)).otherwise(1.0)
    if shadows > 0:
        ratio = F.least(ratio, F.lit(1.0 + 2.8 * bounded(shadows / 100.0, 0.0, 1.0)))
    df = df.withColumn("_ratio", ratio)
    return df.withColumns({n: finite(F.col(n) * F.col("_ratio"), 0.0, 1e6, 0.0) for n in "rgb"}).select(*names)


def soft_tones(p: RGB, soft_highlights: bool, soft_shadows: bool, upper: Column) -> RGB:
    """The older soft ends; ``upper`` is the frame's 99.7th percentile of the luma above 0.72."""
    if not soft_highlights and not soft_shadows:
        return p
    q = p.map(lambda c: F.greatest(c, F.lit(0.0)))
    luma = F.greatest(luma709(q), F.lit(0.0))
    target = luma
    if soft_highlights:
        top = F.greatest(F.lit(1.0), F.coalesce(upper, F.lit(1.0)))
        weight = 0.42 * smoothstep(0.62, F.least(top, F.lit(1.0)), luma)
        x = F.greatest(target - 0.72, F.lit(0.0)) / (top - 0.72)
        bent = F.least(0.72 + 0.28 * (1.0 - F.exp(-2.4 * x)) / (1.0 - math.exp(-2.4)), F.lit(1.0))
        target = target * (1.0 - weight) + bent * weight
    if soft_shadows:
        mix = 0.46 * (1.0 - smoothstep(0.0, 0.30, luma))
        target = target * (1.0 - mix) + (0.018 + target * 0.76) * mix
    ratio = target / F.greatest(luma, F.lit(1e-5))
    out = q.map(lambda c: c * ratio)
    if soft_shadows:
        floor = 1.0 - smoothstep(0.0, 0.20, luma)
        out = out.map(lambda c: c * (1.0 - 0.18 * floor) + 0.018 * 0.65 * floor)
    return out
