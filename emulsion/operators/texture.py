"""Local texture and detail, tile by tile: structure tensors, bands of detail under a soft threshold, unsharp masking.

Neighbourhoods are worked through in tiles with a margin, limits that depend on a whole frame are grouped percentiles between
them, so no task holds a frame.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .frames import gaussian, sobel

TINY = 1e-6


def tensor_coherence(gx: np.ndarray, gy: np.ndarray, sigma: float) -> np.ndarray:
    """Difference over sum of the eigenvalues of the structure tensor (the blurred outer product of the gradient with itself).

    Both follow from its trace and determinant: 1 where all gradients around lie on a line, 0 where they point all ways.
    """
    xx, yy, xy = (gaussian(p, sigma) for p in (gx * gx, gy * gy, gx * gy))
    trace, determinant = xx + yy, xx * yy - xy * xy
    return np.clip(np.sqrt(np.maximum(trace * trace - 4.0 * determinant, 0.0)) / (trace + TINY), 0.0, 1.0)


# Fixed values of the texture map: the width of each blur; a cell is an edge from this share of the frame's percentile of gradients;
# how repeated and lone detail are weighed; the percentiles between which the result is spread.
NOISE, DENSITY, TENSOR, ENERGY, BACKGROUND, RESULT = 1.25, 4.0, 3.0, 2.5, 7.0, 2.0
EDGE_PERCENTILE, EDGE_SHARE = 0.92, 0.35
REPEATED, LONE = 0.72, 0.28
SPREAD = (0.55, 0.985)


def gradients(luma: np.ndarray) -> dict[str, np.ndarray]:
    base = gaussian(luma, NOISE)
    gx, gy = sobel(base)
    return {"base": base, "gx": gx, "gy": gy, "steep": np.hypot(gx, gy)}


def structure(base: np.ndarray, gx: np.ndarray, gy: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Detail that repeats: many edges near by, in many directions; and, for less, what stands out of the background there."""
    dense = gaussian(edge, DENSITY)
    astray = 1.0 - tensor_coherence(gx, gy, TENSOR)
    repeated = gaussian(np.hypot(gx, gy), ENERGY) * (0.35 + 0.85 * dense) * (0.45 + 0.75 * astray)
    return REPEATED * repeated + LONE * dense * np.abs(base - gaussian(base, BACKGROUND))


def texture_map(luma: DataFrame, side: int = tiles.SIDE) -> DataFrame:
    """frame_id, y, x, texture (0 to 1) of ``luma`` (frame_id, y, x, v): how busy the surroundings of each cell are.

    A lone edge counts little. A frame without structure, or with the same everywhere, is 0. Cells that aren't there are 0 in ``v``;
    rows without a place are left out.
    """
    first = tiles.haloed(luma, ["v"], "base double, gx double, gy double, steep double", gradients, tiles.blur_reach(NOISE) + 1, side)
    first = tiles.settled(first)
    limit = first.groupBy("frame_id").agg((F.percentile("steep", F.lit(EDGE_PERCENTILE)) + TINY).alias("limit"))
    marked = first.join(limit, "frame_id").withColumn("edge", (F.col("steep") > EDGE_SHARE * F.col("limit")).cast("double"))
    widest = tiles.blur_reach(max(DENSITY, TENSOR, ENERGY, BACKGROUND))
    second = tiles.settled(tiles.haloed(marked, ["base", "gx", "gy", "edge"], "s double", lambda *a: {"s": structure(*a)}, widest, side))
    ends = second.groupBy("frame_id").agg(F.percentile("s", F.array(*(F.lit(q) for q in SPREAD))).alias("ends"))
    low, high = F.get("ends", 0), F.get("ends", 1)
    shown = F.when(high - low > TINY, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("s") - low) / (high - low)))).otherwise(0.0)
    third = second.join(ends, "frame_id").select("frame_id", "y", "x", shown.alias("t"))
    return tiles.haloed(third, ["t"], "texture double", lambda t: {"texture": gaussian(t, RESULT)}, tiles.blur_reach(RESULT), side)


@dataclass(frozen=True)
class Band:
    """Detail between two blurs: what counts as noise, what it may add at most, how strongly, and its part in the strength."""

    threshold: float
    limit: float
    gain: float
    part: float

    def shaped(self, d: np.ndarray) -> np.ndarray:
        """Soft threshold, then bent towards the limit."""
        soft = np.sign(d) * np.maximum(np.abs(d) - self.threshold, 0.0)
        return soft / (1.0 + np.abs(soft) / self.limit)


# Fixed values of the detail stage: both bands; the fine blur's range, the coarse one's width in fine ones and its least; where
# strength begins to count and counts in full, and below which nothing is added; share and power of either end's protection; the
# amount at which unsharp masking adds the difference once.
FINE, COARSE = Band(1.5, 10.0, 0.16, 1.0), Band(1.0, 16.0, 0.28, 0.75)
FINE_WIDTH, COARSE_WIDTHS, COARSE_LEAST = (0.30, 2.50), 2.35, 0.45
STRENGTH, LEAST_STRENGTH = (1.5, 11.0), 2.0
SHADOW_END, HIGHLIGHT_END = (0.92, 2.2), (0.72, 2.0)
SHARPEN_ONCE = 90.0


def eight_bit(a: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(a + 0.5, 0, 255))


def band_widths(radius: float) -> tuple[float, float]:
    fine = float(np.clip(radius, *FINE_WIDTH))
    return fine, max(COARSE_LEAST, fine * COARSE_WIDTHS)


def with_detail(y: np.ndarray, amount: int, radius: float, shadows: int, highlights: int) -> np.ndarray:
    """8-bit ``y`` with its own detail added in two bands: not where there is little, and less towards the protected ends."""
    if amount <= 0:
        return y
    blurs = [y, *(gaussian(y, w) for w in band_widths(radius))]
    bands = list(zip((FINE, COARSE), blurs[:-1] - np.array(blurs[1:]), strict=True))
    strength = sum(b.part * np.abs(d) for b, d in bands)
    lit = y / 255.0
    protection = 1.0
    for percent, (share, power), end in ((shadows, SHADOW_END, 1.0 - lit), (highlights, HIGHLIGHT_END, lit)):
        protection = protection * (1.0 - share * np.clip(percent / 100.0, 0.0, 1.0) * end**power)
    counts = np.where(strength < LEAST_STRENGTH, 0.0, np.clip((strength - STRENGTH[0]) / (STRENGTH[1] - STRENGTH[0]), 0.0, 1.0))
    return eight_bit(y + min(amount, 100) / 100.0 * counts * protection * sum(b.gain * b.shaped(d) for b, d in bands))


def unsharp(y: np.ndarray, amount: int, radius: float, threshold: int) -> np.ndarray:
    """8-bit ``y``, moved away from its blur where they differ by ``threshold`` or more."""
    if amount <= 0 or radius <= 0.0:
        return y
    away = y - gaussian(y, max(0.1, radius))
    return eight_bit(np.where(np.abs(away) < threshold, y, y + away * (amount / SHARPEN_ONCE)))


def detailed(eight_bit_luma: DataFrame, amount: int = 40, radius: float = 0.9, shadows: int = 65, highlights: int = 35, sharpen: int = 100, sharpen_radius: float = 1.0, threshold: int = 2, side: int = tiles.SIDE) -> DataFrame:
    """frame_id, y, x, v of ``eight_bit_luma`` (frame_id, y, x, v from 0 to 255): detail added, then unsharp masking.

    An amount of 0 leaves its stage out. The reach is that of both stages' blurs together.
    """
    reach = tiles.blur_reach(max(band_widths(radius))) + tiles.blur_reach(max(0.1, sharpen_radius))
    work = lambda v: {"v": unsharp(with_detail(v, amount, radius, shadows, highlights), sharpen, sharpen_radius, threshold)}
    return tiles.haloed(eight_bit_luma, ["v"], "v double", work, reach, side)


def blurred(pixels: DataFrame, sigma: float, side: int = tiles.SIDE) -> DataFrame:
    """frame_id, y, x, v: ``pixels`` (frame_id, y, x, v) under a Gaussian of ``sigma``, reflected at the frame's border."""
    return tiles.haloed(pixels, ["v"], "v double", lambda v: {"v": gaussian(v, sigma)}, tiles.blur_reach(sigma), side)
