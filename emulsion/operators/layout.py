"""Where pixels and rectangles lie: flips and quarter turns, their inverse, brush strokes, labels, eligibility, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def mirrored(p: Point, width: Column, height: Column, across: bool, down: bool) -> Point:
    x, y = p
    return (width - 1 - x if across else x), (height - 1 - y if down else y)


def turned(p: Point, width: Column, height: Column, quarters: int) -> Point:
    """A cell's place after so many quarter turns clockwise; an odd number swaps the sides."""
    x, y = p
    return ((x, y), (height - 1 - y, x), (width - 1 - x, height - 1 - y), (y, width - 1 - x))[quarters % 4]


def laid_out(df: DataFrame, width: Column, height: Column, across: bool = False, down: bool = False, quarters: int = 0) -> DataFrame:
    """``df`` (x, y) with the places that its cells have in the picture as shown: mirrored, then turned."""
    x, y = turned(mirrored((F.col("x"), F.col("y")), width, height, across, down), width, height, quarters)
    return df.withColumns({"x": x, "y": y})


def source_place(p: Point, width: Column, height: Column, across: bool = False, down: bool = False, quarters: int = 0) -> Point:
    """The source cell of a point of the picture as shown, inside the source; ``width`` and ``height`` are the source's."""
    swapped = quarters % 2 == 1
    back = turned(p, height if swapped else width, width if swapped else height, -quarters)
    x, y = mirrored(back, width, height, across, down)
    inside = lambda v, n: F.least(F.greatest(v, F.lit(0)), n - 1)
    return inside(x, width), inside(y, height)


def in_stroke(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float], radius: float) -> Column:
    """Cells within ``radius`` of the line between two points: a brush with round ends."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    square = dx * dx + dy * dy
    along = F.lit(0.0) if square == 0 else F.least(F.greatest(((x - start[0]) * dx + (y - start[1]) * dy) / square, F.lit(0.0)), F.lit(1.0))
    return F.pow(x - start[0] - along * dx, 2) + F.pow(y - start[1] - along * dy, 2) <= radius * radius


def rectangle_label(x: Column, y: Column, width: Column, height: Column, angle: Column) -> Column:
    flat = F.format_string("x=%d, y=%d, w=%d, h=%d", x, y, width, height)
    return F.concat(flat, F.when(F.abs(angle) <= 0.05, "").otherwise(F.format_string(", angle=%.1f", angle)))


def export_reason(has_state: Column, completed: Column, suffix: Column, raw: Column, rect_width: Column, rect_height: Column) -> Column:
    """Why a file can't be exported, the first reason that holds; accepted if none does."""
    return (
        F.when(~has_state, "no_state").when(~F.coalesce(completed, F.lit(False)), "not_completed").when(~raw, F.concat(F.lit("not_raw:"), suffix))
        .when(rect_width.isNull() | rect_height.isNull(), "no_frame").when((rect_width <= 0) | (rect_height <= 0), "invalid_frame").otherwise("accepted")
    )


def restores_positive(completed: Column, rect_width: Column, rect_height: Column, manual_levels: Column) -> Column:
    framed = F.coalesce((rect_width > 0) & (rect_height > 0), F.lit(False))
    return F.coalesce(completed, F.lit(False)) | (framed & manual_levels)


def held_back(key: Column, percent: int = 25, seed: int = 7) -> Column:
    """A split that depends on the key alone: the same rows on every run and at every size."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return digest % 100 < percent


# Stages whose times make up the whole; others are parts of these.
TOP_STAGES = ("RAW decode", "Build base", "Lab Print", "Orientation", "Dust removal")
TOP_START, TOP_END = "Prepare ", " write"


def timings_text(stages: Column) -> Column:
    """An array of struct(name, seconds) as text with a total of the top-level stages at its end; empty for none."""
    top = F.filter(stages, lambda s: s["name"].isin(*TOP_STAGES) | s["name"].startswith(TOP_START) | s["name"].endswith(TOP_END))
    total = F.aggregate(top, F.lit(0.0), lambda a, s: a + s["seconds"])
    parts = F.transform(stages, lambda s: F.format_string("%s %.1fs", s["name"], s["seconds"]))
    return F.when(F.size(stages) > 0, F.array_join(F.array_append(parts, F.format_string("total %.1fs", total)), ", ")).otherwise("")


def frames_itself(switched_on: Column, has_preview: Column, raw: Column, has_rect: Column, negative_shown: Column) -> Column:
    """Whether a new negative gets its frame without being asked for."""
    return switched_on & has_preview & raw & ~has_rect & ~negative_shown


def to_preinvert(files: DataFrame, current: DataFrame, known: list[DataFrame], raws: tuple[str, ...]) -> DataFrame:
    """Raw files (file_id, suffix) but the current one and those in any table of ``known``: under way, with a state, or cached."""
    d = files.filter(F.col("suffix").isin(*raws))
    for t in (current, *known):
        d = d.join(t.select("file_id").distinct(), "file_id", "left_anti")
    return d


def in_scope(files: DataFrame, states: DataFrame, scope: str) -> DataFrame:
    """Files of a scope: all, completed (a state says so) or unprocessed (none does); any other scope has none."""
    done = states.filter("completed").select("file_id").distinct()
    if scope == "all":
        return files
    how = {"completed": "left_semi", "unprocessed": "left_anti"}.get(scope)
    return files.limit(0) if how is None else files.join(done, "file_id", how)


def with_plans(states: DataFrame, plans: DataFrame) -> DataFrame:
    """``states`` (file_id, plan, corrected, ...) with the plans (file_id, plan) that came for them, which switch the correction on."""
    p = plans.select(F.col("file_id").alias("_id"), F.col("plan").alias("_plan"))
    j = states.join(p, F.col("file_id") == F.col("_id"), "left")
    return j.withColumns({"corrected": F.col("corrected") | F.col("_id").isNotNull(), "plan": F.when(F.col("_id").isNotNull(), F.col("_plan")).otherwise(F.col("plan"))}).drop("_id", "_plan")
