"""Joins: pairing files, restoring saved state, overlays, radius clusters, candidate products."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import norm, on

# Raw suffixes, and the rank in which positives are preferred.
RAW_SUFFIXES = (".arw", ".raw", ".dng", ".cr2", ".cr3", ".nef", ".raf", ".orf", ".rw2")
POSITIVE_RANK = ((".png", 0), (".tif", 1), (".tiff", 1), (".jpg", 2), (".jpeg", 2), (".webp", 3), (".bmp", 4))
POSITIVE_SUFFIXES = tuple(s for s, _ in POSITIVE_RANK)


def stem(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s)^.+?(\.[^.]*)$", 1))


def supported(files: DataFrame) -> DataFrame:
    """Raw files that aren't positives themselves, of any case."""
    s = stem(F.col("name"))
    return files.filter(suffix(F.col("name")).isin(*RAW_SUFFIXES) & ~F.lower(s).rlike("(_positive|-positive| positive)$"))


def pair_files(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """folder, stem, negative_id, positive_id: stems with exactly one raw, and the positive of the preferred suffix.

    Of several positives of the best rank none is taken. ``start`` and ``end`` bound the stems as strings.
    """
    named = files.withColumns({"stem": stem(F.col("name")), "suffix": suffix(F.col("name"))})
    raws = supported(files).withColumn("stem", stem(F.col("name"))).groupBy("folder", "stem").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("negative_id")).filter("n = 1").drop("n")
    rank = F.coalesce(*(F.when(F.col("suffix") == s, r) for s, r in POSITIVE_RANK))
    images = named.filter(F.col("suffix").isin(*POSITIVE_SUFFIXES)).withColumn("rank", rank)
    best = images.groupBy("folder", "stem", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("positive_id"))
    best = best.groupBy("folder", "stem").agg(F.min(F.struct("rank", "n", "positive_id")).alias("b")).filter("b.n = 1")
    out = raws.join(best, ["folder", "stem"]).select("folder", "stem", "negative_id", F.col("b.positive_id").alias("positive_id"))
    if start is not None:
        out = out.filter(F.col("stem") >= start)
    return out if end is None else out.filter(F.col("stem") <= end)


def without_partner(files: DataFrame) -> DataFrame:
    """How many stems have only raws, only positives, or several raws, by folder."""
    named = files.withColumns({"stem": stem(F.col("name")), "suffix": suffix(F.col("name"))})
    by = named.groupBy("folder", "stem").agg(F.count_if(F.col("suffix").isin(*RAW_SUFFIXES)).alias("raws"), F.count_if(F.col("suffix").isin(*POSITIVE_SUFFIXES)).alias("images"))
    return by.groupBy("folder").agg(
        F.count_if((F.col("raws") > 0) & (F.col("images") == 0)).alias("raws_alone"), F.count_if((F.col("raws") == 0) & (F.col("images") > 0)).alias("images_alone"), F.count_if(F.col("raws") > 1).alias("ambiguous")
    )


def restored(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Files with the saved state that still holds: equal name, size and time of change; null equals null."""
    s = saved.withColumnsRenamed({c: f"saved_{c}" for c in saved.columns})
    same = (F.col("name") == F.col("saved_name")) & F.col("size").eqNullSafe(F.col("saved_size")) & F.col("mtime_ns").eqNullSafe(F.col("saved_mtime_ns"))
    return files.join(s, same).drop("saved_name", "saved_size", "saved_mtime_ns")


def overlaid(base: DataFrame, override: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of either side; a column of ``override`` that isn't null wins."""
    o = override.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = base.join(o, F.col(key) == F.col("_key"), "full_outer")
    return j.select(F.coalesce("_key", key).alias(key), *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def percent_value(c: Column) -> Column:
    """A number, or a number before a percent sign, in whole percents, halves to even; from 0 to 1 it counts as a fraction.

    Null where it is no number.
    """
    number = F.regexp_replace(F.trim(c.cast("string")), "%$", "").try_cast("double")
    return F.bround(F.when((number >= 0.0) & (number <= 1.0), number * 100.0).otherwise(number)).cast("int")


def merged_state(old: DataFrame, new: DataFrame, key: str, keep_old: list[str], take_new: list[str]) -> DataFrame:
    """Columns of ``keep_old`` come from the old state where it has them, those of ``take_new`` from the new one."""
    n = new.withColumnsRenamed({c: f"_{c}" for c in new.columns})
    j = old.join(n, F.col(key) == F.col(f"_{key}"), "full_outer")
    return j.select(F.coalesce(key, f"_{key}").alias(key), *(F.coalesce(c, f"_{c}").alias(c) for c in keep_old), *(F.coalesce(f"_{c}", c).alias(c) for c in take_new))


def gain_cluster(df: DataFrame, keys: list[str], pos: str, values: list[str], weight: str, radius: float = 0.20) -> DataFrame:
    """``df`` plus in_cluster: the rows within ``radius`` of the best centre of each group.

    A centre needs two rows; the heaviest wins, then the fullest, then the tightest, then the first by ``pos``. Groups of one or
    two rows, and those whose best cluster has under two rows or a quarter of the group, are taken whole. Rows meet through
    cells as wide as the radius, so only neighbours are compared; rows of equal values are one, with their weight and number.
    A group of n different rows may have n * n near pairs, so rows are dealt to all cores first: few as their bytes are, Spark
    would else leave the pairs of all groups to one task.
    """
    cell = [F.floor(F.col(v) / radius).cast("long") for v in values]
    points = df.groupBy(*keys, *values).agg(F.sum(weight).alias(weight), F.count(F.lit(1)).alias("_rows"), F.min(pos).alias(pos))
    placed = points.withColumns({f"_c{i}": c for i, c in enumerate(cell)}).repartition(df.sparkSession.sparkContext.defaultParallelism, pos)
    shifts = F.array(F.lit(-1), F.lit(0), F.lit(1))
    centre = placed.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col(pos).alias("a_pos"), *(F.col(v).alias(f"a_{v}") for v in values), *(f"_c{i}" for i in range(len(values))))
    for i in range(len(values)):
        centre = centre.withColumn("_s", F.explode(shifts)).withColumn(f"n{i}", F.col(f"_c{i}") + F.col("_s")).drop("_s", f"_c{i}")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    for i in range(len(values)):
        match = match & (F.col(f"_c{i}") == F.col(f"n{i}"))
    away = norm(*(F.col(v) - F.col(f"a_{v}") for v in values))
    near = placed.join(centre, match).withColumn("_d", away).filter(F.col("_d") <= radius)
    score = near.groupBy(*keys, "a_pos").agg(F.sum(weight).alias("w"), F.sum("_rows").alias("n"), (F.sum(F.col("_d") * F.col(weight)) / F.sum(weight)).alias("spread"), *(F.first(f"a_{v}").alias(f"a_{v}") for v in values)).filter("n >= 2")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("w", 12)), F.desc("n"), F.round("spread", 12), "a_pos")
    best = score.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, F.col("n").alias("best_n"), *(f"a_{v}" for v in values))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    j = on(on(df, total, keys), best, keys)
    enough = F.coalesce((F.col("rows") > 2) & (F.col("best_n") >= F.greatest(F.lit(2), F.ceil(F.col("rows") * 0.25))), F.lit(False))
    inside = norm(*(F.col(v) - F.col(f"a_{v}") for v in values)) <= radius
    return j.withColumn("in_cluster", ~enough | inside).drop("rows", "best_n", *(f"a_{v}" for v in values))


def span_pairs(first: DataFrame, second: DataFrame, keys: list[str], length: int, least: int, keep: int) -> DataFrame:
    """Pairs of boundary lines at a fitting distance, the best ``keep`` of each frame. Each side has six lines at most."""
    s = second.withColumnsRenamed({"place": "b", "score": "b_score", **{k: f"_{k}" for k in keys}})
    match = (F.col("b") - F.col("place") >= least) & (F.col("b") - F.col("place") <= round(length * 0.96))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    j = first.join(s, match)
    prior = 1.0 - F.least(F.greatest(F.abs((F.col("b") - F.col("place")) / max(1.0, float(length)) - 0.68) / 0.52, F.lit(0.0)), F.lit(1.0))
    j = j.select(*keys, F.col("place").alias("a"), "b", ((F.col("score") + F.col("b_score")) * 0.5 + prior * 0.10).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "a", "b")
    return j.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def boxes(x_pairs: DataFrame, y_pairs: DataFrame, keys: list[str], width: int, height: int, ratios: tuple[float, ...]) -> DataFrame:
    """Rectangles of the given aspects inside every x pair and y pair of a frame, with their score.

    At most 14 x 14 pairs a frame; areas outside 10 to 92 percent, and those that fill under 52 percent of the box, are left out.
    """
    y = y_pairs.withColumnsRenamed({"a": "top", "b": "bottom", "score": "y_score", **{k: f"_{k}" for k in keys}})
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    j = x_pairs.withColumnsRenamed({"a": "left", "b": "right", "score": "x_score"}).join(y, match)
    j = j.withColumns({"bw": F.col("right") - F.col("left"), "bh": F.col("bottom") - F.col("top")}).filter("bw > 0 and bh > 0")
    area = F.col("bw") * F.col("bh") / float(width * height)
    j = j.filter((area >= 0.10) & (area <= 0.92)).withColumn("ratio", F.explode(F.array(*(F.lit(float(r)) for r in ratios))))
    wide = F.col("bw") / F.col("bh") >= F.col("ratio")
    w = F.greatest(F.lit(12), F.rint(F.when(wide, F.col("bh") * F.col("ratio")).otherwise(F.col("bw"))))
    h = F.greatest(F.lit(12), F.rint(F.when(wide, F.col("bh")).otherwise(F.col("bw") / F.col("ratio"))))
    j = j.withColumns({"width": w, "height": h}).withColumn("fill", F.col("width") * F.col("height") / (F.col("bw") * F.col("bh"))).filter("fill >= 0.52")
    score = (F.col("x_score") + F.col("y_score")) * 0.44 + aspect_score(F.col("bw") / F.col("bh"), F.col("ratio")) * 0.22 + F.col("fill") * 0.16
    cx, cy = (F.col("left") + F.col("right")) * 0.5, (F.col("top") + F.col("bottom")) * 0.5
    return j.select(*keys, F.rint(cx - F.col("width") * 0.5).alias("x"), F.rint(cy - F.col("height") * 0.5).alias("y"), "width", "height", "ratio", score.alias("score"))


def aspect_score(aspect: Column, target: Column, tolerance: float = 0.42) -> Column:
    """1 where the aspects are equal, 0 where their logarithms differ by ``tolerance`` or more."""
    away = F.abs(F.ln(F.greatest(aspect, F.lit(0.05))) - F.ln(F.greatest(target, F.lit(0.05))))
    return 1.0 - F.least(F.greatest(away / tolerance, F.lit(0.0)), F.lit(1.0))


# Aspect of each film format.
FORMATS = (("135", 1.5), ("645", 4 / 3), ("66", 1.0), ("67", 7 / 6), ("69", 1.5))


def best_format(aspect: Column, tolerance: float = 0.36) -> Column:
    """struct(label, score) of the nearest format; the first one on ties; unknown with 0 where none is near."""
    upright = F.when(aspect < 1.0, 1.0 / F.greatest(aspect, F.lit(1e-5))).otherwise(aspect)
    scored = [F.struct(aspect_score(upright, F.lit(r), tolerance).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("label")) for i, (n, r) in enumerate(FORMATS)]
    best = F.greatest(*scored)
    return F.when(best["score"] > 0.0, F.struct(best["label"].alias("label"), best["score"].alias("score"))).otherwise(F.struct(F.lit("unknown").alias("label"), F.lit(0.0).alias("score")))


def normal_angle(angle: Column) -> Column:
    """The same direction of a rectangle in (-45, 45]."""
    turn = F.pmod(angle + 45.0, F.lit(90.0))
    return F.when(turn == 0.0, 45.0).otherwise(turn - 45.0)


def label_weight(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, 1.0).when(confidence >= 0.85, 0.72).when(confidence >= 0.70, 0.42).otherwise(0.20)


def axis_iou(a: str, b: str) -> Column:
    """Intersection over union of two upright rectangles with columns a_x, a_y, a_width, a_height, and so for b."""
    c = lambda p, n: F.col(f"{p}_{n}")
    w = F.least(c(a, "x") + c(a, "width"), c(b, "x") + c(b, "width")) - F.greatest(c(a, "x"), c(b, "x"))
    h = F.least(c(a, "y") + c(a, "height"), c(b, "y") + c(b, "height")) - F.greatest(c(a, "y"), c(b, "y"))
    both = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    union = c(a, "width") * c(a, "height") + c(b, "width") * c(b, "height") - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(0.0)


def rotated_corners(x: Column, y: Column, width: Column, height: Column, angle: Column) -> list[tuple[Column, Column]]:
    """Corners from the upper left on, turned around the centre by ``angle`` degrees."""
    cx, cy, a = x + width / 2.0, y + height / 2.0, angle * (math.pi / 180.0)
    cos, sin = F.cos(a), F.sin(a)
    out = []
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        dx, dy = sx * width / 2.0, sy * height / 2.0
        out.append((cx + dx * cos - dy * sin, cy + dx * sin + dy * cos))
    return out


def _corner_names(p: str) -> list[tuple[str, str]]:
    return [(f"{p}x{i}", f"{p}y{i}") for i in range(4)]


def rotated_overlap_steps(a: dict[str, str], b: dict[str, str]) -> list[dict[str, str]]:
    """The overlap of two turned rectangles as SQL expressions to add in turn; the last is iou.

    The border of what two convex shapes share is made of the parts of either's sides that lie inside the other. Each side is
    cut by the other's four, and the parts' areas to the origin are summed. A side that lies on one of the other's counts once.
    """
    corners, sides, cuts, areas = {}, {}, {}, []
    for p, r in (("p", a), ("q", b)):
        turn = f"radians({r['angle']})"
        for (x, y), (sx, sy) in zip(_corner_names(p), ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)), strict=True):
            dx, dy = f"({sx} * {r['width']})", f"({sy} * {r['height']})"
            corners[x] = f"{r['x']} + {r['width']} * 0.5 + {dx} * cos({turn}) - {dy} * sin({turn})"
            corners[y] = f"{r['y']} + {r['height']} * 0.5 + {dx} * sin({turn}) + {dy} * cos({turn})"
    for p, q in (("p", "q"), ("q", "p")):
        own, other = _corner_names(p), _corner_names(q)
        for i, (x, y) in enumerate(own):
            for j in range(4):
                (x0, y0), (x1, y1) = other[j], other[(j + 1) % 4]
                sides[f"{p}{i}{j}"] = f"({x1} - {x0}) * ({y} - {y0}) - ({y1} - {y0}) * ({x} - {x0})"
        least = "-1e-7" if p == "p" else "1e-7"
        for i, (x, y) in enumerate(own):
            ends = [(f"{p}{i}{j}", f"{p}{(i + 1) % 4}{j}") for j in range(4)]
            nx, ny = own[(i + 1) % 4]
            against = [f"({nx} - {x}) * ({other[(j + 1) % 4][0]} - {other[j][0]}) + ({ny} - {y}) * ({other[(j + 1) % 4][1]} - {other[j][1]}) < 0" for j in range(4)]
            apart = [f"abs({d}) <= 1e-7 AND abs({e}) <= 1e-7 AND {no}" for (d, e), no in zip(ends, against, strict=True)]  # shapes side by side
            cuts[f"{p}from{i}"] = "greatest(0.0, " + ", ".join(f"CASE WHEN {no} THEN 2.0 WHEN {d} >= {least} THEN 0.0 WHEN {e} < {least} THEN 2.0 ELSE {d} / ({d} - {e}) END" for (d, e), no in zip(ends, apart, strict=True)) + ")"
            cuts[f"{p}to{i}"] = "least(1.0, " + ", ".join(f"CASE WHEN {e} >= {least} OR {d} < {least} THEN 1.0 ELSE {d} / ({d} - {e}) END" for d, e in ends) + ")"
            areas.append(f"greatest({p}to{i} - {p}from{i}, 0.0) * ({x} * {ny} - {y} * {nx})")
    both = "(" + " + ".join(areas) + ") * 0.5"
    whole = f"{a['width']} * {a['height']} + {b['width']} * {b['height']}"
    return [corners, sides, cuts, {"both_": both}, {"iou": f"CASE WHEN {whole} - both_ > 1e-6 THEN greatest(both_, 0.0) / ({whole} - both_) ELSE 0.0 END"}]


def rotated_overlaps(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` plus iou of the turned rectangles in the double columns a_x, a_y, a_width, a_height, a_angle, and so for b."""
    names = ("x", "y", "width", "height", "angle")
    out = df
    for step in rotated_overlap_steps({n: f"{a}_{n}" for n in names}, {n: f"{b}_{n}" for n in names}):
        out = out.withColumns({n: F.expr(e) for n, e in step.items()})
    return out.select(*df.columns, "iou")


def border_clearance(corners: list[tuple[Column, Column]], width: int, height: int) -> Column:
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    margin = F.least(F.least(*xs), F.least(*ys), width - F.greatest(*xs), height - F.greatest(*ys))
    return F.least(F.greatest(margin / max(8.0, min(width, height) * 0.04), F.lit(0.0)), F.lit(1.0))


def centre_prior(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    away = F.abs((x + w / 2.0) / float(width) - 0.5) * 2.0 + F.abs((y + h / 2.0) / float(height) - 0.5) * 2.0
    return 1.0 - F.least(F.greatest(away / 1.45, F.lit(0.0)), F.lit(1.0))


def composed_mask(auto: DataFrame, added: DataFrame, protected: DataFrame, cell: list[str]) -> DataFrame:
    """(auto or added) and not protected, as sparse cells."""
    return auto.select(*cell).union(added.select(*cell)).distinct().join(protected.select(*cell).distinct(), cell, "left_anti")


def first_reason(*cases: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The text of the first case that holds."""
    out = F.when(cases[0][0], cases[0][1])
    for test, text in cases[1:]:
        out = out.when(test, text)
    return out.otherwise(otherwise)
