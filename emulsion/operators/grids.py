"""Candidate rectangles of frames, made in Spark: grids around a first guess, and rectangles between corners.

A frame has one guess and five corners a quadrant at most, so a frame's candidates are some hundreds, however many frames there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relate

# Steps of the grid in shares of the guess's sides, in the order of their rank; scales; turns in degrees beside the
# guess's own and none; how far angles must be apart; the least side.
SHIFT = 0.018
SHIFTS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1), (-2, 0), (2, 0), (0, -2), (0, 2))
SCALES = (1.0, 0.985, 1.015, 0.970, 1.030)
TURN, APART, LEAST_SIDE = 1.2, 0.35, 12
# Fixed values of corners: how many a quadrant; the least share of the image's sides; areas of opposite corners' boxes; weights.
CORNERS, LEAST_SHARE, AREAS = 5, 0.24, (0.10, 0.94)
OPPOSITE = {"corners": 0.38, "format": 0.25, "fill": 0.22, "centre": 0.15}
SAME_EDGE = {"corners": 0.42, "format": 0.25, "centre": 0.18, "clear": 0.15}
CLEAR_LEAST, CLEAR_SHARE = 8.0, 0.04
RATIOS = (1.5, 1 / 1.5, 4 / 3, 0.75, 1.0, 7 / 6, 6 / 7)


def clamped(df: DataFrame, width: int, height: int) -> DataFrame:
    """``df`` with its rectangle (x, y, width, height) made to fit in the image and moved inside."""
    size = df.withColumns({n: F.greatest(F.lit(1), F.least(F.col(n), F.lit(m))).cast("int") for n, m in (("width", width), ("height", height))})
    return size.withColumns({n: F.greatest(F.lit(0), F.least(F.col(n), F.lit(m) - F.col(s))).cast("int") for n, m, s in (("x", width, "width"), ("y", height, "height"))})


def prior_grid(guesses: DataFrame, width: int, height: int, count: int = 260) -> DataFrame:
    """frame_id, x, y, width, height, angle, place: the first ``count`` different rectangles around each frame's guess.

    ``guesses`` has frame_id, x, y, width, height, angle, one a frame. Places follow shifts, then scales, then angles; a
    rectangle that is one before it, its angle to a tenth of a degree, is left out.
    """
    base = clamped(guesses.select("frame_id", "x", "y", "width", "height", "angle").filter("frame_id is not null"), width, height)
    step = lambda n: F.greatest(F.lit(1), F.bround(F.col(n) * SHIFT).cast("int"))
    turns = F.array(relate.normal_angle(F.col("angle").cast("double")), F.lit(0.0), relate.normal_angle(F.col("angle") - TURN), relate.normal_angle(F.col("angle") + TURN))
    apart = lambda out, v: F.when(F.exists(out, lambda k: F.abs(k - v) < APART), out).otherwise(F.array_append(out, v))
    d = base.select("*", step("width").alias("dx"), step("height").alias("dy"), (F.col("x") + F.col("width") / 2.0).alias("cx"), (F.col("y") + F.col("height") / 2.0).alias("cy"), F.filter(turns, lambda v: v.isNotNull()).alias("turns"))
    d = d.withColumn("turns", F.aggregate("turns", F.array().cast("array<double>"), apart))
    # All of a frame's rectangles are made in its own row: as rows they were sorted where the few guesses lay, in one task.
    inside = lambda at, size, most: F.greatest(F.lit(0), F.least(at, F.lit(most) - size)).cast("int")
    rects = []
    for i, (a, b) in enumerate(SHIFTS):
        for j in range(len(SCALES)):
            s = F.get("sizes", j)
            rects.append(F.struct(
                inside(F.bround(F.col("cx") + F.lit(a) * F.col("dx") - s["uw"] * 0.5).cast("int"), s["w"], width).alias("x"), inside(F.bround(F.col("cy") + F.lit(b) * F.col("dy") - s["uh"] * 0.5).cast("int"), s["h"], height).alias("y"),
                s["w"].alias("width"), s["h"].alias("height"),
            ))
    side = lambda n, k: F.greatest(F.lit(LEAST_SIDE), F.bround(F.col(n) * k).cast("int"))
    sizes = F.array(*(F.struct(side("width", k).alias("uw"), side("height", k).alias("uh"), F.least(side("width", k), F.lit(width)).alias("w"), F.least(side("height", k), F.lit(height)).alias("h")) for k in SCALES))
    d = d.withColumn("sizes", sizes)
    # kept angles are farther apart than a tenth of a degree, so only rectangles can be there before
    d = d.select("frame_id", "turns", F.array_distinct(F.array(*rects)).alias("rects"))
    placed = F.flatten(F.transform("rects", lambda r: F.transform("turns", lambda t: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["width"].alias("width"), r["height"].alias("height"), t.alias("angle")))))
    d = d.select("frame_id", F.posexplode(F.slice(placed, 1, count)))
    return d.select("frame_id", *(F.col(f"col.{n}").alias(n) for n in ("x", "y", "width", "height", "angle")), (F.col("pos") + 1).alias("place"))


def quadrant(x: Column, y: Column, width: int, height: int) -> Column:
    """tl, tr, bl or br; null on the middle lines."""
    down = F.when(y < height * 0.5, "t").when(y > height * 0.5, "b")
    return F.concat(down, F.when(x < width * 0.5, "l").when(x > width * 0.5, "r"))


def best_corners(corners: DataFrame, width: int, height: int) -> DataFrame:
    """``corners`` (frame_id, pos, x, y, score, bright) of each quadrant with its name: the best five, those in bare film first."""
    d = corners.withColumn("quadrant", quadrant(F.col("x"), F.col("y"), width, height)).filter("quadrant is not null")
    order = Window.partitionBy("frame_id", "quadrant").orderBy(F.desc("bright"), F.desc("score"), "pos")
    return d.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= CORNERS).drop("_k")


def _pairs(best: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """frame_id, kind, ax, ay, bx, by, corners (the sum of both scores) of all two corners of the quadrants that a kind names."""
    side = lambda p: best.select("frame_id", F.col("quadrant").alias(f"{p}q"), *(F.col(n).alias(f"{p}{n}") for n in ("x", "y", "score")))
    kind = F.coalesce(*(F.when((F.col("aq") == a) & (F.col("bq") == b), F.lit(n)) for n, (a, b) in kinds.items()))
    return side("a").join(side("b"), "frame_id").withColumn("kind", kind).filter("kind is not null").select("frame_id", "kind", "ax", "ay", "bx", "by", (F.col("ascore") + F.col("bscore")).alias("corners"))


def corner_rectangles(corners: DataFrame, width: int, height: int, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """frame_id, kind, x, y, width, height, score: rectangles of the formats ``ratios`` that two corners of a frame tell.

    Opposite corners span a box that the format is fitted into; two on one side give its length, and the format the rest. Only
    boxes and sides of a quarter of the image count, and those of one side must hold the image's middle.
    """
    best = best_corners(corners, width, height)
    each = F.explode(F.array(*(F.lit(float(r)) for r in ratios)))
    rint = lambda c: F.bround(c).cast("int")
    prior = relate.centre_prior(F.col("x"), F.col("y"), F.col("width"), F.col("height"), width, height)

    box = _pairs(best, {"falling": ("tl", "br"), "rising": ("tr", "bl")})
    box = box.withColumns({"left": F.least("ax", "bx"), "top": F.least("ay", "by"), "bw": F.abs(F.col("ax") - F.col("bx")), "bh": F.abs(F.col("ay") - F.col("by"))})
    area = F.col("bw") * F.col("bh") / float(width * height)
    box = box.filter((F.col("bw") >= width * LEAST_SHARE) & (F.col("bh") >= height * LEAST_SHARE) & area.between(*AREAS)).withColumn("ratio", each)
    wide = F.col("bw") / F.col("bh") >= F.col("ratio")
    box = box.withColumns({"fw": F.when(wide, F.col("bh") * F.col("ratio")).otherwise(F.col("bw").cast("double")), "fh": F.when(wide, F.col("bh").cast("double")).otherwise(F.col("bw") / F.col("ratio"))})
    box = box.withColumns({
        "x": rint((F.col("left") * 2 + F.col("bw")) * 0.5 - F.col("fw") * 0.5), "y": rint((F.col("top") * 2 + F.col("bh")) * 0.5 - F.col("fh") * 0.5),
        "width": F.greatest(F.lit(LEAST_SIDE), rint(F.col("fw"))), "height": F.greatest(F.lit(LEAST_SIDE), rint(F.col("fh"))),
    })
    box = clamped(box, width, height)
    fill = F.col("width") * F.col("height") / (F.col("bw") * F.col("bh"))
    terms = {"corners": F.col("corners"), "format": relate.aspect_score(F.col("bw") / F.col("bh"), F.col("ratio")), "fill": fill, "centre": prior}
    box = box.withColumn("score", sum((terms[n] * k for n, k in OPPOSITE.items()), F.lit(0.0)))

    edge = _pairs(best, {"top": ("tl", "tr"), "bottom": ("bl", "br"), "left": ("tl", "bl"), "right": ("tr", "br")})
    flat = F.col("kind").isin("top", "bottom")
    along, across = (lambda p: F.when(flat, F.col(f"{p}x")).otherwise(F.col(f"{p}y"))), (lambda p: F.when(flat, F.col(f"{p}y")).otherwise(F.col(f"{p}x")))
    edge = edge.withColumns({"start": F.least(along("a"), along("b")), "span": F.abs(along("a") - along("b")), "at": rint((across("a") + across("b")) * 0.5)})
    edge = edge.filter(F.col("span") >= F.when(flat, width * LEAST_SHARE).otherwise(height * LEAST_SHARE)).withColumn("ratio", each)
    edge = edge.withColumn("deep", F.when(flat, F.col("span") / F.col("ratio")).otherwise(F.col("span") * F.col("ratio")))
    edge = edge.withColumn("from", F.when(F.col("kind").isin("top", "left"), F.col("at").cast("double")).otherwise(F.col("at") - F.col("deep")))
    middle = F.when(flat, height * 0.5).otherwise(width * 0.5)
    edge = edge.filter((F.col("from") <= middle) & (middle <= F.col("from") + F.col("deep")))
    edge = clamped(edge.withColumns({
        "x": F.when(flat, F.col("start")).otherwise(rint(F.col("from"))), "y": F.when(flat, rint(F.col("from"))).otherwise(F.col("start")),
        "width": F.when(flat, F.col("span")).otherwise(rint(F.col("deep"))), "height": F.when(flat, rint(F.col("deep"))).otherwise(F.col("span")),
    }), width, height)
    margin = F.least("x", "y", F.lit(width) - F.col("x") - F.col("width"), F.lit(height) - F.col("y") - F.col("height"))
    clear = F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin / max(CLEAR_LEAST, min(width, height) * CLEAR_SHARE)))
    terms = {"corners": F.col("corners"), "format": relate.aspect_score(F.col("width") / F.greatest("height", F.lit(1)), F.col("ratio")), "centre": prior, "clear": clear}
    edge = edge.withColumn("score", sum((terms[n] * k for n, k in SAME_EDGE.items()), F.lit(0.0)))
    out = ("frame_id", "kind", "x", "y", "width", "height", "score")
    return box.select(*out).unionByName(edge.select(*out))
