"""Sums over rectangles by summed-area tables, and the share of edges along their sides.

A table holds for each cell the sums of all cells above and to the left of it. A rectangle's sum is then four of its rows, however
large the rectangle is and however many overlap; a ring around it takes eight. Rectangles meet cells by equi-joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relate

# The ring's width in shorter sides and at least in cells, what is black, the least cells that tell something, cells
# between two samples of a side and the least number of samples.
RING_SHARE, BLACK, LEAST_CELLS = 0.075, 0.030, 16
SAMPLE_CELLS, LEAST_SAMPLES = 5.0, 8


def summed_area(cells: DataFrame, *values: str) -> DataFrame:
    """frame_id, y, x and each of ``values`` summed over all cells of the frame up to that row and column.

    Each cell of the frame's grid has a row, up to the last row and column that ``cells`` (frame_id, y, x) holds; those that
    are missing add nothing. A window holds one row, then one column of a frame.
    """
    placed = cells.filter("frame_id is not null and y is not null and x is not null")
    grid = placed.groupBy("frame_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    grid = grid.select("frame_id", "w", F.explode(F.sequence(F.lit(0), "h")).alias("y")).select("frame_id", "y", F.explode(F.sequence(F.lit(0), "w")).alias("x"))
    full = grid.join(placed.select("frame_id", "y", "x", *values), ["frame_id", "y", "x"], "left").fillna(0, list(values))
    along = Window.partitionBy("frame_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("frame_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    rows = full.select("frame_id", "y", "x", *(F.sum(v).over(along).alias(v) for v in values))
    return rows.select("frame_id", "y", "x", *(F.sum(v).over(down).alias(v) for v in values))


def corners(part: str, sign: int, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """The four look-ups of the cells from x0 and y0 up to, but without, x1 and y1."""
    row = lambda s, y, x: F.struct(F.lit(part).alias("part"), F.lit(sign * s).alias("sign"), (y - 1).cast("int").alias("y"), (x - 1).cast("int").alias("x"))
    return [row(1, y1, x1), row(-1, y0, x1), row(-1, y1, x0), row(1, y0, x0)]


def rectangle_sums(table: DataFrame, rects: DataFrame, values: list[str], least_ring: float = 8.0) -> DataFrame:
    """frame_id, cand_pos, and in_ and out_ of each of ``values``: sums inside each upright rectangle, and in a ring around it.

    ``rects`` has frame_id, cand_pos, x0, y0, width, height; what lies outside the frame counts as nothing. ``table`` is that of
    ``summed_area``. A rectangle of a frame without cells has no row.
    """
    size = table.groupBy("frame_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    pad = F.greatest(F.lit(least_ring), F.least("width", "height") * RING_SHARE)
    within = lambda c, n: F.least(F.greatest(F.ceil(c), F.lit(0)), F.col(n))
    box = lambda p: (within(F.col("x0") - p, "_w"), within(F.col("y0") - p, "_h"), within(F.col("x0") + F.col("width") + p, "_w"), within(F.col("y0") + F.col("height") + p, "_h"))
    asked = rects.join(size, "frame_id").select("frame_id", "cand_pos", F.inline(F.array(*corners("in", 1, *box(F.lit(0))), *corners("out", 1, *box(pad)), *corners("out", -1, *box(F.lit(0))))))
    found = asked.join(table.select("frame_id", "y", "x", *values), ["frame_id", "y", "x"], "left")
    told = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col("sign") * F.col(v))), F.lit(0)).alias(f"{p}_{v}") for p in ("in", "out") for v in values]
    return found.groupBy("frame_id", "cand_pos").agg(*told)


def rectangle_statistics(raster: DataFrame, rects: DataFrame, luma: Column, chroma: Column, edge: Column, least_ring: float = 8.0) -> DataFrame:
    """frame_id, cand_pos, and for inside (in_) and ring (out_): n, mean, std, chroma_std, edges, black, valid.

    edges and black are shares of the cells; valid is the part's share of the frame. Under 16 cells give 0, and black 1. ``edge`` is
    a boolean expression over ``raster`` (frame_id, y, x, r, g, b). A frame's cells and rectangles meet as one group of bounded size,
    in which the summed-area tables are made: no cell of them is written or dealt out. A rectangle of a frame without cells has no row.
    """
    placed = raster.filter("frame_id is not null and y >= 0 and x >= 0")
    cells = placed.select(F.col("frame_id").cast("long").alias("frame_id"), "y", "x", luma.cast("double").alias("v"), chroma.cast("double").alias("c"), F.coalesce(edge, F.lit(False)).cast("int").alias("edge"))
    pad = F.greatest(F.lit(least_ring), F.least("width", "height") * RING_SHARE)
    whole = F.lit(True)
    for n in ("x0", "y0", "width", "height"):
        whole = whole & F.col(n).isNotNull()
    box = {f"{part}{n}{k}": F.when(whole, F.ceil(F.col(f"{n}0") + c)).otherwise(0).cast("long") for part, p in (("in", F.lit(0)), ("out", pad)) for n, size in (("x", "width"), ("y", "height")) for k, c in ((0, -p), (1, F.col(size) + p))}
    asked = rects.filter("frame_id is not null").select(F.col("frame_id").cast("long").alias("frame_id"), F.col("cand_pos").cast("long").alias("cand_pos"), *(c.alias(n) for n, c in box.items()))
    names = ["n", "v", "vv", "c", "cc", "edge", "dark"]
    schema = pa.schema([("frame_id", pa.int64()), ("cand_pos", pa.int64()), ("_all", pa.int64()), *((f"{part}_{n}", pa.float64()) for part in ("in", "out") for n in names)])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        y, x, v, c, e = (left[n].to_numpy() for n in ("y", "x", "v", "c", "edge"))
        dark, (v, c) = v < BLACK, (np.where(np.isnan(a), 0.0, a) for a in (v, c))
        h, w = int(y.max()) + 1, int(x.max()) + 1
        table = np.zeros((len(names), h + 1, w + 1), np.longdouble)  # differences of long sums keep a double's places
        for plane, values in zip(table, (1, v, v * v, c, c * c, e, dark), strict=True):
            np.add.at(plane, (y + 1, x + 1), values)
        table = table.cumsum(axis=2).cumsum(axis=1)
        positions = right["cand_pos"].to_pylist()
        place = {p: k for k, p in enumerate(dict.fromkeys(positions))}
        at = [place[p] for p in positions]

        def total(part: str) -> np.ndarray:
            x0, x1, y0, y1 = (np.clip(right[f"{part}{n}"].to_numpy(), 0, most) for n, most in (("x0", w), ("x1", w), ("y0", h), ("y1", h)))
            x1, y1 = np.maximum(x0, x1), np.maximum(y0, y1)
            out = np.zeros((len(place), len(names)), np.longdouble)
            np.add.at(out, at, (table[:, y1, x1] - table[:, y0, x1] - table[:, y1, x0] + table[:, y0, x0]).T)
            return out

        inside, both = total("in"), total("out")
        told = np.concatenate([inside, both - inside], axis=1).T.astype(float)
        return pa.table([pa.array([key[0].as_py()] * len(place), pa.int64()), pa.array(list(place), pa.int64()), pa.array([h * w] * len(place), pa.int64()), *told], schema=schema)

    columns = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema)
    d = cells.groupBy("frame_id").cogroup(asked.groupBy("frame_id")).applyInArrow(run, columns)
    out = []
    for p in ("in", "out"):
        n = F.col(f"{p}_n")
        share = lambda v, p=p, n=n: F.col(f"{p}_{v}") / F.nullif(n, F.lit(0))
        few = lambda c, other=0.0, n=n: F.when(n >= LEAST_CELLS, c).otherwise(other)
        spread = lambda v: F.sqrt(F.greatest(share(v + v) - share(v) * share(v), F.lit(0.0)))  # noqa: E731, B023
        out += [n.cast("long").alias(f"{p}_n"), few(share("v")).alias(f"{p}_mean"), few(spread("v")).alias(f"{p}_std"), few(spread("c")).alias(f"{p}_chroma_std"), few(share("edge")).alias(f"{p}_edges"), few(share("dark"), 1.0).alias(f"{p}_black"), (n / F.col("_all")).alias(f"{p}_valid")]
    return d.select("frame_id", "cand_pos", *out)


def side_support(edges: DataFrame, frame_sizes: DataFrame, rects: DataFrame) -> DataFrame:
    """frame_id, cand_pos, top, right, bottom, left, support: the share of samples along each side that are edges, and their mean.

    ``edges`` has frame_id, y, x of the cells that are edges, ``rects`` frame_id, cand_pos, x, y, width, height, angle, which may be
    turned. A sample lies each five cells, at least eight a side; those outside the frame don't count, and a side without
    any is 0. Samples meet cells by an equi-join, and get their frame's size before they are made: a rectangle may
    have hundreds, so they must not be taken for the small side of a join.
    """
    d = {n: F.col(n).cast("double") for n in ("x", "y", "width", "height", "angle")}
    points = relate.rotated_corners(d["x"], d["y"], d["width"], d["height"], d["angle"])
    sides = []
    for i, name in enumerate(("top", "right", "bottom", "left")):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % 4]
        steps = F.greatest(F.lit(LEAST_SAMPLES), F.floor(F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) / SAMPLE_CELLS).cast("int"))
        sides.append(F.struct(F.lit(name).alias("side"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), steps.alias("steps")))
    placed = rects.join(frame_sizes.select("frame_id", F.col("height").alias("_h"), F.col("width").alias("_w")), "frame_id")
    lines = placed.select("frame_id", "cand_pos", "_h", "_w", F.inline(F.array(*sides)))
    t = F.col("k") / (F.col("steps") - 1)
    at = lambda a, b: F.bround(F.col(a) * (1.0 - t) + F.col(b) * t).cast("int")
    samples = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).select("frame_id", "cand_pos", "side", "_h", "_w", at("ay", "by").alias("y"), at("ax", "bx").alias("x"))
    inside = samples.withColumn("within", F.col("y").between(0, F.col("_h") - 1) & F.col("x").between(0, F.col("_w") - 1))
    hits = inside.join(edges.select("frame_id", "y", "x", F.lit(1).alias("hit")).distinct(), ["frame_id", "y", "x"], "left")
    share = lambda s: F.coalesce(F.sum(F.when((F.col("side") == s) & F.col("within"), F.coalesce("hit", F.lit(0)))) / F.nullif(F.count_if((F.col("side") == s) & F.col("within")), F.lit(0)), F.lit(0.0)).alias(s)
    told = hits.groupBy("frame_id", "cand_pos").agg(*(share(s) for s in ("top", "right", "bottom", "left")))
    return told.withColumn("support", (F.col("top") + F.col("right") + F.col("bottom") + F.col("left")) / 4.0)
