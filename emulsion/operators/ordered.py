"""Operators whose result depends on an order: weighted medians, moving sums, bins of equal count, neighbours, numbering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import on


def weighted_median(df: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """Of each value, the first in order at which half of the weight is reached; never a mean of two. All running sums are windows
    over one exchange by ``keys``."""
    upto = {f"_upto_{v}": F.sum(weight).over(Window.partitionBy(*keys).orderBy(v).rangeBetween(Window.unboundedPreceding, 0)) for v in values}
    d = df.select(*keys, *values, weight).withColumns({**upto, "_all": F.sum(weight).over(Window.partitionBy(*keys))})
    return d.groupBy(*keys).agg(*(F.min(F.when(F.col(f"_upto_{v}") >= F.col("_all") * 0.5, F.col(v))).alias(v) for v in values))


def moving_sum(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> Column:
    """A centred sum over ``window`` places divided by it; beyond the ends are zeros. An even window grows by one."""
    h = (window if window % 2 else window + 1) // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    return F.sum(value).over(w) / float(2 * h + 1)


def block_contrast(keys: list[str], order: str, value: str, width: int, outside_first: bool = True) -> Column:
    """Score of an edge at each place: means of the two blocks of 2 * ``width`` places that begin ``width`` away on either side.

    Null where a block would leave the profile.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(-3 * width, -width - 1)
    after = w.rowsBetween(width, 3 * width - 1)
    b, a = F.avg(value).over(before), F.avg(value).over(after)
    full = (F.count(value).over(before) == 2 * width) & (F.count(value).over(after) == 2 * width)
    drop = b - a if outside_first else a - b
    return F.when(full, F.greatest(F.lit(0.0), drop) * 0.78 + F.abs(a - b) * 0.22)


def running_max(keys: list[str], order: str, value: str) -> Column:
    return F.max(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def bin_edges(n: int, bins: int) -> list[int]:
    """Where bins of equal count begin and end: evenly spaced reals cut to integers."""
    return np.linspace(0, n, bins + 1, dtype=np.int32).tolist()


def bin_of(at: Column, n: Column, bins: int) -> Column:
    """The bin of place ``at`` among ``n``, with the edges of ``bin_edges``: a multiple of the step may be cut one below its number."""
    step = n / float(bins)
    guess = F.floor(at / step)
    edge = lambda i: F.when(i >= bins, n).otherwise(F.floor(i * step))
    return F.when(edge(guess + 1) <= at, guess + 1).when(edge(guess) > at, guess - 1).otherwise(guess).cast("int")


def tone_curve(df: DataFrame, keys: list[str], x: str, y: str, bins: int = 48) -> DataFrame:
    """keys, i, x, y of a rising curve for each group: medians of bins of equal count along x, running maximum, clipped, the first y
    of an x. A group is a frame or less; one of fewer than 8 rows a bin has no curve."""
    valid = df.filter((F.col(x) > 0.0) & (F.col(y) > 0.0) & (F.col(y) < 0.995) & ~F.isnan(x) & ~F.isnan(y)).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    own = Window.partitionBy(*keys)
    ranked = valid.withColumns({"_n": F.count(F.lit(1)).over(own), "_at": F.row_number().over(own.orderBy("x", "y")) - 1}).filter(F.col("_n") >= bins * 8)
    mid = ranked.groupBy(*keys, bin_of(F.col("_at"), F.col("_n"), bins).alias("i")).agg(F.median("x").alias("x"), F.median("y").alias("y"))
    rising = mid.withColumn("y", F.least(F.greatest(F.max("y").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), F.lit(1.0)))
    return rising.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "x").orderBy("i"))).filter("_k = 1").drop("_k")


def on_curve(c: Column, knots: list[tuple[float, float]]) -> Column:
    """``c`` on a curve of a few fixed knots by rising x, linear between them and flat beyond its ends."""
    out = F.when(c <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(c < x1, y0 + (c - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(knots[-1][1])


def interpolated(df: DataFrame, value: str, curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``df`` plus toned: ``value`` on the curve (x, y), linear between its knots and flat beyond its ends.

    For curves by key; ``on_curve`` is for one of a few knots. Knots become half-open intervals; a value falls in exactly one of
    them.
    """
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("x")
    seg = curve.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.row_number().over(w).alias("_i"))
    low = seg.withColumn("from", F.when(F.col("_i") == 1, float("-inf")).otherwise(F.col("x0"))).withColumn("to", F.coalesce("x1", F.lit(float("inf"))))
    low = low.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = (F.col(value) >= F.col("from")) & (F.col(value) < F.col("to"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    slope = (F.col("y1") - F.col("y0")) / F.when(F.col("x1") > F.col("x0"), F.col("x1") - F.col("x0"))
    toned = F.when(F.col(value) <= F.col("x0"), F.col("y0")).otherwise(F.coalesce(F.col("y0") + (F.col(value) - F.col("x0")) * slope, F.col("y0")))
    return df.join(low, match, "left").withColumn("toned", toned).drop("x0", "y0", "x1", "y1", "from", "to", "_i", *(f"_{k}" for k in keys))


def centre_boundary(df: DataFrame, keys: list[str], order: str, value: str, centre: str, side: str) -> DataFrame:
    """The greatest place on one side of the centre, the first on ties: keys, place, score.

    The ends and the neighbourhood of the centre aren't searched. Null where nothing stands out from the profile's 72nd
    percentile, or the profile has fewer than 32 places.
    """
    shape = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile(value, F.lit(0.72)).alias("_floor"))
    p = on(df, shape, keys)
    margin = F.greatest(F.lit(2), F.rint(F.col("_n") * 0.018))
    apart = F.greatest(F.lit(6), F.rint(F.col("_n") * 0.10))
    if side == "left":
        inside = (F.col(order) >= margin) & (F.col(order) < F.greatest(margin, F.col(centre) - apart))
    else:
        inside = (F.col(order) >= F.least(F.col("_n") - margin, F.col(centre) + apart)) & (F.col(order) < F.col("_n") - margin)
    best = F.max(F.when(inside, F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o")))).alias("m")
    top = p.groupBy(*keys).agg(best, F.first("_n").alias("_n"), F.first("_floor").alias("_floor"))
    stands = (F.col("_n") >= 32) & (F.col("m.v") >= F.greatest(F.col("_floor") * 1.12, F.col("_floor") + 1.0))
    return top.select(*keys, F.when(stands, -F.col("m.o")).alias("place"), F.when(stands, F.col("m.v")).alias("score"))


def file_order() -> Column:
    return F.lower("name")


def positions(files: DataFrame, folder: str = "folder") -> DataFrame:
    """``files`` plus pos (from 0 in the order of lower-cased names), total and the text "i / n"."""
    w = Window.partitionBy(folder).orderBy(file_order(), "name", "file_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(folder))
    pos = F.row_number().over(w) - 1
    return files.withColumns({"pos": pos, "total": n}).withColumn("status", F.format_string("%d / %d", F.col("pos") + 1, F.col("total")))


def next_kept(files: DataFrame, removed: Column, folder: str = "folder") -> DataFrame:
    """For each removed file, what to show: the next kept one, else the one before, else nothing."""
    w = Window.partitionBy(folder).orderBy(file_order(), "name", "file_id")
    kept = F.when(~removed, F.col("file_id"))
    after = F.first(kept, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("show_id", F.coalesce(after, before)).filter(removed)


def nearby(placed: DataFrame, at: DataFrame, radius: int = 3, folder: str = "folder") -> DataFrame:
    """Files within ``radius`` places of the current one, nearest first, the earlier first on ties: place, file_id, near.

    The band is dealt out as 2 * radius keys, so the join is by equality.
    """
    steps = F.explode(F.array(*(F.lit(s) for d in range(1, radius + 1) for s in (-d, d)))).alias("step")
    wanted = at.select(F.col(folder).alias("_folder"), F.col("pos").alias("at_pos"), steps).withColumn("_pos", F.col("at_pos") + F.col("step"))
    found = placed.join(wanted, (F.col(folder) == F.col("_folder")) & (F.col("pos") == F.col("_pos")))
    order = Window.partitionBy(folder, "at_pos").orderBy(F.abs("step"), "pos")
    return found.select(folder, "at_pos", "file_id", "pos", F.row_number().over(order).alias("near"))


def selected_range(placed: DataFrame, anchor: Column, clicked: Column) -> DataFrame:
    """Files between two places, both included, whichever came first."""
    return placed.filter((F.col("pos") >= F.least(anchor, clicked)) & (F.col("pos") <= F.greatest(anchor, clicked)))


def sequence_names(done: DataFrame, prefix: Column, start: int = 1, folder: str = "folder") -> DataFrame:
    """``done`` plus output: prefix and a number of three digits at least; skipped ones use up their number."""
    w = Window.partitionBy(folder).orderBy(file_order(), "name", "file_id")
    return done.withColumn("output", F.concat(prefix, F.format_string("%03d", F.row_number().over(w) - 1 + start)))


def first_wins(df: DataFrame, keys: list[Column], order: str, within: list[str]) -> DataFrame:
    """The first row of each rounded key."""
    w = Window.partitionBy(*within, *keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_k(df: DataFrame, within: list[str], score: Column, k: int, tie: str) -> DataFrame:
    """The ``k`` best rows of each group, with their place."""
    w = Window.partitionBy(*within).orderBy(score.desc(), F.col(tie))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def dominant(df: DataFrame, within: list[str], key: str) -> DataFrame:
    """The most frequent key of each group, the first by name on ties; and the counts as a map."""
    n = df.groupBy(*within, key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*within).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(key).alias("k"))).getField("k").alias("dominant"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "n"))).alias("counts"))


# Fixed values of boundary lines: the percentile of the scores that a line must pass, by how much, and at least; how far apart lines
# must be, in shares of the profile and in places.
LINE_PERCENTILE, LINE_ABOVE, LINE_LEAST, LINE_APART, LINE_PLACES = 0.82, 1.15, 0.030, 0.035, 4


def separated_lines(scored: DataFrame, keys: list[str], place: str, score: str, length: str, most: int = 6) -> DataFrame:
    """keys, ``place``, ``score`` of the best places of each profile: by falling score, none under the profile's floor and none
    near one that was taken before; of equal scores the first place. ``length`` is the whole profile's.

    What passes the floor is a fifth of a profile at most; the choice folds over it as one sorted array.
    """
    by = Window.partitionBy(*keys)
    floor = F.greatest(F.percentile(score, F.lit(LINE_PERCENTILE)).over(by) * LINE_ABOVE, F.lit(LINE_LEAST))
    apart = F.greatest(F.lit(LINE_PLACES), F.bround(F.col(length) * LINE_APART).cast("int"))
    above = scored.withColumn("_floor", floor).filter(F.col(score) >= F.col("_floor"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(place).cast("long").alias("p"))))
    taken = lambda out, x: F.when((F.size(out) >= most) | F.exists(out, lambda k: F.abs(k["p"] - x["p"]) < F.col("_apart")), out).otherwise(F.array_append(out, x))
    kept = above.groupBy(*keys).agg(rows.alias("_rows"), F.first(apart).alias("_apart")).withColumn("_kept", F.aggregate("_rows", F.array().cast("array<struct<s:double,p:bigint>>"), taken))
    return kept.select(*keys, F.explode("_kept").alias("x")).select(*keys, F.col("x.p").alias(place), (-F.col("x.s")).alias(score))
