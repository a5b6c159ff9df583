"""Connected components of a graph that is only held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of ``edges`` (a long, b long): root is the smallest id reachable. Roots themselves included.

    Alternating large-star and small-star steps; each round is a table in the shared folder. Loops and repeats do no harm. A
    node with very many edges meets its minimum by a partial aggregate; the minima are a table of their own, so that nothing but
    the join needs a node's edges together and adaptive execution can split them.
    """
    clean = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now, sign = settle(clean, "edges"), None
    while True:
        old = [now]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settle(both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        old += [least, large]
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = settle(small, "edges")
        discard(*old, least)
        found = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(found) == sign:
            break
        sign = tuple(found)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
