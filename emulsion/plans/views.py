"""The driver's tables seen as pixels, frames, profiles, gains, files and candidates; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import clip

WIDTH = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, r, g, b: one pixel a line item."""
    base = 0.05 + 0.9 * (F.col("l_quantity") - 1) / 49
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_suppkey").alias("frame_id"),
        clip(base + (F.col("l_discount") - 0.05) * 2.0, 0.0, 1.0).alias("r"),
        base.alias("g"),
        clip(base + (F.col("l_tax") - 0.04) * 2.5, 0.0, 1.0).alias("b"),
    )


PIXELS = """px AS (
  SELECT frame_id, greatest(least(base + (l_discount - 0.05::DOUBLE) * 2, 1), 0) AS r, base AS g, greatest(least(base + (l_tax - 0.04::DOUBLE) * 2.5::DOUBLE, 1), 0) AS b
  FROM (SELECT l_suppkey AS frame_id, l_discount, l_tax, 0.05::DOUBLE + 0.9::DOUBLE * (l_quantity - 1) / 49 AS base FROM lineitem))"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, y, x, r, g, b: the pixels laid out in rows of WIDTH by a total order of the values."""
    order = Window.partitionBy("frame_id").orderBy("r", "g", "b")
    at = F.row_number().over(order) - 1
    return pixels(spark, sf_dir).withColumn("at", at).select("frame_id", F.floor(F.col("at") / WIDTH).cast("int").alias("y"), (F.col("at") % WIDTH).alias("x"), "r", "g", "b")


RASTER = PIXELS + f""", rs AS (
  SELECT frame_id, CAST(ri // {WIDTH} AS INTEGER) AS y, CAST(ri % {WIDTH} AS INTEGER) AS x, r, g, b
  FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY r, g, b) - 1 AS ri FROM px))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, roll_id: suppliers as frames, regions as rolls."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_suppkey").alias("frame_id"), F.col("n_regionkey").alias("roll_id"))


FRAMES = "fr AS (SELECT s_suppkey AS frame_id, n_regionkey AS roll_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, i, v: a user's events in the order of time; a user's are few at every scale."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).alias("i"), F.col("value").alias("v"))


PROFILE = "pf AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, pos, r, g, b, w: gain vectors and weights, fifty a roll."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("key"), F.col("vec_id").alias("pos"), F.exp(0.5 * e(1)).alias("r"), F.exp(0.5 * e(2)).alias("g"), F.exp(0.5 * e(3)).alias("b"), (0.01 + F.abs(e(4))).alias("w")
    )


GAINS = """gn AS (SELECT vec_id // 50 AS key, vec_id AS pos, exp(0.5 * embedding[1]::DOUBLE) AS r, exp(0.5 * embedding[2]::DOUBLE) AS g, exp(0.5 * embedding[3]::DOUBLE) AS b,
  0.01::DOUBLE + abs(embedding[4]::DOUBLE) AS w FROM embeddings)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, folder, name: made-up file names, among them doubles, positives and odd suffixes; a folder is a part of a source."""
    d = table(spark, sf_dir, "documents")
    stem = F.format_string("IMG_%04d", (F.col("doc_id") % 340).cast("int"))
    suffix = F.element_at(F.array(*(F.lit(s) for s in (".CR3", ".nef", ".jpg", ".tif", "_positive.dng", ".dng", ".txt"))), ((F.floor(F.col("doc_id") / 340) * 2 + F.col("doc_id")) % 7 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 2000)).alias("folder"), F.concat(stem, suffix).alias("name"))


FILES = """fl AS (SELECT doc_id AS file_id, source || '/' || doc_id // 2000 AS folder,
  printf('IMG_%04d', doc_id % 340) || ['.CR3', '.nef', '.jpg', '.tif', '_positive.dng', '.dng', '.txt'][(doc_id // 340 * 2 + doc_id) % 7 + 1] AS name FROM documents)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, cand_pos, x, y, width, height, angle in an image of 640 x 480; twenty a frame."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.floor(k / 20).alias("frame_id"), k.alias("cand_pos"), (k * 7 % 200).cast("int").alias("x"), (k * 13 % 150).cast("int").alias("y"),
        (200 + s * 6).cast("int").alias("width"), (120 + k % 5 * 40).cast("int").alias("height"), ((k % 121 - 60) * 1.5).cast("double").alias("angle"),
    )


CANDIDATES = """cd AS (SELECT p_partkey // 20 AS frame_id, p_partkey AS cand_pos, CAST(p_partkey * 7 % 200 AS INTEGER) AS x, CAST(p_partkey * 13 % 150 AS INTEGER) AS y,
  200 + p_size * 6 AS width, CAST(120 + p_partkey % 5 * 40 AS INTEGER) AS height, (p_partkey % 121 - 60) * 1.5::DOUBLE AS angle FROM part)"""
