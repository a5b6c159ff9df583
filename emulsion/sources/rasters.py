"""Pixel relations as tables: partitioned by roll and frame, read with only the columns and rows that are asked for.

Camera files need a decoder that isn't part of Spark; the shipped source takes decoded Parquet pixels. Flat binary images (a
header of size and depth, then interleaved samples) have a Python data source of their own, to show how a decoder plugs in.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.color import clip, encoded

#: magic, width, height, full scale (255 or 65535), channels
HEADER = struct.Struct("<4sIIII")
MAGIC = b"FRAW"


def write_pixels(pixels: DataFrame, path: str) -> None:
    """roll_id, frame_id, y, x, r, g, b; files by roll, rows of a frame together so that row groups prune by frame and place."""
    pixels.repartition("roll_id", "frame_id").sortWithinPartitions("roll_id", "frame_id", "y", "x").write.mode("overwrite").partitionBy("roll_id").parquet(path)


def read_pixels(spark: SparkSession, path: str, rolls: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if rolls is None else df.filter(F.col("roll_id").isin(rolls))


def cropped(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """An upright crop with its own coordinates; the bounds reach the scan."""
    inside = pixels.filter((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def inset(pixels: DataFrame, keys: list[str], share: float, half_even: bool = True) -> DataFrame:
    """Without a border of ``share`` of each side; all pixels where nothing would be left."""
    s = min(max(share, 0.0), 0.30)
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    cut = lambda n: F.rint(F.col(n) * s) if half_even else F.floor(F.col(n) * s)
    j = pixels.join(size, keys)
    none = (cut("_h") * 2 >= F.col("_h")) | (cut("_w") * 2 >= F.col("_w"))
    inside = (F.col("y") >= cut("_h")) & (F.col("y") < F.col("_h") - cut("_h")) & (F.col("x") >= cut("_w")) & (F.col("x") < F.col("_w") - cut("_w"))
    return j.filter(none | inside).drop("_w", "_h")


def strided(pixels: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Every k-th pixel in raster order, k being the count over ``limit``; the same pixels each time."""
    size = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max("x") + 1).alias("_w"))
    j = pixels.join(size, keys)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / max(1, limit)))
    return j.filter((F.col("y") * F.col("_w") + F.col("x")) % k == 0).drop("_n", "_w")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(";") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            magic, width, height, full, channels = HEADER.unpack(f.read(HEADER.size))
            if magic != MAGIC or full not in (255, 65535) or channels not in (1, 3):
                raise ValueError(f"not a flat image: {partition.value}")
            kind = np.dtype("u1" if full == 255 else "<u2")
            for y in range(height):
                row = np.frombuffer(f.read(width * channels * kind.itemsize), kind).reshape(width, channels) / full
                r, g, b = (row[:, i % channels] for i in range(3))
                yield pa.record_batch([pa.array([partition.value] * width), pa.array(np.full(width, y, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(r), pa.array(g), pa.array(b)], names=["path", "y", "x", "r", "g", "b"])


class FlatImages(DataSource):
    """``spark.read.format("flat_image").option("paths", "a;b")``: one task a file, one batch a row of pixels."""

    @classmethod
    def name(cls) -> str:
        return "flat_image"

    def schema(self) -> str:
        return "path string, y int, x int, r double, g double, b double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def flat_bytes(rows: list[tuple[int, int, float, float, float]], width: int, height: int, full: int = 65535) -> bytes:
    """A flat image of (y, x, r, g, b) rows, gamma-encoded values given as they are."""
    kind = np.dtype("u1" if full == 255 else "<u2")
    a = np.zeros((height, width, 3), kind)
    for y, x, *v in rows:
        a[y, x] = np.floor(np.clip(v, 0, 1) * full + 0.5)
    return HEADER.pack(MAGIC, width, height, full, 3) + a.tobytes()


def export_rows(pixels: DataFrame, full: int = 255) -> DataFrame:
    """Linear pixels as the integers that an export holds."""
    return pixels.withColumns({c: encoded(clip(F.col(c), 0.0, 1.0), full) for c in "rgb"})
