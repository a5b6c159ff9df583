"""The export journal as a stream. An addition: the programs whose work this library does only append lines to a file.

One JSON object a line, with a time and an event; batches are told apart by folder of the output. State is bounded by the
watermark, lines that come later are dropped, and a checkpoint folder makes the counts survive a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOURNAL = "time string, event string, total int, done int, outputs array<string>, source string, output string, message string, text string"
EVENTS = ("batch_start", "item_start", "item_done", "item_failed", "batch_finish")


def append(spark: SparkSession, path: str, events: list[dict]) -> None:
    spark.createDataFrame([{k: e.get(k) for k in ("time", "event", "source", "output", "message", "text")} for e in events], "time string, event string, source string, output string, message string, text string").write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.schema(JOURNAL).json(path))


def stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    return _typed(spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_each).json(path))


def _typed(lines: DataFrame) -> DataFrame:
    """Lines of a known event with a readable time."""
    return lines.withColumn("at", F.try_to_timestamp("time")).filter(F.col("at").isNotNull() & F.col("event").isin(*EVENTS))


def progress(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by kind and window of time."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "n")


def last_state(events: DataFrame) -> DataFrame:
    """The latest event of each source, and whether it is done."""
    last = events.groupBy("source").agg(F.max(F.struct("at", "event", "output")).alias("last"))
    return last.select("source", F.col("last.at").alias("at"), F.col("last.event").alias("event"), (F.col("last.event") == "item_done").alias("done"))


def start(spark: SparkSession, path: str, to: str, checkpoint: str, **how) -> StreamingQuery:
    """Writes finished windows to ``to`` as Parquet, once each; takes what is there and stops."""
    out = progress(stream(spark, path), **how)
    return out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
