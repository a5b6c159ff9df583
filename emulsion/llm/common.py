"""Helpers that the corpus operators share: tables, shared scratch tables, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, on a local master only."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="emulsion-"))
    return _own_folder[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows is recomputed from this table when an executor is lost, not from the start.
    """
    path = f"{shared_folder(df.sparkSession)}/emulsion/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering Spark's own default of 64 MB a batch between the JVM and Python to 2 MB, for the session.

    A batch is in memory several times on its way; a setting of the user's own stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) == "67108864b":
        conf.set(BATCH_BYTES, "2m")
    return df
