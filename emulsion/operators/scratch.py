"""Small tables kept between steps in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def place(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, as in tests, it is in a local folder of this process; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="emulsion-"))
        folder = _own[0]
    return f"{folder.rstrip('/')}/emulsion/step-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet at a new ``place`` and read back, so that later plans begin there."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
