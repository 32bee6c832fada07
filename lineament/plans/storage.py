"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: every
executor can read the files, so losing one loses nothing.  Only where the
setting is absent and Spark runs in one process (tests, a laptop) is a folder of
our own chosen; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes as estimated from its counted rows.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one for this process if none is set and it is alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lineament-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lineament_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written(); nothing may read it afterwards."""
    path = getattr(df, "_lineament_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sized(small: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Broadcast hint for a stored table that was counted and is small; beyond that Spark shuffles."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n * row_bytes <= BROADCAST_BYTES else small


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
