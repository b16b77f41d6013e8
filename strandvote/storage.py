"""Tables on the way: written in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local master gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its plan ends there, and a lost task reads the table again."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, marked to be broadcast if it has so many rows at most; else Spark decides by its size."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of a partition that is dealt by a key.
DEALT = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys into partitions of about DEALT of its rows, so that a task's memory doesn't grow with the input; up to DEALT rows are left to Spark.

    Spark's own exchanges have a fixed number of partitions, and adaptive execution joins these up to 64 MB of packed rows.
    """
    return df if rows <= DEALT else df.repartition(-(-rows // DEALT), *keys)
