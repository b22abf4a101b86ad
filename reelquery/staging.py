"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Stored size up to which a table may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all tasks run on
    this machine (tests) is a temporary folder made and remembered.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelquery-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, so a lost
    executor costs a reread, and several consumers share one computation. The tables lie under
    one folder per application and may be removed when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelquery/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Size of a staged table's files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(small: DataFrame, max_rows: int) -> DataFrame:
    """``small`` (a staged table) with a broadcast hint if it has at most ``max_rows`` rows and is stored in at
    most ``BROADCAST_BYTES``; beyond that the planner shuffles both sides, and adaptive execution splits
    skewed partitions."""
    return F.broadcast(small) if stored_bytes(small) <= BROADCAST_BYTES and small.count() <= max_rows else small
