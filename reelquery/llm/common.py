"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelquery.staging import BROADCAST_BYTES, hinted, shared_dir, staged, stored_bytes  # noqa: F401

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sealed(df: DataFrame) -> DataFrame:
    """``df`` as one column, row: whatever its columns are called, they can't clash with an operator's own."""
    return df.select(F.struct("*").alias("row"))


def field(name: str) -> Column:
    """A column of a sealed row."""
    return F.col("row").getField(name)


def unsealed(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that the row was made of, with others in place of those ``changed``."""
    return df.select(*((changed[c] if c in changed else field(c)).alias(c) for c in names))


def mix64(*cols) -> F.Column:
    """A second 64-bit hash, independent of ``xxhash64(*cols)``."""
    return F.xxhash64(F.lit(7919), *cols)
