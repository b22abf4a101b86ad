"""Row numbers without a partition that holds a whole group, or all rows.

Rows are dealt by ranges of (group, order), each range sorted on its own, and the ranges written once, so that their
borders stay. A row's number is its place in its range plus the rows of its group in the ranges before; those are counts
of a row for each group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelquery.staging import hinted, staged

#: Counts of groups and ranges up to this many rows are broadcast.
BROADCAST_ROWS = 500_000


def numbered(df: DataFrame, order: list[Column], name: str = "number", by: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: each row's number from 1 in ``order``, within its group if ``by`` names one.

    ``order`` should tell rows apart; rows that it doesn't are numbered in any order and lie in one range. Nulls
    in ``by`` are a group. Keep ``df`` narrow: it is sorted and written as it is.
    """
    by = by or []
    ranged = df.repartitionByRange(*(F.col(c) for c in by), *order).sortWithinPartitions(*by, *order)
    placed = staged(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)), F.col("_range") == F.col("_r"))
    out = placed.join(hinted(staged(offsets, "numbered-offsets"), BROADCAST_ROWS), met)
    return out.select(*df.columns, (F.col("_at") + F.col("_add")).alias(name))
