"""Exact quantiles of groups of any size. Values are dealt by ranges; sums of ranges tell which of them hold a wanted
rank, and only the rows of those are put in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelquery.staging import hinted, staged

BROADCAST_ROWS = 500_000


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each of ``shares``: the value at that share of a group's values, interpolated between
    neighbours as ``percentile`` does. Nulls don't count; a group of nothing else has null quantiles, NaN is the
    greatest value.

    Equal values are counted together first, so that no value's copies meet in one task. No group is held in
    memory: a group with many values lies in many ranges.
    """
    counts = rows.select(*by, F.col(value).cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count("_v").alias("_c"))
    ranged = staged(counts.repartitionByRange(*(F.col(c) for c in by), "_v").withColumn("_range", F.spark_partition_id()), "quantile-ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_in"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_all": F.sum("_in").over(Window.partitionBy(*by))})
    # a wanted rank lies between two values' ranks, a lower and a higher one
    at = {n: F.lit(s) * (F.col("_all") - 1) for n, s in shares.items()}
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(side).alias("side"), f(x).cast("long").alias("rank"), (x - F.floor(x)).alias("part")) for n, x in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))))
    mine = F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_in")))
    wanted = staged(sums.select(*by, "_range", "_before", mine.alias("_ranks")).filter(F.size("_ranks") > 0), "quantile-ranks")
    keys = [*by, "_range"]
    held = ranged.alias("r").join(hinted(wanted, BROADCAST_ROWS).alias("w"), _same("r", "w", keys)).select(*(F.col(f"r.{c}").alias(c) for c in keys), "_v", "_c", "_before", "_ranks")
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    inside = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_to") - F.col("_c")) & (r["rank"] < F.col("_to")))
    found = held.withColumn("_to", upto).select(*by, "_v", F.inline(inside))
    one = lambda n, side, c: F.max(F.when((F.col("name") == n) & (F.col("side") == side), F.col(c)))
    ends = found.groupBy(*by).agg(*(one(n, side, "_v").alias(f"_{side}_{n}") for n in shares for side in ("lo", "hi")), *(one(n, "lo", "part").alias(f"_part_{n}") for n in shares))
    between = {n: F.when(F.col(f"_part_{n}") == 0, F.col(f"_lo_{n}")).otherwise((1 - F.col(f"_part_{n}")) * F.col(f"_lo_{n}") + F.col(f"_part_{n}") * F.col(f"_hi_{n}")) for n in shares}
    groups = sums.select(*by).distinct()
    return groups.alias("g").join(ends.alias("e"), _same("g", "e", by), "left").select(*(F.col(f"g.{c}").alias(c) for c in by), *(x.alias(n) for n, x in between.items()))
