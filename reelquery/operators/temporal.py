"""Joins and windows over time: offsets, nearest as-of, grids, intervals, clusters.

Windows are by media item, whose length bounds them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reelquery.operators.numbering import numbered
from reelquery.staging import hinted, staged, stored_bytes


def offsets(centers: DataFrame, frames: DataFrame, steps: list[int], keep_missing: bool, clamp: bool = False) -> DataFrame:
    """Each center (query_id, media_id, frame_no) with its frames at the ``steps``: query_id, step, and the
    columns of ``frames``. A missing frame is a row of nulls or no row; ``clamp`` moves steps before the
    first frame onto it and drops repeats."""
    at = centers.select("query_id", F.col("media_id").alias("_m"), "frame_no").withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    at = at.withColumn("_n", F.col("frame_no") + F.col("step")).drop("frame_no")
    if clamp:
        at = at.withColumn("_n", F.greatest("_n", F.lit(1))).groupBy("query_id", "_m", "_n").agg(F.min("step").alias("step"))
    joined = at.join(frames, (F.col("_m") == F.col("media_id")) & (F.col("_n") == F.col("frame_no")), "left" if keep_missing else "inner")
    return joined.drop("_m", "_n")


#: Rows of one key that are looked through in one task.
KEY_ROWS = 1_000_000
#: Sides that the planner estimates smaller than this aren't counted.
KEY_BYTES = 64 << 20


def nearest_as_of(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, id_: str, key_rows: int | None = None) -> DataFrame:
    """``left`` with the right row of the same key that is nearest in time: _near_time and _near_id; the earlier
    of two equally near, the smaller id of one time. Passes in time order instead of a comparison of
    all pairs. Left rows of keys that the right side lacks get nulls, so do those without a time.

    Keys of at most ``key_rows`` rows, counted unless all rows are few by the planner's sizes, are passed through whole, once forward and once back. If any has more, all rows are dealt by ranges of key and
    time, the last and first point of each range are carried over to the ranges after and before, and
    each range is passed through on its own.
    """
    points = right.groupBy(F.col(key).alias("_k"), F.col(right_time).alias("_t")).agg(F.min(id_).alias("_i")).filter("_t IS NOT NULL")
    both = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast(points.schema["_i"].dataType).alias("_i"), F.struct(*left.columns).alias("_row"))
    both = both.unionByName(points.select("_k", "_t", "_i", F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    point = F.when(F.col("_i").isNotNull(), F.struct("_t", "_i"))
    small = key_rows is None and stored_bytes(both) < KEY_BYTES
    most = 0 if small else left.select(F.col(key).alias("_k")).unionAll(right.select(F.col(key).alias("_k"))).groupBy("_k").count().agg(F.max("count")).first()[0] or 0
    if most <= (key_rows or KEY_ROWS):
        group, carried = ["_k"], both.withColumns({"_from": F.lit(None).cast(point_type := _type(both, point)), "_to": F.lit(None).cast(point_type)})
    else:
        group, carried = ["_k", "_range"], _carried(both, point)
    order = Window.partitionBy(*group).orderBy("_t")
    before = F.coalesce(F.last(point, True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_from"))
    # a frame that ends at the last row is summed anew for each row, so what comes after is looked for in falling order
    back = Window.partitionBy(*group).orderBy(F.desc("_t"))
    after = F.coalesce(F.last(point, True).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_to"))
    timed = F.col("_t").isNotNull()
    found = carried.withColumns({"_b": F.when(timed, before), "_a": F.when(timed, after)}).filter("_row IS NOT NULL")
    earlier = F.col("_a").isNull() | (F.col("_t") - F.col("_b")["_t"] <= F.col("_a")["_t"] - F.col("_t"))
    near = F.when(F.col("_b").isNotNull() & earlier, F.col("_b")).otherwise(F.col("_a"))
    return found.select("_row.*", near["_t"].alias("_near_time"), near["_i"].alias("_near_id"))


def _type(rows: DataFrame, column: Column):
    return rows.select(column).schema[0].dataType


def _carried(both: DataFrame, point: Column) -> DataFrame:
    """``both`` (_k, _t, _i, _row) with _range, and _from and _to: the key's nearest points in earlier and later ranges. Ties in
    time lie in one range as far as they are points, of which a key has one a time; left rows of one time may be dealt
    over several."""
    salt = F.when(F.col("_row").isNotNull(), F.xxhash64("_row"))
    ranged = staged(both.repartitionByRange("_k", "_t", salt.asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "as-of-ranges")
    ends = ranged.groupBy("_k", "_range").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    order = Window.partitionBy("_k").orderBy("_range")
    nearest = ends.select(F.col("_k").alias("_key"), F.col("_range").alias("_r"), F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_to"))
    return ranged.join(hinted(staged(nearest, "as-of-ends"), 500_000), F.expr("_k <=> _key AND _range = _r")).drop("_key", "_r")


def grid(frames: DataFrame, seconds: float = 30.0) -> DataFrame:
    """media_id, target_time: 0, 30, ... up to the last frame's time (and a tenth of a second)."""
    last = frames.groupBy("media_id").agg(F.max("ts").alias("_end"))
    steps = F.sequence(F.lit(0), F.floor((F.col("_end") + 0.1) / seconds).cast("int"))
    return last.select("media_id", F.explode(steps).alias("_i")).select("media_id", (F.col("_i") * seconds).alias("target_time"))


def overlapping(points: DataFrame, entries: DataFrame, seconds: float, key: str = "media_id", longest: float | None = None) -> DataFrame:
    """Pairs of a point (key, t) and an entry (key, start, end) with end >= t - seconds and start <= t + seconds.

    Entries are put into cells and joined by key and cell, so a pair meets without comparing all of a key; each pair is met
    in one cell, the first that both cover. Cells come in sizes: the window's length, four times that, and so on. An entry
    takes those of the least size of which it covers five at most, whatever its length, and a window looks into the
    cells of each size that any entry has. These are looked up first; a caller who knows how long entries are can say it
    by ``longest`` instead (longer ones are found too, by more cells each).
    """
    cell = 2.0 * seconds if seconds > 0 else 1.0
    cells = lambda lo, hi, size: F.sequence(F.floor(lo / size), F.floor(hi / size))
    span = F.greatest(F.col("end") - F.col("start"), F.lit(0.0)) / (4 * cell)
    top = 400 if longest is None else max(0, math.ceil(math.log(max(longest, cell) / (4 * cell), 4)))
    level = F.when(span > 1, F.least(F.ceil(F.log(4.0, span)), F.lit(top))).otherwise(0).cast("int")
    size = lambda c: F.lit(cell) * F.pow(F.lit(4.0), F.col(c))
    e = entries.filter("`end` >= start").withColumnRenamed(key, "_key").withColumn("_level2", level)
    levels = sorted(r[0] for r in e.select("_level2").distinct().collect()) if longest is None else list(range(top + 1))
    e = e.withColumn("_cell2", F.explode(cells(F.col("start"), F.col("end"), size("_level2"))))
    p = points.withColumns({"_lo": F.col("t") - seconds, "_hi": F.col("t") + seconds})
    p = p.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("_cell", F.explode(cells(F.col("_lo"), F.col("_hi"), size("_level"))))
    on = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_level2")) & (F.col("_cell") == F.col("_cell2")) & (F.col("end") >= F.col("_lo")) & (F.col("start") <= F.col("_hi"))
    once = F.col("_cell") == F.greatest(F.floor(F.col("_lo") / size("_level")), F.floor(F.col("start") / size("_level")))
    return p.join(e, on).filter(once).drop("_key", "_level", "_level2", "_cell", "_cell2", "_lo", "_hi")


def window_text(points: DataFrame, entries: DataFrame, seconds: float, by: list[str], key: str = "media_id", longest: float | None = None) -> DataFrame:
    """by, text: the entries within ``seconds`` of a point, joined by blanks in order of start and number."""
    met = overlapping(points, entries, seconds, key, longest).groupBy(*by)
    return met.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "entry_no", "text"))), lambda e: e["text"]), " ").alias("text"))


def within_radius(frames: DataFrame, media: Column, time: Column, seconds: float) -> DataFrame:
    """Frames of a media item at most ``seconds`` from a time, in order of time."""
    return frames.filter((F.col("media_id") == media) & (F.abs(F.col("ts") - time) <= seconds)).orderBy("ts", "vec_id")


def count_ahead(by: list[str], time: str, seconds: float, where: str | None = None) -> Column:
    """How many rows of the group, those with a value of ``where``, lie at a row's time or up to ``seconds`` later; any
    fraction of seconds will do."""
    keys = ", ".join(f"`{c}`" for c in by)
    return F.expr(f"count({f'`{where}`' if where else '*'}) OVER (PARTITION BY {keys} ORDER BY CAST(`{time}` AS DOUBLE) RANGE BETWEEN CURRENT ROW AND CAST({seconds} AS DOUBLE) FOLLOWING)")


def densest_cluster(rows: DataFrame, by: list[str], time: str = "ts", seconds: float = 12.0) -> DataFrame:
    """by, cluster: the most rows within ``seconds`` after any one of them."""
    return rows.withColumn("_n", count_ahead(by, time, seconds)).groupBy(*by).agg(F.max("_n").alias("cluster"))


def clip_times(duration: Column, n: int, most: float = 3.0, margin: float = 0.05) -> Column:
    """When to sample a clip: n even times in the first ``most`` seconds, short of the end; its middle for one."""
    from reelquery.functions.formats import linspace

    usable = F.least(duration, F.lit(most))
    return linspace(F.lit(0.0), usable, 1) if n == 1 else linspace(F.lit(0.0), F.greatest(usable - margin, F.lit(0.0)), n)


def frame_times(spark: SparkSession, frames: DataFrame, seconds: int = 2) -> DataFrame:
    """frames (media_id, image_path) with their number by path and their time. Numbered by ranges, so an item of any
    length runs over as many tasks as it needs."""
    n = numbered(frames, [F.col("image_path")], "frame_no", ["media_id"])
    return n.withColumn("frame_no", F.col("frame_no").cast("int")).withColumn("timestamp_seconds", (F.col("frame_no") - 1) * seconds)
