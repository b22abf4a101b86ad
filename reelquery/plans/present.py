"""Results as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelquery.functions import formats as fm


def shown(episodes: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Episodes (query_id, position, media_id, season, episode, score, best_frame) as rows for people: name, time of
    the best frame, score in percent and its confidence. Titles come from ``media`` (id, title)."""
    rows = episodes.join(media.select(F.col("id").alias("media_id"), "title"), "media_id", "left") if media is not None else episodes.withColumn("title", F.lit(None).cast("string"))
    name = fm.display_name("title", "season", "episode", "media_id")
    return rows.select("query_id", "position", name.alias("name"), fm.clock_hundredths(F.col("best_frame.ts")).alias("time"), F.format_string("%.2f%%", F.col("score") * 100).alias("percent"), fm.confidence("score").alias("confidence")).orderBy("query_id", "position")
