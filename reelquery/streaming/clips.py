"""Arriving clip frames identified against a stored frame table. An extension: batches are scored as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from reelquery.operators.knn import nearest
from reelquery.operators.scoring import order_episodes, video_scores


def identify(clips: DataFrame, frames: DataFrame, k: int = 20, episodes: int = 5) -> DataFrame:
    """Episodes of each clip of ``clips`` (clip_id, step, embedding), best first."""
    q = clips.withColumn("_q", F.xxhash64("clip_id", "step"))
    hits = nearest(frames, q.select(F.col("_q").alias("query_id"), F.lit(None).cast("long").alias("self_id"), "embedding"), k).withColumnRenamed("query_id", "_q")
    hits = hits.join(q.select("_q", F.col("clip_id").alias("query_id"), "step"), "_q").join(frames.select("vec_id", "media_id", "season", "episode", "ts"), "vec_id")
    sizes = clips.groupBy(F.col("clip_id").alias("query_id")).agg(F.count_distinct("step").alias("clip_frames"))
    return order_episodes(video_scores(hits, sizes), episodes)


def identify_stream(clips: DataFrame, frames: DataFrame, sink: str, checkpoint: str, k: int = 20, episodes: int = 5) -> StreamingQuery:
    """Writes each micro-batch's episodes to a folder named by its number, so that a batch that is run again
    replaces its own output."""

    def score(batch: DataFrame, number: int) -> None:
        identify(batch, frames, k, episodes).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return clips.writeStream.option("checkpointLocation", checkpoint).foreachBatch(score).trigger(availableNow=True).start()
