"""Ranking metrics. A query that lists nothing for its truth counts as a miss."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from reelquery.operators.knn import nearest
from reelquery.operators.scoring import image_scores, order_episodes
from reelquery.schemas import EPISODE


def truth_ranks(truth: DataFrame, ranking: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """query_id, truth_rank: the first position with the truth's ``by`` (nulls equal), or null."""
    on = F.col("t.query_id") == F.col("r.query_id")
    for c in by:
        on = on & F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}"))
    return truth.alias("t").join(ranking.alias("r"), on, "left").groupBy("t.query_id").agg(F.min(f"r.{position}").alias("truth_rank"))


def topk(k: int, rank: str = "truth_rank", evaluated_only: bool = False) -> Column:
    """Share of queries whose truth is among the first k, of all or of those that rank it at all."""
    hit = (F.col(rank) <= k).cast("double")
    return F.avg(hit if evaluated_only else F.coalesce(hit, F.lit(0.0)))


def mrr(rank: str = "truth_rank") -> Column:
    return F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0)))


def accuracy(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("queries"), *(topk(k).alias(f"top{k}") for k in (1, 3, 5)), mrr().alias("mrr"))


def sample_ids(spark: SparkSession, n: int, k: int, seed: int = 42) -> DataFrame:
    """position: k of 0..n-1 without replacement, the same for a seed as Python's own generator gives."""
    return spark.createDataFrame([(i,) for i in random.Random(seed).sample(range(n), min(k, n))], "position long")


#: The hard queries that a change must not lose: title, season, episode, seconds. Fixed values.
HARD_QUERIES = [("Lucifer", 1, 13, 896), ("Stranger_Things", 3, 1, 2990), ("Lucifer", 1, 3, 490), ("Stranger_Things", 2, 1, 1840), ("Stranger_Things", 3, 4, 288), ("Lucifer", 1, 9, 640), ("Stranger_Things", 3, 6, 2570)]


def hard_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HARD_QUERIES, "title string, season int, episode int, seconds int")


def corrected(ranks: DataFrame) -> DataFrame:
    """How many queries have their truth first, of how many."""
    return ranks.agg(F.count_if(F.col("truth_rank") == 1).alias("corrected"), F.count("*").alias("queries"))


def hard_regression(ranking: DataFrame, hard: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """title, season, episode, seconds, truth_rank and, with an earlier result ``before``, was and lost: how the hard
    queries fare, and which of those that were right are right no longer. ``ranking``: title, season, episode, seconds of the
    query, position and the ranked episode as found_title, found_season, found_episode."""
    key = ["title", "season", "episode", "seconds"]
    right = ranking.filter("found_title = title AND found_season <=> season AND found_episode <=> episode")
    now = _with(hard, right.groupBy(*key).agg(F.min("position").alias("truth_rank")), key)
    if before is None:
        return now
    lost = (F.col("was") == 1) & ~F.coalesce(F.col("truth_rank") == 1, F.lit(False))
    return _with(now, before.select(*key, F.col("truth_rank").alias("was")), key).withColumn("lost", F.coalesce(lost, F.lit(False)))


def _with(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``more`` by ``key``; nulls, as films have for season and episode, are equal."""
    more = more.withColumnsRenamed({c: f"_{c}" for c in key})
    return rows.join(more, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key)), "left").drop(*(f"_{c}" for c in key))


def sampled(rows: DataFrame, n: int, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """``n`` rows (all, if there are fewer) drawn by a hash of ``key``: the same for a seed, however rows are partitioned."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def evaluation(frames: DataFrame, samples: int = 50, k: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(accuracy, failures) of finding the episodes of sampled frames (vec_id, media_id, season, episode, ts, embedding) among
    all others: queries and shares of them among the first one, three and five; and the queries whose episode isn't
    first, with what was: query_id, truth_rank, media_id, season, episode, score."""
    asked = sampled(frames.filter("embedding IS NOT NULL"), samples, seed)
    hits = nearest(frames, asked.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("self_id"), "embedding"), k)
    hits = hits.join(frames.select("vec_id", *EPISODE, "ts"), "vec_id")
    ranking = order_episodes(image_scores(hits), None)
    ranks = truth_ranks(asked.select(F.col("vec_id").alias("query_id"), *EPISODE), ranking, list(EPISODE))
    missed = ranks.filter("truth_rank IS NULL OR truth_rank > 1").join(ranking.filter("position = 1").select("query_id", *EPISODE, "score"), "query_id", "left")
    return accuracy(ranks), missed


def throughput(images: int, seconds: float) -> dict[str, float]:
    """Images a second and a minute, seconds an image."""
    return {"images_per_second": images / seconds if seconds else 0.0, "images_per_minute": 60 * images / seconds if seconds else 0.0, "seconds_per_image": seconds / images if images else 0.0}


class Measured:
    """What a run of a plan does, observed as it runs: ``rows`` is the plan with timed rows (began, ended: seconds since the
    epoch of the batch that a row was in; failed: whether it has no result), to be written or collected once."""

    def __init__(self, rows: DataFrame):
        self._seen = Observation()
        work = F.sum((F.col("ended") - F.col("began")) / F.col("batch"))
        self.rows = rows.observe(self._seen, F.count("*").alias("images"), F.count_if("failed").alias("failed"), F.min("began").alias("began"), F.max("ended").alias("ended"), work.alias("model_seconds")).drop("began", "ended", "batch")

    def report(self) -> dict[str, float]:
        """images, failed, seconds (from the first batch's begin to the last one's end), model_seconds (of all tasks), and
        throughput by both. After the run."""
        seen = self._seen.get
        seconds, spent = (seen["ended"] or 0.0) - (seen["began"] or 0.0), seen["model_seconds"] or 0.0
        return {"images": seen["images"], "failed": seen["failed"], "seconds": seconds, "model_seconds": spent} | throughput(seen["images"], seconds) | {"images_per_model_second": seen["images"] / spent if spent else 0.0}
