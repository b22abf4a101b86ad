"""Queries of single building blocks that the larger plans use inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reelquery.functions import formats as fm
from reelquery.functions.vector import dot, norm, normalize
from reelquery.operators import metrics, scoring
from reelquery.operators.quantiles import quantiles
from reelquery.plans.base import CLIP_SQL, FRAMES_SQL, HITS_SQL, clip_hits, d, frames, hits, queries, six, table
from reelquery.plans.retrieval import IMAGE_SQL, METRIC_SQL, truth_ranks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


@query(f"WITH {FRAMES_SQL}, q AS (SELECT v FROM fr WHERE vec_id = (SELECT max(vec_id) FROM fr)), s AS (SELECT fr.vec_id, list_dot_product(q.v, fr.v) AS sim FROM fr CROSS JOIN q) SELECT vec_id, round(sim, 6) AS sim FROM s ORDER BY s.sim DESC, vec_id LIMIT 10")
def global_topk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten frames nearest to one, the last; the limit is the operator."""
    fr = frames(spark, sf_dir)
    one = fr.agg(F.max_by("embedding", "vec_id").alias("_q"))
    scored = fr.join(F.broadcast(one), F.lit(True)).select("vec_id", dot("_q", "embedding").alias("sim"))
    return scored.orderBy(F.desc("sim"), "vec_id").limit(10).select("vec_id", six("sim"))


@query(f"WITH {FRAMES_SQL} SELECT vec_id, media_id FROM fr WHERE media_id IN ('media_00', 'media_02', 'media_04', 'media_05', 'media_07', 'media_09')")
def media_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).filter(F.col("media_id").isin("media_00", "media_02", "media_04", "media_05", "media_07", "media_09")).select("vec_id", "media_id")


@query(f"WITH {IMAGE_SQL} SELECT q.vec_id AS query_id, list(p.media_id ORDER BY p.position) AS top3, coalesce(bool_or(p.media_id = q.media_id), false) AS hit FROM qu q JOIN po p ON p.query_id = q.vec_id AND p.position <= 3 GROUP BY q.vec_id")
def topk_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    first = scoring.order_episodes(scoring.image_scores(hits(fr)), 3).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "media_id"))), lambda p: p["media_id"]).alias("top3"))
    truth = queries(fr).select(F.col("vec_id").alias("query_id"), "media_id")
    return first.join(truth, "query_id").select("query_id", "top3", F.array_contains("top3", F.col("media_id")).alias("hit"))


@query(f"WITH {CLIP_SQL} SELECT query_id, vec_id, round(max(sim), 6) AS best, round(avg(sim), 6) AS mean, count(*) AS n FROM chits GROUP BY query_id, vec_id")
def candidate_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_hits(frames(spark, sf_dir)).groupBy("query_id", "vec_id").agg(F.round(F.max("sim"), 6).alias("best"), F.round(F.avg("sim"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, round(sim / log2(rank + 1), 6) AS discounted FROM hits")
def discounted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(frames(spark, sf_dir)).select("query_id", "vec_id", F.round(F.col("sim") / F.log2(F.col("rank") + 1), 6).alias("discounted"))


@query("SELECT event_id, user_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1000000 AS gap FROM events")
def consecutive_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", ((t - F.lag(t).over(order)) / 1e6).alias("gap"))


@query(f"SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), {d(0.6)}), 6) AS p60, round(median(CAST(value AS DOUBLE)), 6) AS median, round(stddev_pop(CAST(value AS DOUBLE)), 6) AS deviation FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "value")
    spread = e.groupBy(F.col("event_type").alias("_t")).agg(F.round(F.stddev_pop(F.col("value").cast("double")), 6).alias("deviation"))
    found = quantiles(e, ["event_type"], "value", {"p60": 0.6, "median": 0.5})
    return found.join(spread, F.col("event_type").eqNullSafe(F.col("_t"))).select("event_type", six("p60"), six("median"), "deviation")


@query(f"WITH {FRAMES_SQL}, n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS l, v FROM fr) SELECT vec_id, round(l, 6) AS length, round(v[1] / (l + {d(1e-12)}), 6) AS added, round(v[2] / CASE WHEN l = 0 THEN 1 ELSE l END, 6) AS kept, round(v[3] / greatest(l, {d(1e-12)}), 6) AS floored FROM n")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    part = lambda how, i: F.round(normalize("embedding", how)[i], 6)
    return fr.select("vec_id", F.round(norm("embedding"), 6).alias("length"), part("add", 0).alias("added"), part("keep", 1).alias("kept"), part("floor", 2).alias("floored"))


@query("SELECT event_id, json_extract_string(CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR), '$.type') AS kind, CAST(json_extract_string(CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR), '$.id') AS BIGINT) AS id FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return table(spark, sf_dir, "events").withColumn("_j", F.from_json(text, "id bigint, type string")).select("event_id", F.col("_j.type").alias("kind"), "_j.id")


@query(f"WITH {METRIC_SQL} SELECT count(*) AS queries, count(*) FILTER (truth_rank = 1) AS corrected FROM tr")
def corrected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries have their own episode first."""
    return metrics.corrected(truth_ranks(frames(spark, sf_dir))).select("queries", "corrected")


#: Every two hundredth frame is a hard query; before, those of even items were right.
HARD_SQL = METRIC_SQL + """,
hd AS (SELECT vec_id, media_id, season, episode, CAST(ts AS INTEGER) AS seconds FROM qu WHERE vec_id % 200 = 0)"""


@query(f"WITH {HARD_SQL} SELECT h.media_id AS title, h.season, h.episode, h.seconds, t.truth_rank, CAST(CASE WHEN right(h.media_id, 1) IN ('0', '2', '4', '6', '8') THEN 1 END AS INTEGER) AS was, right(h.media_id, 1) IN ('0', '2', '4', '6', '8') AND coalesce(t.truth_rank, 0) <> 1 AS lost FROM hd h JOIN tr t ON t.query_id = h.vec_id")
def hard_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hard queries are right, and which are so no longer."""
    fr = frames(spark, sf_dir)
    key = [F.col("media_id").alias("title"), F.col("season"), F.col("episode"), F.col("ts").cast("int").alias("seconds")]
    hard = queries(fr).filter("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"), *key)
    found = scoring.order_episodes(scoring.image_scores(hits(fr)), None).select("query_id", "position", F.col("media_id").alias("found_title"), F.col("season").alias("found_season"), F.col("episode").alias("found_episode"))
    before = hard.select("title", "season", "episode", "seconds", F.when(F.substring("title", -1, 1).cast("int") % 2 == 0, 1).alias("truth_rank"))
    return metrics.hard_regression(hard.join(found, "query_id"), hard.drop("query_id"), before)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE event_type END AS title, 'media_' || CAST(event_id % 9 AS VARCHAR) AS id FROM events")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    title = F.when(e % 4 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", fm.display_name(title, F.lit(None), F.lit(None), F.lit("none")).alias("title"), F.concat(F.lit("media_"), (e % 9).cast("string")).alias("id"))
