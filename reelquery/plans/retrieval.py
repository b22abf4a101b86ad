"""Queries of visual retrieval: top-k, episode scores, temporal evidence, sequences, fingerprints, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquery.functions.text import CREDIT_THRESHOLDS, credit_score_thirds, credit_score_words, token_set
from reelquery.functions.vector import dot, normalize
from reelquery.operators import blockindex, fingerprints as fp, metrics, scoring, sequences as seq, temporal
from reelquery.operators.knn import beside, nearest, nearest_in_group, nearest_native
from reelquery.operators.scoring import KEY
from reelquery.plans.base import CLIP_SQL, FRAMES_SQL, HITS_SQL, STEPS, WIDE_STEPS, clip_frames, clip_hits, clip_sizes, d, frames, hits, named, queries, six
from reelquery.plans.text import CREDIT_A_SQL, CREDIT_TEXT_SQL, credit_text, credits
from reelquery.staging import staged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM ranks WHERE rank <= 50")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return nearest(fr, named(fr), 50).select("query_id", "vec_id", six("sim"), "rank")


@query(ORACLE_SQL["knn_topk"])
def knn_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stored index of blocks, of which those are read whose bound reaches a query's hits."""
    fr = frames(spark, sf_dir)
    index = staged(blockindex.build(fr), "block-index")
    return blockindex.search(index, named(fr), 50)[0].select("query_id", "vec_id", six("sim"), "rank")


@query(ORACLE_SQL["knn_topk"])
def knn_topk_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return nearest_native(fr, named(fr), 50).select("query_id", "vec_id", six("sim"), "rank")


@query(f"WITH {FRAMES_SQL}, p AS (SELECT q.vec_id AS query_id, f.vec_id, list_dot_product(q.v, f.v) AS sim FROM qu q JOIN fr f ON q.media_id = f.media_id AND q.vec_id <> f.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5")
def knn_per_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return nearest_in_group(fr, named(fr), 5).select("query_id", "vec_id", six("sim"), "rank")


@query(f"WITH {HITS_SQL} SELECT query_id, vec_id, media_id, round(sim, 6) AS sim, rank FROM ranks JOIN (SELECT vec_id AS q, media_id AS qm, ts AS qt FROM qu) ON q = query_id WHERE rank <= 50 AND NOT (media_id = qm AND abs(ts - qt) <= 6)")
def exclude_clip_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquery.operators.knn import leaks

    fr = frames(spark, sf_dir)
    own = queries(fr).select(F.col("vec_id").alias("query_id"), F.col("media_id").alias("qm"), F.col("ts").alias("qt"))
    rows = hits(fr).join(own, "query_id").filter(~leaks(F.col("media_id"), F.col("ts"), F.col("qm"), F.col("qt")))
    return rows.select("query_id", "vec_id", "media_id", six("sim"), "rank")


IMAGE_SQL = HITS_SQL + f""",
sc AS (SELECT query_id, media_id, season, episode, count(*) AS evidence, arg_max(vec_id, (sim, -vec_id)) AS best_vec,
         {d(0.6)} * max(sim) + {d(0.25)} * avg(sim) FILTER (r <= 3) + {d(0.15)} * avg(sim) FILTER (r <= 5) AS score
       FROM hits GROUP BY query_id, media_id, season, episode),
po AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, media_id NULLS FIRST, season NULLS FIRST, episode NULLS FIRST) AS INTEGER) AS position FROM sc)"""


@query(f"WITH {IMAGE_SQL} SELECT query_id, media_id, season, episode, evidence, best_vec, round(score, 6) AS score, position FROM po WHERE position <= 5")
def image_episode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.order_episodes(scoring.image_scores(hits(frames(spark, sf_dir))))
    return rows.select(*KEY, "evidence", F.col("best_frame.vec_id").alias("best_vec"), six("score"), "position")


@query(f"""WITH {CLIP_SQL}, sc AS (SELECT query_id, media_id, season, episode, {d(0.5)} * max(sim) + {d(0.3)} * avg(sim) FILTER (r <= 3) + {d(0.2)} * count(DISTINCT step) / any_value(clip_frames) AS score
  FROM chits JOIN sizes USING (query_id) GROUP BY query_id, media_id, season, episode) SELECT query_id, media_id, season, episode, round(score, 6) AS score FROM sc""")
def video_episode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return scoring.video_scores(clip_hits(fr), clip_sizes(fr)).select(*KEY, six("score"))


@query(f"WITH {FRAMES_SQL} SELECT q.vec_id AS query_id, CAST(s.step AS INTEGER) AS step, f.vec_id FROM fr q CROSS JOIN (SELECT unnest(range(-5, 6)) AS step) s LEFT JOIN fr f ON f.media_id = q.media_id AND f.frame_no = q.frame_no + s.step")
def neighbor_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return temporal.offsets(fr.withColumn("query_id", F.col("vec_id")), fr.drop("embedding"), WIDE_STEPS, keep_missing=True).select("query_id", "step", "vec_id")


@query(f"WITH {FRAMES_SQL}, s AS (SELECT CAST(unnest([-2, -1, 0, 1, 2]) AS INTEGER) AS step) SELECT q.vec_id AS query_id, s.step, f.vec_id FROM fr q CROSS JOIN s JOIN fr f ON f.media_id = q.media_id AND f.frame_no = q.frame_no + s.step")
def clip_offsets_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip of every frame."""
    fr = frames(spark, sf_dir)
    return temporal.offsets(fr.withColumn("query_id", F.col("vec_id")), fr.drop("embedding"), STEPS, keep_missing=False).select("query_id", "step", "vec_id")


@query(f"WITH {FRAMES_SQL}, o AS (SELECT q.vec_id AS query_id, q.media_id, greatest(q.frame_no + s.step, 1) AS n, min(s.step) AS step FROM fr q CROSS JOIN (SELECT unnest(range(-5, 6)) AS step) s GROUP BY ALL) SELECT o.query_id, CAST(o.step AS INTEGER) AS step, f.vec_id FROM o JOIN fr f ON f.media_id = o.media_id AND f.frame_no = o.n")
def clamped_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return temporal.offsets(fr.withColumn("query_id", F.col("vec_id")), fr.drop("embedding"), WIDE_STEPS, keep_missing=False, clamp=True).select("query_id", "step", "vec_id")


@query(f"""WITH {CLIP_SQL}, b AS (SELECT query_id, media_id, season, episode, step, max(sim) AS sim, max(sim / log2(rank + 1)) AS disc FROM chits GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, step) AS r FROM b)
  SELECT query_id, media_id, season, episode, round({d(0.35)} * avg(sim) FILTER (r <= 3) + {d(0.3)} * avg(sim) + {d(0.2)} * count(*) / any_value(clip_frames) + {d(0.15)} * max(disc), 6) AS score
  FROM n JOIN sizes USING (query_id) GROUP BY query_id, media_id, season, episode""")
def clip_episode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return scoring.clip_scores(clip_hits(fr), clip_sizes(fr)).select(*KEY, six("score"))


@query(f"""WITH {CLIP_SQL} SELECT query_id, media_id, season, episode, round({d(0.35)} * avg(sim) FILTER (r <= 3) + {d(0.45)} * avg(sim) + {d(0.2)} * count(DISTINCT step) / any_value(clip_frames), 6) AS score
  FROM chits JOIN sizes USING (query_id) GROUP BY query_id, media_id, season, episode""")
def clip_score_ocr_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return scoring.clip_scores_plain(clip_hits(fr), clip_sizes(fr)).select(*KEY, six("score"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t FROM events),
  l AS (SELECT user_id, event_id, t + 1800 AS t FROM e)
  SELECT l.event_id, arg_min(e.event_id, (abs(e.t - l.t), e.t, e.event_id)) AS near_id FROM l JOIN e ON l.user_id = e.user_id GROUP BY l.event_id""")
def asof_nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    left = e.withColumn("t", F.col("t") + 1800)
    return temporal.nearest_as_of(left, e, "user_id", "t", "t", "event_id").select("event_id", F.col("_near_id").alias("near_id"))


@query(f"WITH {FRAMES_SQL}, t AS (SELECT vec_id AS query_id, media_id, ts * {d(0.73)} + {d(0.9)} AS t FROM fr) SELECT t.query_id, arg_min(f.vec_id, (abs(f.ts - t.t), f.ts, f.vec_id)) AS near_id FROM t JOIN fr f ON t.media_id = f.media_id GROUP BY t.query_id")
def asof_nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    left = fr.select(F.col("vec_id").alias("query_id"), "media_id", (F.col("ts") * 0.73 + 0.9).alias("t"))
    return temporal.nearest_as_of(left, fr, "media_id", "t", "ts", "vec_id").select("query_id", F.col("_near_id").alias("near_id"))


FP_SQL = FRAMES_SQL + f""",
g AS (SELECT media_id, unnest(range(0, CAST(floor((max(ts) + {d(0.1)}) / 30) AS BIGINT) + 1)) * {d(30)} AS target_time FROM fr GROUP BY media_id),
fp AS (SELECT g.media_id, g.target_time, arg_min(f.vec_id, (abs(f.ts - g.target_time), f.ts, f.vec_id)) AS vec_id FROM g JOIN fr f ON g.media_id = f.media_id GROUP BY g.media_id, g.target_time)"""


@query(f"WITH {FP_SQL} SELECT media_id, target_time, vec_id FROM fp")
def grid_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.fingerprints(frames(spark, sf_dir)).select("media_id", "target_time", "vec_id")


TEMPORAL_SQL = HITS_SQL + f""",
ws AS (SELECT unnest(range(-5, 6)) AS step),
al AS (SELECT h.query_id, h.vec_id, list_dot_product(a.v, b.v) AS product FROM hits h JOIN fr q ON q.vec_id = h.query_id CROSS JOIN ws
       JOIN fr a ON a.media_id = q.media_id AND a.frame_no = q.frame_no + ws.step JOIN fr b ON b.media_id = h.media_id AND b.frame_no = h.frame_no + ws.step),
tm AS (SELECT query_id, vec_id, median(product) AS temporal FROM al GROUP BY query_id, vec_id)"""


def _temporal(fr: DataFrame) -> DataFrame:
    """Hits with temporal, the median over aligned neighbours of query and candidate."""
    h = hits(fr)
    slim = fr.select("media_id", "frame_no", "embedding")
    ours = temporal.offsets(queries(fr).withColumn("query_id", F.col("vec_id")), slim, WIDE_STEPS, keep_missing=False).select("query_id", "step", F.col("embedding").alias("_q"))
    theirs = temporal.offsets(h.select("media_id", "frame_no", "vec_id").distinct().withColumn("query_id", F.col("vec_id")), slim, WIDE_STEPS, keep_missing=False).select(F.col("query_id").alias("vec_id"), "step", F.col("embedding").alias("_c"))
    pairs = h.select("query_id", "vec_id").join(ours, "query_id").join(theirs, ["vec_id", "step"]).select("query_id", "vec_id", dot("_q", "_c").alias("product"))
    return h.join(scoring.temporal_medians(pairs), ["query_id", "vec_id"], "left").fillna(0.0, ["temporal"])


@query(f"WITH {TEMPORAL_SQL} SELECT h.query_id, h.vec_id, round(coalesce(temporal, 0), 6) AS temporal, round({d(0.4)} * sim + {d(0.6)} * coalesce(temporal, 0), 6) AS combined FROM hits h LEFT JOIN tm USING (query_id, vec_id)")
def temporal_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _temporal(frames(spark, sf_dir))
    return rows.withColumn("combined", scoring.combined(F.col("sim"), F.col("temporal"))).select("query_id", "vec_id", six("temporal"), six("combined"))


@query(f"""WITH {TEMPORAL_SQL}, t AS (SELECT h.*, CASE WHEN temporal > 0 THEN temporal END AS t FROM hits h LEFT JOIN tm USING (query_id, vec_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY t DESC NULLS LAST, vec_id) AS rt FROM t)
  SELECT query_id, media_id, season, episode, round({d(0.25)} * max(sim) + {d(0.25)} * avg(sim) FILTER (r <= 5) + {d(0.25)} * coalesce(max(t), 0) + {d(0.15)} * coalesce(avg(t) FILTER (rt <= 5), 0) + {d(0.1)} * least(count(*), 10) / 10, 6) AS score
  FROM n GROUP BY query_id, media_id, season, episode""")
def episode_rerank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rerank_scores(_temporal(frames(spark, sf_dir))).select(*KEY, six("score"))


STRONG_SQL = HITS_SQL + f""",
pc AS (SELECT query_id, media_id, season, episode, quantile_cont(sim, {d(0.6)}) AS p FROM hits GROUP BY ALL),
strong AS (SELECT h.* FROM hits h JOIN pc ON h.query_id = pc.query_id AND h.media_id = pc.media_id AND h.season IS NOT DISTINCT FROM pc.season AND h.episode IS NOT DISTINCT FROM pc.episode WHERE h.sim >= pc.p)"""


@query(f"WITH {STRONG_SQL} SELECT query_id, vec_id, round(sim, 6) AS sim FROM strong")
def percentile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.strong_rows(hits(frames(spark, sf_dir))).select("query_id", "vec_id", six("sim"))


@query(f"WITH {FRAMES_SQL}, c AS (SELECT media_id, count(*) OVER (PARTITION BY media_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND {d(12)} FOLLOWING) AS n FROM fr) SELECT media_id, max(n) AS cluster FROM c GROUP BY media_id")
def densest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.densest_cluster(frames(spark, sf_dir), ["media_id"])


CONSISTENCY_SQL = STRONG_SQL + f""",
cl AS (SELECT *, count(*) OVER (PARTITION BY query_id, media_id, season, episode ORDER BY ts RANGE BETWEEN CURRENT ROW AND {d(12)} FOLLOWING) AS n FROM strong),
co AS (SELECT query_id, media_id, season, episode, CASE WHEN count(*) < 2 THEN 0 ELSE {d(0.7)} * least({d(1)}, max(n) / {d(4)}) + {d(0.3)} * greatest({d(0)}, 1 - (quantile_cont(ts, {d(0.75)}) - quantile_cont(ts, {d(0.25)})) / 60) END AS temporal
       FROM cl GROUP BY query_id, media_id, season, episode)"""


@query(f"WITH {CONSISTENCY_SQL} SELECT query_id, media_id, season, episode, round(temporal, 6) AS temporal FROM co")
def temporal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.temporal_consistency(hits(frames(spark, sf_dir))).select(*KEY, six("temporal"))


TOKENS_SQL = "tk AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS t, text FROM documents)"
JACCARD_SQL = "CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END"


def with_ocr(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with ocr, the Jaccard similarity of the query's and the candidate's text, and that text. Documents stand
    for the recognised texts of the frames of their number; tokens are made of those that are asked for only."""
    from reelquery.functions.text import jaccard

    asked = rows.select(F.explode(F.array("query_id", "vec_id")).alias("doc_id")).distinct()
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(asked, "doc_id", "left_semi").select("doc_id", "text", token_set("text").alias("tokens"))
    a = t.select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("_a"))
    b = t.select(F.col("doc_id").alias("vec_id"), F.col("tokens").alias("_b"), F.col("text").alias("ocr_text"))
    empty = F.array().cast("array<string>")
    joined = rows.join(a, "query_id", "left").join(b, "vec_id", "left")
    return joined.withColumn("ocr", jaccard(F.coalesce("_a", empty), F.coalesce("_b", empty))).drop("_a", "_b")


V3_SQL = CLIP_SQL + f""", {TOKENS_SQL},
oc AS (SELECT h.*, coalesce({JACCARD_SQL}, 0) AS ocr FROM chits h LEFT JOIN tk a ON a.doc_id = h.query_id LEFT JOIN tk b ON b.doc_id = h.vec_id),
om AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY ocr DESC, vec_id, step) AS ro FROM oc),
pc AS (SELECT query_id, media_id, season, episode, quantile_cont(sim, {d(0.6)}) AS p FROM chits GROUP BY ALL),
st AS (SELECT h.* FROM chits h JOIN pc ON h.query_id = pc.query_id AND h.media_id = pc.media_id AND h.season IS NOT DISTINCT FROM pc.season AND h.episode IS NOT DISTINCT FROM pc.episode WHERE h.sim >= pc.p),
cl AS (SELECT *, count(*) OVER (PARTITION BY query_id, media_id, season, episode ORDER BY ts RANGE BETWEEN CURRENT ROW AND {d(12)} FOLLOWING) AS n FROM st),
co AS (SELECT query_id, media_id, season, episode, CASE WHEN count(*) < 2 THEN 0 ELSE {d(0.7)} * least({d(1)}, max(n) / {d(4)}) + {d(0.3)} * greatest({d(0)}, 1 - (quantile_cont(ts, {d(0.75)}) - quantile_cont(ts, {d(0.25)})) / 60) END AS temporal FROM cl GROUP BY query_id, media_id, season, episode),
pa AS (SELECT query_id, media_id, season, episode, max(sim) AS best, avg(sim) FILTER (r <= 3) AS top3, avg(sim) AS mean, least({d(1)}, count(DISTINCT step) / CAST(any_value(clip_frames) AS DOUBLE)) AS coverage,
         max(ocr) AS ocr_best, avg(ocr) FILTER (ro <= 3) AS ocr_top3 FROM om JOIN sizes USING (query_id) GROUP BY query_id, media_id, season, episode),
al AS (SELECT pa.*, coalesce(temporal, 0) AS temporal FROM pa LEFT JOIN co ON pa.query_id = co.query_id AND pa.media_id = co.media_id AND pa.season IS NOT DISTINCT FROM co.season AND pa.episode IS NOT DISTINCT FROM co.episode),
v3 AS (SELECT *, {d(0.45)} * best + {d(0.2)} * top3 + {d(0.1)} * mean + {d(0.1)} * coverage + {d(0.1)} * temporal + {d(0.05)} * ocr_top3 AS normal,
         {d(0.25)} * best + {d(0.1)} * top3 + {d(0.05)} * mean + {d(0.05)} * coverage + {d(0.2)} * temporal + {d(0.35)} * ocr_top3 AS c0 FROM al),
v4 AS (SELECT *, c0 + CASE WHEN ocr_best >= {d(0.75)} THEN {d(0.08)} WHEN ocr_best >= {d(0.5)} THEN {d(0.04)} ELSE 0 END AS c1 FROM v3),
v5 AS (SELECT *, CASE WHEN ocr_best <= {d(0.01)} THEN c1 * {d(0.92)} ELSE c1 END AS credit FROM v4)"""


def _v3(spark: SparkSession, sf_dir: str, credit: bool) -> DataFrame:
    fr = frames(spark, sf_dir)
    return scoring.episode_scores(with_ocr(clip_hits(fr), spark, sf_dir), clip_sizes(fr), credit=F.lit(credit))


@query(f"WITH {V3_SQL} SELECT query_id, media_id, season, episode, round(normal, 6) AS score, round(temporal, 6) AS temporal, round(ocr_top3, 6) AS ocr_top3 FROM v5")
def v3_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _v3(spark, sf_dir, False).select(*KEY, six("score"), six("temporal"), six("ocr_top3"))


@query(f"WITH {V3_SQL} SELECT query_id, media_id, season, episode, round(credit, 6) AS score FROM v5")
def v3_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _v3(spark, sf_dir, True).select(*KEY, six("score"))


OCR_SQL = HITS_SQL + f", {TOKENS_SQL}, oc AS (SELECT h.*, coalesce({JACCARD_SQL}, 0) AS ocr, coalesce(b.text, '') AS ocr_text FROM hits h LEFT JOIN tk a ON a.doc_id = h.query_id LEFT JOIN tk b ON b.doc_id = h.vec_id)"


@query(f"""WITH {OCR_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY ocr DESC, vec_id) AS ro FROM oc)
  SELECT query_id, media_id, season, episode, round(avg(ocr) FILTER (ro <= 3), 6) AS ocr_score, count(*) FILTER (ocr_text <> '') AS frames_with_text,
    round({d(0.8)} * ({d(0.6)} * max(sim) + {d(0.25)} * avg(sim) FILTER (r <= 3) + {d(0.15)} * avg(sim) FILTER (r <= 5)) + {d(0.2)} * avg(ocr) FILTER (ro <= 3), 6) AS fused
  FROM n GROUP BY query_id, media_id, season, episode""")
def ocr_episode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ocr(hits(frames(spark, sf_dir)), spark, sf_dir)
    by_text = scoring.ranked(rows, score="ocr").groupBy(*KEY).agg(scoring.top_mean(3, "ocr").alias("ocr_score"), F.count_if(F.coalesce("ocr_text", F.lit("")) != "").alias("frames_with_text"))
    both = scoring.fused(scoring.image_scores(rows), by_text, "ocr_score", 0.80, carry=("frames_with_text",))
    return both.select(*KEY, F.round("other_ocr_score", 6).alias("ocr_score"), "frames_with_text", six("fused"))


CREDIT_SQL = f"ca AS (SELECT doc_id, h, {CREDIT_A_SQL} AS credit FROM (SELECT doc_id, x, {credits('x')} AS h FROM ({CREDIT_TEXT_SQL})))"


def credit_scores(spark: SparkSession, sf_dir: str, asked: DataFrame, score) -> DataFrame:
    """doc_id and credit, by one of the four scores, of the texts that ``asked`` (doc_id) names."""
    return credit_text(spark, sf_dir).join(asked, "doc_id", "left_semi").select("doc_id", score("x").alias("credit"))


@query(f"""WITH {OCR_SQL}, {CREDIT_SQL},
  s AS (SELECT o.*, CASE WHEN coalesce(q.credit, 0) >= {d(0.35)} THEN ({d(0.3)} * sim + {d(0.7)} * ocr) * CASE WHEN ocr_text = '' OR coalesce(c.credit, 0) < {d(0.25)} THEN {d(0.9)} ELSE {d(1)} END ELSE {d(0.8)} * sim + {d(0.2)} * ocr END AS c
        FROM oc o LEFT JOIN ca q ON q.doc_id = o.query_id LEFT JOIN ca c ON c.doc_id = o.vec_id)
  SELECT query_id, media_id, season, episode, round(max(c), 6) AS score, arg_max(vec_id, (c, -vec_id)) AS best_vec FROM s GROUP BY query_id, media_id, season, episode""")
def credit_aware_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query is a credit scene, and a candidate shows credits, by the credit score of its recognised text."""
    h = hits(frames(spark, sf_dir))
    known = credit_scores(spark, sf_dir, h.select(F.explode(F.array("query_id", "vec_id")).alias("doc_id")).distinct(), credit_score_words)
    of = lambda key, name: known.select(F.col("doc_id").alias(key), F.col("credit").alias(name))
    rows = with_ocr(h, spark, sf_dir).join(of("query_id", "query_credit"), "query_id", "left").join(of("vec_id", "candidate_credit"), "vec_id", "left").fillna(0.0, ["query_credit", "candidate_credit"])
    rows = rows.withColumn("c", scoring.credit_aware(F.col("query_credit") >= CREDIT_THRESHOLDS["a"]))
    return rows.groupBy(*KEY).agg(F.round(F.max("c"), 6).alias("score"), F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("best_vec"))


@query(f"""WITH {V3_SQL}, {CREDIT_SQL}, cs AS (SELECT query_id, max(least({d(1)}, coalesce(h, 0) / {d(3)})) AS credit_score FROM clipids LEFT JOIN ca ON doc_id = vec_id GROUP BY query_id)
  SELECT query_id, media_id, season, episode, credit_score >= {d(0.35)} AS credit, round(CASE WHEN credit_score >= {d(0.35)} THEN v5.credit ELSE normal END, 6) AS score FROM v5 JOIN cs USING (query_id)""".replace("sizes AS (", "clipids AS (SELECT q.vec_id AS query_id, s.step, f.vec_id FROM qu q CROSS JOIN steps s JOIN fr f ON f.media_id = q.media_id AND f.frame_no = q.frame_no + s.step),\nsizes AS (", 1))
def v3_by_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode score in the mode that the texts of the clip's frames call for."""
    fr = frames(spark, sf_dir)
    clip = clip_frames(fr).select("query_id", F.col("vec_id").alias("doc_id"))
    known = credit_scores(spark, sf_dir, clip.select("doc_id").distinct(), credit_score_thirds)
    sizes = clip.join(known, "doc_id", "left").groupBy("query_id").agg(F.count("*").alias("clip_frames"), F.coalesce(F.max("credit"), F.lit(0.0)).alias("credit_score"))
    return scoring.episode_scores(with_ocr(clip_hits(fr), spark, sf_dir), sizes).select(*KEY, "credit", six("score"))


@query(f"""WITH {CLIP_SQL}, {TOKENS_SQL},
  ids AS (SELECT q.vec_id AS query_id, f.vec_id FROM qu q CROSS JOIN steps s JOIN fr f ON f.media_id = q.media_id AND f.frame_no = q.frame_no + s.step),
  ca AS (SELECT DISTINCT query_id, media_id, season, episode, vec_id FROM chits),
  ps AS (SELECT c.query_id, c.media_id, c.season, c.episode, c.vec_id, max({JACCARD_SQL}) AS s FROM ca c JOIN tk b ON b.doc_id = c.vec_id AND b.text <> '' JOIN ids i ON i.query_id = c.query_id JOIN tk a ON a.doc_id = i.vec_id AND a.text <> '' GROUP BY ALL),
  rs AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY s DESC, vec_id) AS r FROM ps),
  sc AS (SELECT query_id, media_id, season, episode, avg(s) FILTER (r <= 3) AS score, count(*) AS n FROM rs GROUP BY query_id, media_id, season, episode),
  ks AS (SELECT DISTINCT query_id, media_id, season, episode FROM ca)
  SELECT k.query_id, k.media_id, k.season, k.episode, round(coalesce(score, 0), 6) AS ocr_score, coalesce(n, 0) AS frames_with_text
  FROM ks k LEFT JOIN sc s ON k.query_id = s.query_id AND k.media_id = s.media_id AND k.season IS NOT DISTINCT FROM s.season AND k.episode IS NOT DISTINCT FROM s.episode""")
def clip_ocr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all of a clip's frames against those of an episode's candidates."""
    fr = frames(spark, sf_dir)
    found, clip = clip_hits(fr), clip_frames(fr).select("query_id", F.col("vec_id").alias("doc_id"))
    asked = clip.select("doc_id").union(found.select(F.col("vec_id").alias("doc_id"))).distinct()
    t = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text <> ''").select("doc_id", "text").join(asked, "doc_id", "left_semi").select("doc_id", token_set("text").alias("tokens"))
    texts = clip.join(t, "doc_id").select("query_id", F.col("tokens").alias("query_tokens"))
    return scoring.clip_ocr_scores(found, texts, t.withColumnRenamed("doc_id", "vec_id")).select(*KEY, six("ocr_score"), "frames_with_text")


@query(f"WITH {CLIP_SQL} SELECT query_id, vec_id, round(max(sim), 6) AS sim FROM chits GROUP BY query_id, vec_id")
def dedup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.deduplicated(clip_hits(frames(spark, sf_dir))).select("query_id", "vec_id", six("sim"))


#: The halves of a vector are a query's and a candidate's sequence.
WINDOWS_SQL = f"""
w AS (SELECT vec_id, CAST(embedding[1:len(embedding) // 2] AS DOUBLE[]) AS q, CAST(embedding[len(embedding) // 2 + 1:2 * (len(embedding) // 2)] AS DOUBLE[]) AS c, len(embedding) // 2 AS n FROM embeddings),
s AS (SELECT vec_id, n, list_avg(c) AS mean, list_min(c) AS least, list_stddev_pop(c) AS dev,
        list_transform(range(1, n), lambda i: CASE WHEN abs(q[i + 1] - q[i]) < {d(0.01)} THEN 0 ELSE sign(q[i + 1] - q[i]) END) AS a,
        list_transform(range(1, n), lambda i: CASE WHEN abs(c[i + 1] - c[i]) < {d(0.01)} THEN 0 ELSE sign(c[i + 1] - c[i]) END) AS b FROM w),
o AS (SELECT *, len(list_filter(range(1, n), lambda i: a[i] = b[i])) / CAST(n - 1 AS DOUBLE) AS ordering, greatest({d(0)}, 1 - least(dev / {d(0.2)}, {d(1)})) AS consistency FROM s)"""


@query(f"WITH {WINDOWS_SQL} SELECT vec_id, round({d(0.4)} * mean + {d(0.2)} * least + {d(0.2)} * consistency + {d(0.2)} * ordering, 6) AS score, round(ordering, 6) AS ordering, round(consistency, 6) AS consistency FROM o")
def sequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = F.floor(F.size("embedding") / 2).cast("int")
    part = lambda at: F.transform(F.slice("embedding", at, n), lambda x: x.cast("double"))
    rows = e.select("vec_id", part(F.lit(1)).alias("q"), part(n + 1).alias("c"))
    return rows.select("vec_id", F.round(seq.sequence_score(F.col("q"), F.col("c")), 6).alias("score"), F.round(seq.ordering(F.col("q"), F.col("c")), 6).alias("ordering"), F.round(seq.consistency(F.col("c")), 6).alias("consistency"))


@query(f"WITH {HITS_SQL}, m AS (SELECT query_id, vec_id, sim, min(sim) OVER (PARTITION BY query_id) AS lo, max(sim) OVER (PARTITION BY query_id) AS hi FROM hits) SELECT query_id, vec_id, round(CASE WHEN hi - lo < {d(1e-8)} THEN 1 ELSE (sim - lo) / (hi - lo) END, 6) AS scaled FROM m")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(frames(spark, sf_dir)).select("query_id", "vec_id", F.round(seq.min_max(F.col("sim"), ["query_id"]), 6).alias("scaled"))


GROUPS_SQL = CLIP_SQL + f""",
nu AS (SELECT *, dense_rank() OVER (ORDER BY query_id, media_id, season NULLS FIRST, episode NULLS FIRST) AS k,
         row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY step, rank, vec_id) AS n FROM chits),
gr AS (SELECT k, n, [ts] AS times, CAST(1 AS BIGINT) AS which FROM nu WHERE n = 1
       UNION ALL
       SELECT k, n, CASE WHEN pos > 0 THEN times ELSE list_append(times, ts) END, CASE WHEN pos > 0 THEN pos ELSE len(times) + 1 END
       FROM (SELECT nu.k, nu.n, nu.ts, gr.times, CAST(coalesce(list_position(list_transform(gr.times, lambda t: abs(t - nu.ts) <= 6), true), 0) AS BIGINT) AS pos FROM gr JOIN nu ON nu.k = gr.k AND nu.n = gr.n + 1)),
al AS (SELECT nu.*, gr.which, list_extract(ls.times, gr.which) AS group_time FROM nu JOIN gr ON nu.k = gr.k AND nu.n = gr.n
       JOIN (SELECT k, arg_max(times, n) AS times FROM gr GROUP BY k) ls ON ls.k = nu.k)"""


@query(f"WITH RECURSIVE {GROUPS_SQL} SELECT query_id, media_id, season, episode, step, vec_id, CAST(which AS INTEGER) AS which, group_time FROM al")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.greedy_groups(clip_hits(frames(spark, sf_dir))).select(*KEY, "step", "vec_id", "which", "group_time")


SEQUENCE_SQL = f"""{GROUPS_SQL},
bs AS (SELECT k, which, step, max(sim) AS sim FROM al GROUP BY k, which, step),
ca AS (SELECT k, which, list_transform([-2, -1, 0, 1, 2], lambda i: coalesce(map_extract_value(m, i), {d(0)})) AS c, m FROM (SELECT k, which, map_from_entries(list((CAST(step AS INTEGER), sim))) AS m FROM bs GROUP BY k, which)),
qm AS (SELECT query_id, list_transform([-2, -1, 0, 1, 2], lambda i: coalesce(map_extract_value(m, i), {d(0)})) AS q FROM (SELECT query_id, map_from_entries(list((CAST(step AS INTEGER), sim))) AS m FROM (SELECT query_id, step, max(sim) AS sim FROM chits GROUP BY query_id, step) GROUP BY query_id)),
ke AS (SELECT DISTINCT k, query_id, media_id, season, episode FROM nu),
sg AS (SELECT ca.*, q, list_transform(range(1, 5), lambda i: CASE WHEN abs(c[i + 1] - c[i]) < {d(0.01)} THEN 0 ELSE sign(c[i + 1] - c[i]) END) AS a,
         list_transform(range(1, 5), lambda i: CASE WHEN abs(q[i + 1] - q[i]) < {d(0.01)} THEN 0 ELSE sign(q[i + 1] - q[i]) END) AS b FROM ca JOIN ke USING (k) JOIN qm USING (query_id)),
sq AS (SELECT k, {d(0.4)} * list_avg(c) + {d(0.2)} * list_min(c) + {d(0.2)} * greatest({d(0)}, 1 - least(list_stddev_pop(c) / {d(0.2)}, {d(1)})) + {d(0.2)} * len(list_filter(range(1, 5), lambda i: a[i] = b[i])) / {d(4)} AS s FROM sg),
be AS (SELECT k, max(s) AS s FROM sq GROUP BY k),
ba AS (SELECT k, {d(0.5)} * max(sim) + {d(0.3)} * avg(sim) FILTER (r <= 3) + {d(0.2)} * avg(sim) AS base FROM nu GROUP BY k)"""


@query(f"WITH RECURSIVE {SEQUENCE_SQL} SELECT query_id, media_id, season, episode, round(base, 6) AS score, round(s, 6) AS sequence, round({d(0.75)} * base + {d(0.25)} * s, 6) AS final FROM ke JOIN be USING (k) JOIN ba USING (k)")
def sequence_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.sequence_rerank(clip_hits(frames(spark, sf_dir)), STEPS).select(*KEY, six("score"), F.round("other_sequence", 6).alias("sequence"), six("final"))


def _printed(fr: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each query's clip frames with the episodes among its hits, and fingerprints."""
    asked = clip_frames(fr).select("query_id", "step", normalize("embedding").alias("embedding")).join(found.select(*KEY).distinct(), "query_id")
    return asked, fp.fingerprints(fr)


PRINTED_SQL = CLIP_SQL + f""",
g AS (SELECT media_id, unnest(range(0, CAST(floor((max(ts) + {d(0.1)}) / 30) AS BIGINT) + 1)) * {d(30)} AS target_time FROM fr GROUP BY media_id),
fp AS (SELECT g.media_id, g.target_time, arg_min(f.vec_id, (abs(f.ts - g.target_time), f.ts, f.vec_id)) AS vec_id FROM g JOIN fr f ON g.media_id = f.media_id GROUP BY g.media_id, g.target_time),
wn AS (SELECT DISTINCT query_id, media_id, season, episode FROM chits),
nm AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM fr),
cn AS (SELECT query_id, step, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM clip),
mt AS (SELECT w.query_id, w.media_id, w.season, w.episode, c.step, p.vec_id, p.target_time, list_dot_product(c.u, n.u) AS sim
       FROM wn w JOIN cn c USING (query_id) JOIN fp p ON p.media_id = w.media_id JOIN nm n ON n.vec_id = p.vec_id),
lo AS (SELECT *, {d(0.6)} * max(sim) OVER a + {d(0.25)} * avg(sim) OVER a + {d(0.15)} * avg(CASE WHEN sim >= {d(0.7)} THEN {d(1)} ELSE {d(0)} END) OVER a AS local
       FROM mt WINDOW a AS (PARTITION BY query_id, media_id, season, episode, step ORDER BY target_time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query(f"WITH {PRINTED_SQL} SELECT query_id, media_id, season, episode, step, vec_id, round(sim, 6) AS sim, round(local, 6) AS local FROM lo")
def fingerprint_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return fp.local_scores(*_printed(fr, clip_hits(fr))).select(*KEY, "step", "vec_id", six("sim"), six("local"))


EPISODE_FP_SQL = PRINTED_SQL + f""",
be AS (SELECT query_id, media_id, season, episode, step, max(sim) AS sim, arg_max(local, (sim, -target_time)) AS local, arg_max(target_time, (sim, -target_time)) AS target_time FROM lo GROUP BY query_id, media_id, season, episode, step),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, step) AS r FROM be),
fs AS (SELECT query_id, media_id, season, episode, {d(0.35)} * max(sim) + {d(0.25)} * avg(sim) FILTER (r <= 3) + {d(0.15)} * avg(sim) + {d(0.15)} * max(local) + {d(0.1)} * avg(local) AS score, arg_max(target_time, (local, -step)) AS time FROM br GROUP BY query_id, media_id, season, episode)"""


@query(f"WITH {EPISODE_FP_SQL} SELECT query_id, media_id, season, episode, round(score, 6) AS score, time FROM fs")
def fingerprint_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    return fp.fingerprint_scores(*_printed(fr, clip_hits(fr))).select(*KEY, six("score"), "time")


@query(f"""WITH {EPISODE_FP_SQL}, vs AS (SELECT query_id, media_id, season, episode, {d(0.5)} * max(sim) + {d(0.3)} * avg(sim) FILTER (r <= 3) + {d(0.2)} * count(DISTINCT step) / any_value(clip_frames) AS visual FROM chits JOIN sizes USING (query_id) GROUP BY query_id, media_id, season, episode)
  SELECT v.query_id, v.media_id, v.season, v.episode, round({d(0.8)} * visual + {d(0.2)} * coalesce(f.score, 0), 6) AS fused FROM vs v LEFT JOIN fs f ON v.query_id = f.query_id AND v.media_id = f.media_id AND v.season IS NOT DISTINCT FROM f.season AND v.episode IS NOT DISTINCT FROM f.episode""")
def fingerprint_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    found = clip_hits(fr)
    prints = fp.fingerprint_scores(*_printed(fr, found)).withColumnRenamed("score", "fingerprint")
    return scoring.fused(scoring.video_scores(found, clip_sizes(fr)), prints, "fingerprint", 0.80).select(*KEY, six("fused"))


@query(f"""{V3_SQL.replace(CLIP_SQL, 'WITH ' + EPISODE_FP_SQL, 1).replace('pc AS (', 'pcx AS (').replace('JOIN pc ON h.query_id = pc.query_id AND h.media_id = pc.media_id AND h.season IS NOT DISTINCT FROM pc.season AND h.episode IS NOT DISTINCT FROM pc.episode WHERE h.sim >= pc.p', 'JOIN pcx pc ON h.query_id = pc.query_id AND h.media_id = pc.media_id AND h.season IS NOT DISTINCT FROM pc.season AND h.episode IS NOT DISTINCT FROM pc.episode WHERE h.sim >= pc.p')}
  SELECT v.query_id, v.media_id, v.season, v.episode, round({d(0.8)} * normal + {d(0.2)} * coalesce(f.score, 0), 6) AS fused FROM v5 v LEFT JOIN fs f ON v.query_id = f.query_id AND v.media_id = f.media_id AND v.season IS NOT DISTINCT FROM f.season AND v.episode IS NOT DISTINCT FROM f.episode""")
def v3_fingerprint_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode score with the fingerprints' beside it."""
    fr = frames(spark, sf_dir)
    found = clip_hits(fr)
    prints = fp.fingerprint_scores(*_printed(fr, found)).withColumnRenamed("score", "fingerprint")
    scores = scoring.episode_scores(with_ocr(found, spark, sf_dir), clip_sizes(fr), credit=F.lit(False))
    return scoring.fused(scores, prints, "fingerprint", 0.80).select(*KEY, six("fused"))


@query()
def kmeans_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.prototypes(frames(spark, sf_dir)).select("media_id", "season", "episode", "prototype_index", "cluster_size")


PROTOTYPE_SQL = CLIP_SQL + f""",
pt AS (SELECT media_id, season, episode, v FROM fr),
pb AS (SELECT c.query_id, p.media_id, p.season, p.episode, c.step, max(list_dot_product(c.v, p.v)) AS sim FROM clip c CROSS JOIN pt p GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, step) AS r FROM pb)"""


@query(f"WITH {PROTOTYPE_SQL} SELECT query_id, media_id, season, episode, round({d(0.35)} * max(sim) + {d(0.35)} * avg(sim) FILTER (r <= 3) + {d(0.2)} * avg(sim) + {d(0.1)} * avg(CASE WHEN sim >= {d(0.7)} THEN {d(1)} ELSE {d(0)} END), 6) AS score FROM pr GROUP BY query_id, media_id, season, episode")
def prototype_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame stands for a prototype of its own, so that the score doesn't depend on a clustering."""
    fr = frames(spark, sf_dir)
    prints = fr.select("media_id", "season", "episode", "embedding")
    return fp.prototype_scores(clip_frames(fr), prints).select(*KEY, six("score"))


FROZEN_SQL = CLIP_SQL + f""",
dm AS (SELECT media_id, season, episode, frame_no % 8 AS g, i, avg(v[i]) AS x FROM fr, (SELECT CAST(unnest(range(1, 65)) AS BIGINT) AS i) GROUP BY ALL),
ce AS (SELECT media_id, season, episode, g, list(x ORDER BY i) AS x FROM dm GROUP BY ALL),
pt AS (SELECT media_id, season, episode, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS v FROM ce),
pb AS (SELECT c.query_id, p.media_id, p.season, p.episode, c.step, max(list_dot_product(c.v, p.v)) AS sim FROM clip c CROSS JOIN pt p GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, step) AS r FROM pb)"""


@query(f"WITH {FROZEN_SQL} SELECT query_id, media_id, season, episode, round({d(0.35)} * max(sim) + {d(0.35)} * avg(sim) FILTER (r <= 3) + {d(0.2)} * avg(sim) + {d(0.1)} * avg(CASE WHEN sim >= {d(0.7)} THEN {d(1)} ELSE {d(0)} END), 6) AS score FROM pr GROUP BY query_id, media_id, season, episode")
def prototype_score_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight unit centroids an episode, of a grouping that doesn't hang on a random start: frames by their number."""
    fr = frames(spark, sf_dir)
    each = fr.select(*KEY[1:], (F.col("frame_no") % 8).alias("g"), F.posexplode("embedding").alias("i", "x")).groupBy(*KEY[1:], "g", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = each.groupBy(*KEY[1:], "g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return fp.prototype_scores(clip_frames(fr), centroids.select(*KEY[1:], normalize("v").alias("embedding"))).select(*KEY, six("score"))


METRIC_SQL = IMAGE_SQL + """,
tr AS (SELECT q.vec_id AS query_id, min(p.position) AS truth_rank FROM qu q LEFT JOIN po p ON p.query_id = q.vec_id AND p.media_id = q.media_id AND p.season IS NOT DISTINCT FROM q.season AND p.episode IS NOT DISTINCT FROM q.episode GROUP BY q.vec_id)"""


def truth_ranks(fr: DataFrame) -> DataFrame:
    truth = queries(fr).select(F.col("vec_id").alias("query_id"), "media_id", "season", "episode")
    return metrics.truth_ranks(truth, scoring.order_episodes(scoring.image_scores(hits(fr)), None), ["media_id", "season", "episode"])


@query(f"WITH {METRIC_SQL} SELECT query_id, truth_rank FROM tr")
def truth_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth_ranks(frames(spark, sf_dir))


@query(f"""WITH {METRIC_SQL} SELECT count(*) AS queries, round(avg(CASE WHEN truth_rank <= 1 THEN {d(1)} ELSE {d(0)} END), 6) AS top1, round(avg(CASE WHEN truth_rank <= 3 THEN {d(1)} ELSE {d(0)} END), 6) AS top3,
  round(avg(CASE WHEN truth_rank <= 5 THEN {d(1)} ELSE {d(0)} END), 6) AS top5, round(avg(coalesce({d(1)} / truth_rank, 0)), 6) AS mrr FROM tr""")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(truth_ranks(frames(spark, sf_dir))).select("queries", *(six(c) for c in ("top1", "top3", "top5", "mrr")))


@query(f"""WITH {IMAGE_SQL}, er AS (SELECT q.vec_id AS query_id, abs(h.ts - q.ts) AS err_correct FROM qu q JOIN (SELECT query_id, media_id, arg_max(ts, (sim, -vec_id)) AS ts FROM hits GROUP BY ALL) h ON h.query_id = q.vec_id AND h.media_id = q.media_id),
  ep AS (SELECT q.vec_id AS query_id, abs(f.ts - q.ts) AS err_predicted FROM qu q JOIN po p ON p.query_id = q.vec_id AND p.position = 1 JOIN fr f ON f.vec_id = p.best_vec)
  SELECT round(avg(err_correct), 6) AS mean_correct, round(median(err_correct), 6) AS median_correct, round(avg(err_predicted), 6) AS mean_predicted, round(median(err_predicted), 6) AS median_predicted FROM ep LEFT JOIN er USING (query_id)""")
def timestamp_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the best hit in the right episode where there is one, and by that of the predicted episode."""
    fr = frames(spark, sf_dir)
    h = hits(fr)
    own = queries(fr).select(F.col("vec_id").alias("query_id"), F.col("media_id").alias("_m"), F.col("ts").alias("_t"))
    right = h.join(own, (h["query_id"] == own["query_id"]) & (h["media_id"] == own["_m"])).groupBy(own["query_id"], "_t").agg(F.max_by("ts", F.struct("sim", -F.col("vec_id"))).alias("ts")).select("query_id", F.abs(F.col("ts") - F.col("_t")).alias("err_correct"))
    first = scoring.order_episodes(scoring.image_scores(h), 1).join(own, "query_id").select("query_id", F.abs(F.col("best_frame.ts") - F.col("_t")).alias("err_predicted"))
    return first.join(right, "query_id", "left").agg(F.round(F.avg("err_correct"), 6).alias("mean_correct"), F.round(F.median("err_correct"), 6).alias("median_correct"), F.round(F.avg("err_predicted"), 6).alias("mean_predicted"), F.round(F.median("err_predicted"), 6).alias("median_predicted"))


@query(f"WITH {HITS_SQL} SELECT f.query_id, f.media_id, f.season, f.episode, count(*) AS n FROM hits f SEMI JOIN (SELECT vec_id AS query_id, media_id FROM qu) q ON f.query_id = q.query_id AND f.media_id = q.media_id GROUP BY ALL")
def semi_join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir)
    own = queries(fr).select(F.col("vec_id").alias("query_id"), "media_id")
    return hits(fr).join(own, ["query_id", "media_id"], "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"))


@query(f"WITH {FRAMES_SQL} SELECT vec_id, media_id, ts FROM fr WHERE media_id = 'media_03' AND abs(ts - 40) <= 10")
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.within_radius(frames(spark, sf_dir), F.lit("media_03"), F.lit(40.0), 10.0).select("vec_id", "media_id", "ts")


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT q.vec_id AS query_id, a.vec_id AS our_id, b.vec_id, b.media_id, list_dot_product(a.v, b.v) AS sim FROM qu q JOIN fr a ON a.media_id = q.media_id AND abs(a.ts - q.ts) <= 6 JOIN fr b ON b.media_id <> q.media_id AND abs(b.ts - q.ts) <= 10)
  SELECT query_id, media_id, round(max(sim), 6) AS best, count(*) AS pairs FROM p GROUP BY query_id, media_id""")
def same_time_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other items show around the query's time, against what the query's item shows there."""
    fr = frames(spark, sf_dir)
    q = queries(fr).select(F.col("vec_id").alias("query_id"), F.col("media_id").alias("_m"), F.col("ts").alias("t"))
    timed = fr.select("media_id", F.col("ts").alias("start"), F.col("ts").alias("end"), "vec_id", "embedding")
    ours = temporal.overlapping(q.withColumn("media_id", F.col("_m")), timed, 6.0, longest=0.0).groupBy("query_id", "_m", "t").agg(F.collect_list("embedding").alias("ours"))
    return beside(ours, fr, 10.0).select("query_id", "media_id", six("best"), "pairs")
