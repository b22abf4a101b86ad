"""Evidence of episodes: grouped, ranked, weighted.

Evidence is a table of query_id, media_id, season, episode, vec_id, sim and what a score needs besides.
Season and episode may be null, and null keys are equal, as grouping has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelquery import weights as W
from reelquery.functions.text import jaccard
from reelquery.operators.temporal import count_ahead
from reelquery.schemas import EPISODE

KEY = ["query_id", *EPISODE]


def ranked(rows: DataFrame, by: list[str] = KEY, score: str = "sim", tie: str = "vec_id", name: str = "_r") -> DataFrame:
    """``rows`` numbered within a group, best first."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def top_mean(k: int, score: str = "sim", rank: str = "_r") -> Column:
    """Mean of a ranked group's first k."""
    return F.avg(F.when(F.col(rank) <= k, F.col(score)))


def best_row(score: str = "sim", *fields: str) -> Column:
    """The fields of a group's best row, the smaller vec_id among equals."""
    return F.max_by(F.struct(*fields), F.struct(F.col(score), -F.col("vec_id")))


def order_episodes(scores: DataFrame, k: int | None = 5, score: str = "score") -> DataFrame:
    """Episodes of a query by score; ties by media, season and episode, nulls first."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), *(F.asc_nulls_first(c) for c in EPISODE))
    out = scores.withColumn("position", F.row_number().over(best))
    return out if k is None else out.filter(F.col("position") <= k)


def image_scores(hits: DataFrame, w: W.Image = W.Image()) -> DataFrame:
    parts = ranked(hits).groupBy(*KEY).agg(F.max("sim").alias("best"), top_mean(3).alias("top3"), top_mean(5).alias("top5"), F.count("*").alias("evidence"), best_row("sim", "vec_id", "ts").alias("best_frame"))
    return parts.withColumn("score", F.lit(w.best) * F.col("best") + F.lit(w.top3) * F.col("top3") + F.lit(w.top5) * F.col("top5"))


def video_scores(hits: DataFrame, clip_sizes: DataFrame, w: W.Video = W.Video()) -> DataFrame:
    """``hits`` has step, the clip frame that found it; ``clip_sizes``: query_id, clip_frames. best_frame is the episode's best
    hit, whose time is the first guess of the clip's."""
    parts = ranked(hits, tie="_tie") if "_tie" in hits.columns else ranked(hits.withColumn("_tie", F.struct("vec_id", "step")), tie="_tie")
    parts = parts.groupBy(*KEY).agg(F.max("sim").alias("best"), top_mean(3).alias("top3"), F.count_distinct("step").alias("found"), F.count("*").alias("evidence"), best_row("sim", "vec_id", "ts").alias("best_frame"))
    parts = parts.join(clip_sizes, "query_id").withColumn("coverage", F.col("found") / F.col("clip_frames"))
    return parts.withColumn("score", F.lit(w.best) * F.col("best") + F.lit(w.top3) * F.col("top3") + F.lit(w.coverage) * F.col("coverage"))


def clip_scores(hits: DataFrame, clip_sizes: DataFrame, w: W.Clip = W.Clip()) -> DataFrame:
    """From each clip frame's best hit in an episode; a hit's rank discounts it by 1 / log2(rank + 1)."""
    per = hits.groupBy(*KEY, "step").agg(F.max("sim").alias("sim"), F.max(F.col("sim") / F.log2(F.col("rank") + 1)).alias("_disc"))
    parts = ranked(per, tie="step").groupBy(*KEY).agg(top_mean(3).alias("top3"), F.avg("sim").alias("mean"), F.count("*").alias("found"), F.max("_disc").alias("rank_score"))
    parts = parts.join(clip_sizes, "query_id").withColumn("coverage", F.col("found") / F.col("clip_frames"))
    return parts.withColumn("score", F.lit(w.top3) * F.col("top3") + F.lit(w.mean) * F.col("mean") + F.lit(w.coverage) * F.col("coverage") + F.lit(w.rank) * F.col("rank_score"))


def clip_scores_plain(hits: DataFrame, clip_sizes: DataFrame, w: W.Clip = W.Clip()) -> DataFrame:
    """The variant beside recognised text: over all hits, with the mean in the rank's place as well."""
    parts = ranked(hits.withColumn("_tie", F.struct("vec_id", "step")), tie="_tie").groupBy(*KEY).agg(top_mean(3).alias("top3"), F.avg("sim").alias("mean"), F.count_distinct("step").alias("found"))
    parts = parts.join(clip_sizes, "query_id").withColumn("coverage", F.col("found") / F.col("clip_frames"))
    return parts.withColumn("score", F.lit(w.top3) * F.col("top3") + F.lit(w.mean) * F.col("mean") + F.lit(w.coverage) * F.col("coverage") + F.lit(w.rank) * F.col("mean"))


def temporal_medians(pairs: DataFrame) -> DataFrame:
    """query_id, vec_id, temporal: the median of aligned neighbours' products, 0 without any. ``pairs``:
    query_id, vec_id, product."""
    return pairs.groupBy("query_id", "vec_id").agg(F.coalesce(F.median("product"), F.lit(0.0)).alias("temporal"))


def combined(frame: Column, temporal: Column) -> Column:
    return F.lit(0.40) * frame + F.lit(0.60) * temporal


def rerank_scores(hits: DataFrame, w: W.Rerank = W.Rerank()) -> DataFrame:
    """``hits`` has temporal; only positive ones count."""
    rows = ranked(hits).withColumn("_t", F.when(F.col("temporal") > 0, F.col("temporal")))
    rows = rows.withColumn("_rt", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("_t"), "vec_id")))
    parts = rows.groupBy(*KEY).agg(F.max("sim").alias("best"), top_mean(5).alias("top5"), F.coalesce(F.max("_t"), F.lit(0.0)).alias("temporal_best"), F.coalesce(F.avg(F.when(F.col("_rt") <= 5, F.col("_t"))), F.lit(0.0)).alias("temporal_top5"), F.count("*").alias("evidence"))
    support = F.least(F.col("evidence"), F.lit(w.support_full)) / w.support_full
    return parts.withColumn("score", F.lit(w.best) * F.col("best") + F.lit(w.top5) * F.col("top5") + F.lit(w.temporal_best) * F.col("temporal_best") + F.lit(w.temporal_top5) * F.col("temporal_top5") + F.lit(w.support) * support)


def strong_rows(hits: DataFrame, percentile: float = 0.60, by: list[str] = KEY) -> DataFrame:
    """The rows of each group at or above the percentile of its similarities (linear interpolation)."""
    bound = F.percentile("sim", percentile).over(Window.partitionBy(*by))
    return hits.withColumn("_p", bound).filter("sim >= _p").drop("_p")


def temporal_consistency(hits: DataFrame, w: W.Temporal = W.Temporal(), by: list[str] = KEY) -> DataFrame:
    """by, temporal: how densely a group's strong rows lie in time, and how little they spread; 0 for fewer than two."""
    strong = strong_rows(hits, w.percentile, by).withColumn("_n", count_ahead(by, "ts", w.cluster_seconds))
    return strong.groupBy(*by).agg(consistency(F.max("_n"), F.count("*"), F.percentile("ts", 0.75) - F.percentile("ts", 0.25), w).alias("temporal"))


def consistency(cluster: Column, n: Column, spread: Column, w: W.Temporal = W.Temporal()) -> Column:
    """From the most rows in a cluster, their number, and their interquartile range in time."""
    dense = F.least(F.lit(1.0), cluster / w.cluster_full)
    narrow = F.greatest(F.lit(0.0), 1 - spread / w.spread_seconds)
    return F.when(n < 2, 0.0).otherwise(w.cluster * dense + w.spread * narrow)


def episode_scores(hits: DataFrame, clip_sizes: DataFrame, w: W.Temporal = W.Temporal(), credit: Column | None = None) -> DataFrame:
    """The full episode score. ``hits`` has step, ts and ocr (0 to 1); ``credit``: whether the query is a credit
    scene (by default, whether ``clip_sizes`` says so in credit_score)."""
    # all windows and the sums are by the same key, so the hits are dealt once
    rows = ranked(hits.withColumn("_tie", F.struct("vec_id", "step")), tie="_tie")
    rows = rows.withColumn("_ro", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ocr"), "_tie")))
    rows = rows.withColumn("_strong", F.when(F.col("sim") >= F.percentile("sim", w.percentile).over(Window.partitionBy(*KEY)), F.col("ts").cast("double")))
    rows = rows.withColumn("_n", count_ahead(KEY, "ts", w.cluster_seconds, "_strong"))
    found = F.size(F.collect_set("step"))
    temporal = consistency(F.max(F.when(F.col("_strong").isNotNull(), F.col("_n"))), F.count("_strong"), F.percentile("_strong", 0.75) - F.percentile("_strong", 0.25), w)
    parts = rows.groupBy(*KEY).agg(F.max("sim").alias("best"), top_mean(3).alias("top3"), F.avg("sim").alias("mean"), found.alias("found"), F.avg("ocr").alias("ocr_mean"), F.max("ocr").alias("ocr_best"), top_mean(3, "ocr", "_ro").alias("ocr_top3"), best_row("sim", "vec_id", "ts").alias("best_frame"), temporal.alias("temporal"))
    joined = parts.join(clip_sizes, "query_id")
    coverage = F.least(F.lit(1.0), F.col("found") / F.greatest(F.col("clip_frames"), F.lit(1)))
    is_credit = credit if credit is not None else F.col("credit_score") >= w.threshold
    joined = joined.withColumns({"coverage": coverage, "credit": is_credit})
    total = lambda m: m.clip * F.col("best") + m.top3 * F.col("top3") + m.mean * F.col("mean") + m.coverage * F.col("coverage") + m.temporal * F.col("temporal") + m.ocr * F.col("ocr_top3")
    raised = total(w.credit) + F.when(F.col("ocr_best") >= 0.75, 0.08).when(F.col("ocr_best") >= 0.50, 0.04).otherwise(0.0)
    lowered = F.when(F.col("ocr_best") <= 0.01, raised * 0.92).otherwise(raised)
    return joined.withColumn("score", F.when(F.col("credit"), lowered).otherwise(total(w.normal)))


def fused(first: DataFrame, second: DataFrame, score: str, weight: float, name: str = "fused", by: list[str] = KEY, carry: tuple[str, ...] = ()) -> DataFrame:
    """``first`` with weight * score + (1 - weight) * the second table's ``score``, 0 where that has none, and the second's
    columns ``carry``. Keys with nulls match."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = first.alias("a").join(second.select(*by, score, *carry).alias("b"), cond, "left")
    return joined.select("a.*", *(f"b.{c}" for c in carry), F.coalesce(F.col(f"b.{score}"), F.lit(0.0)).alias(f"_{score}")).withColumn(name, F.lit(weight) * F.col("score") + F.lit(round(1 - weight, 10)) * F.col(f"_{score}")).withColumnRenamed(f"_{score}", f"other_{score}")


def clip_ocr_scores(hits: DataFrame, texts: DataFrame, candidates: DataFrame, by: list[str] = KEY) -> DataFrame:
    """by, ocr_score, frames_with_text: an episode's candidates by the most alike of the clip's texts, the best three
    on average; 0 where either has no text. ``texts``: query_id, query_tokens; ``candidates``: vec_id, tokens, of
    those with a text. What meets is a clip's few texts and the candidates that it found."""
    rows = hits.select(*by, "vec_id").distinct()
    pairs = rows.join(candidates, "vec_id").join(texts, "query_id").select(*by, "vec_id", jaccard("query_tokens", "tokens").alias("ocr"))
    best = ranked(pairs.groupBy(*by, "vec_id").agg(F.max("ocr").alias("ocr")), by, "ocr").groupBy(*by).agg(top_mean(3, "ocr").alias("score"), F.count("*").alias("n"))
    every = rows.select(*by).distinct()
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = every.alias("a").join(best.alias("b"), on, "left")
    return joined.select("a.*", F.coalesce("b.score", F.lit(0.0)).alias("ocr_score"), F.coalesce("b.n", F.lit(0)).alias("frames_with_text"))


def credit_aware(credit: Column) -> Column:
    """Candidate score of sim and ocr: in a credit scene text counts most, and a candidate without credits
    (candidate_credit below a quarter) or text loses a tenth."""
    strong = F.lit(0.30) * F.col("sim") + F.lit(0.70) * F.col("ocr")
    weak = (F.col("candidate_credit") < 0.25) | (F.coalesce(F.col("ocr_text"), F.lit("")) == "")
    return F.when(credit, F.when(weak, strong * 0.90).otherwise(strong)).otherwise(F.lit(0.80) * F.col("sim") + F.lit(0.20) * F.col("ocr"))


def deduplicated(hits: DataFrame, by: list[str] = ["query_id", "vec_id"]) -> DataFrame:  # noqa: B006
    """One row for each candidate of a query: its greatest similarity over the clip's frames."""
    rest = [c for c in hits.columns if c not in (*by, "sim", "step", "rank")]
    return hits.groupBy(*by).agg(F.max("sim").alias("sim"), *(F.any_value(c).alias(c) for c in rest))
