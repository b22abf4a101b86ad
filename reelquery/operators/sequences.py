"""Similarity sequences of clips: scores, greedy grouping in time, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelquery import weights as W
from reelquery.operators.scoring import KEY, fused, ranked, top_mean


def consistency(values: Column, deviation: float = 0.20) -> Column:
    """1 for equal values, falling to 0 as their deviation reaches ``deviation``; 0 for fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(n > 1, F.greatest(F.lit(0.0), 1 - F.least(F.sqrt(var) / deviation, F.lit(1.0)))).otherwise(0.0)


def directions(values: Column, dead_band: float = 0.01) -> Column:
    """Signs of consecutive differences; changes below the dead band are none."""
    ahead = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.zip_with(F.slice(values, F.lit(1), F.size(ahead)), ahead, lambda a, b: F.when(F.abs(b - a) < dead_band, 0).when(b > a, 1).otherwise(-1))


def ordering(a: Column, b: Column, dead_band: float = 0.01) -> Column:
    """Share of steps in which both sequences move alike; 0 for fewer than three values."""
    same = F.zip_with(directions(a, dead_band), directions(b, dead_band), lambda x, y: (x == y).cast("int"))
    total = F.aggregate(same, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) >= 3, total / (F.size(a) - 1)).otherwise(0.0)


def sequence_score(query: Column, candidate: Column, w: W.Sequence = W.Sequence()) -> Column:
    """Score of a candidate's similarities against the query's, both cut to the shorter; 0 if one is empty."""
    n = F.least(F.size(query), F.size(candidate))
    q, c = (F.transform(F.slice(x, F.lit(1), n), lambda v: v.cast("double")) for x in (query, candidate))
    mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
    total = w.mean * mean + w.least * F.array_min(c) + w.consistency * consistency(c, w.deviation) + w.ordering * ordering(q, c, w.dead_band)
    return F.when(n > 0, total).otherwise(0.0)


def min_max(value: Column, by: list[str]) -> Column:
    """A column scaled to 0..1 within its group; 1 where the group hardly varies."""
    group = Window.partitionBy(*by)
    lo, hi = F.min(value).over(group), F.max(value).over(group)
    return F.when(hi - lo < 1e-8, 1.0).otherwise((value - lo) / (hi - lo))


def greedy_groups(hits: DataFrame, seconds: float = 6.0, by: list[str] = KEY) -> DataFrame:
    """by, group_time, members: in order of arrival (step, rank), a hit joins the first group whose first hit
    is at most ``seconds`` away, or opens one. A clip's hits in one episode bound the fold."""
    hit = F.struct("step", "rank", "vec_id", F.col("ts").cast("double").alias("ts"), "sim")
    rows = hits.groupBy(*by).agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    start = F.struct(F.array().cast("array<double>").alias("times"), F.array().cast("array<int>").alias("which"))

    def step(acc: Column, h: Column) -> Column:
        found = F.array_position(F.transform(acc["times"], lambda t: F.abs(t - h["ts"]) <= seconds), True).cast("int")
        times = F.when(found > 0, acc["times"]).otherwise(F.concat(acc["times"], F.array(h["ts"])))
        at = F.when(found > 0, found).otherwise(F.size(acc["times"]) + 1)
        return F.struct(times.alias("times"), F.concat(acc["which"], F.array(at)).alias("which"))

    folded = rows.withColumn("f", F.aggregate("hits", start, step))
    each = folded.select(*by, "f.times", F.explode(F.arrays_zip("hits", F.col("f.which").alias("which"))).alias("e"))
    return each.select(*by, "e.which", F.element_at("times", F.col("e.which")).alias("group_time"), "e.hits.*")


def sequences(hits: DataFrame, steps: list[int], seconds: float = 6.0) -> DataFrame:
    """KEY, which, group_time, similarities (one for each step, 0 where the group has none), coverage."""
    best = greedy_groups(hits, seconds).groupBy(*KEY, "which", "group_time", "step").agg(F.max("sim").alias("sim"))
    per = best.groupBy(*KEY, "which", "group_time").agg(F.map_from_entries(F.collect_list(F.struct("step", "sim"))).alias("m"))
    values = F.array(*(F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0.0)) for s in steps))
    return per.select(*KEY, "which", "group_time", values.alias("similarities"), (F.size("m") / len(steps)).alias("coverage"))


def sequence_rerank(hits: DataFrame, steps: list[int], w: W.SequenceRerank = W.SequenceRerank(), query: DataFrame | None = None) -> DataFrame:
    """Episodes by a base score of their hits and their best sequence. ``query``: query_id, query_similarities;
    by default each clip frame's best similarity anywhere."""
    if query is None:
        best = hits.groupBy("query_id", "step").agg(F.max("sim").alias("sim")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "sim"))).alias("m"))
        query = best.select("query_id", F.array(*(F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0.0)) for s in steps)).alias("query_similarities"))
    scored = sequences(hits, steps, w.group_seconds).join(query, "query_id").withColumn("sequence", sequence_score(F.col("query_similarities"), F.col("similarities")))
    best = scored.groupBy(*KEY).agg(F.max_by(F.struct("sequence", "coverage", "group_time"), F.struct("sequence", -F.col("which"))).alias("b")).select(*KEY, "b.*")
    rows = ranked(hits.withColumn("_tie", F.struct("vec_id", "step")), tie="_tie").groupBy(*KEY).agg(F.max("sim").alias("best"), top_mean(3).alias("top3"), F.avg("sim").alias("mean"))
    rows = rows.withColumn("score", w.best * F.col("best") + w.top3 * F.col("top3") + w.mean * F.col("mean"))
    return fused(rows, best, "sequence", w.base, "final")
