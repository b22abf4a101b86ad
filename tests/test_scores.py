"""Golden values, bounds and quirks of the scores."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reelquery.functions import formats as fm, text as tx
from reelquery.functions.vector import dot, norm, normalize
from reelquery.operators import metrics, scoring, sequences as seq, subtitles, temporal
from reelquery.operators.knn import nearest, nearest_native
from reelquery.streaming.clips import identify, identify_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def doubles(values):
    return F.array(*map(F.lit, values)).cast("array<double>")


QUERY = [0.82, 0.88, 0.94, 0.91, 0.86]


@pytest.mark.parametrize("candidate, want", [([0.80, 0.87, 0.93, 0.90, 0.85], (0.863728, 0.778641, 1.0)), ([0.60, 0.95, 0.72, 0.94, 0.61], (0.571899, 0.231495, 0.5))])
def test_sequence_score(spark, candidate, want):
    q, c = doubles(QUERY), doubles(candidate)
    got = spark.range(1).select(seq.sequence_score(q, c).alias("s"), seq.consistency(c).alias("c"), seq.ordering(q, c).alias("o")).first()
    assert [round(x, 6) for x in got] == list(want)


def test_sequence_score_of_short_and_empty(spark):
    assert one(spark, seq.sequence_score(doubles([0.5]), doubles([]))) == 0.0
    assert one(spark, seq.consistency(doubles([0.5]))) == 0.0
    assert one(spark, seq.ordering(doubles([0.1, 0.2]), doubles([0.1, 0.2]))) == 0.0


def evidence(spark, rows, extra=""):
    return spark.createDataFrame(rows, "query_id long, media_id string, season int, episode int, step int, rank int, vec_id long, ts double, sim double" + extra)


def test_sequence_rerank(spark):
    rows = [(1, "a", 1, 1, i, 1, i, 100.0 + 2 * i, s) for i, s in enumerate(QUERY)]
    rows += [(1, "b", 1, 2, i, 2, 10 + i, 200.0 + 2 * i, s) for i, s in enumerate([0.95, 0.60, 0.94, 0.61, 0.93])]
    hits = evidence(spark, rows)
    query = spark.createDataFrame([(1, QUERY)], "query_id long, query_similarities array<double>")
    got = {r["episode"]: r for r in seq.sequence_rerank(hits, [0, 1, 2, 3, 4], query=query).collect()}
    assert [round(got[1][c], 5) for c in ("score", "other_sequence", "final")] == [0.9194, 0.4840, 0.81055]
    assert [round(got[2][c], 5) for c in ("score", "other_sequence", "final")] == [0.9182, 0.3980, 0.78815]
    groups = seq.greedy_groups(hits).filter("episode = 1").groupBy("group_time").count().collect()
    assert {r["group_time"]: r["count"] for r in groups} == {100.0: 4, 108.0: 1}


@pytest.mark.parametrize("sims, times, ocr, credit, want", [([0.90, 0.88, 0.87], [100.0, 104.0, 108.0], [0.10, 0.05, 0.0], False, 0.7325), ([0.85, 0.84, 0.83], [500.0, 504.0, 508.0], [1.0, 0.9, 0.8], True, 0.7635)])
def test_episode_score(spark, sims, times, ocr, credit, want):
    rows = [(1, "a", None, None, i, 1, i, t, s, o) for i, (s, t, o) in enumerate(zip(sims, times, ocr))]
    sizes = spark.createDataFrame([(1, 5)], "query_id long, clip_frames long")
    got = scoring.episode_scores(evidence(spark, rows, ", ocr double"), sizes, credit=F.lit(credit)).first()
    assert round(got["temporal"], 9) == 0.0 and round(got["score"], 6) == want


@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(0, 500)), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None)
def test_consistency_is_bounded_and_ignores_order(spark, rows):
    a = [(1, "a", 1, 1, i, 1, i, t, s) for i, (s, t) in enumerate(rows)]
    got = [scoring.temporal_consistency(evidence(spark, x)).first()["temporal"] for x in (a, a[::-1])]
    assert got[0] == got[1] and 0 <= got[0] <= 1


def vectors(spark, n=60, width=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, width))
    rows = [(i, f"m{i % 3}", i % 3, i // 3 + 1, 2.0 * (i // 3), [float(v) for v in r / np.linalg.norm(r)]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, media_id string, episode int, frame_no int, ts double, embedding array<float>").withColumn("season", F.lit(None).cast("int"))


def test_both_searches_agree_and_grow_with_k(spark):
    fr = vectors(spark)
    q = fr.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("self_id"), "embedding")
    as_set = lambda df: {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}
    five, ten = as_set(nearest(fr, q, 5)), as_set(nearest(fr, q, 10))
    assert five < ten and as_set(nearest_native(fr, q, 10)) == ten
    assert all(a != b for a, b, _ in ten)
    assert as_set(nearest(fr, q, 10, block=4)) == ten  # blocks of queries meet parts of the frames


def test_search_without_frames_or_queries(spark):
    fr = vectors(spark)
    q = fr.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("self_id"), "embedding")
    assert nearest(fr, q.limit(0), 3).count() == 0 and nearest(fr.limit(0), q, 3).count() == 0
    nulls = fr.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")))
    assert {r["vec_id"] % 2 for r in nearest(nulls, q, 3).collect()} == {0}


def test_nearest_as_of_prefers_the_earlier(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", -1.0), ("a", 99.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 4.0, 9), ("a", 4.0, 3), ("a", 6.0, 1), ("a", 8.0, 2)], "k string, t double, i long")
    got = {(r["k"], r["t"]): (r["_near_time"], r["_near_id"]) for r in temporal.nearest_as_of(left, right, "k", "t", "t", "i").collect()}
    assert got == {("a", 5.0): (4.0, 3), ("a", -1.0): (4.0, 3), ("a", 99.0): (8.0, 2), ("b", 1.0): (None, None)}


@given(st.lists(st.tuples(st.floats(0, 60), st.floats(0, 9)), min_size=1, max_size=10), st.floats(0.5, 12))
@settings(max_examples=8, deadline=None)
def test_overlaps_meet_once(spark, spans, w):
    points = [(i, float(t)) for i, t in enumerate([0, 7.5, 31, 60])]
    p = spark.createDataFrame([("m", i, t) for i, t in points], "media_id string, p int, t double")
    e = spark.createDataFrame([("m", i, a, a + b) for i, (a, b) in enumerate(spans)], "media_id string, e int, start double, end double")
    got = sorted((r["p"], r["e"]) for r in temporal.overlapping(p, e, w).collect())
    assert got == sorted((i, j) for i, t in points for j, (a, b) in enumerate(spans) if a + b >= t - w and a <= t + w)


def test_text_similarities(spark):
    def s(a, b):
        return tx.with_similarity(tx.with_features(spark.range(1), a=F.lit(a), b=F.lit(b)), "a", "b", "s").first()["s"]

    assert s("a b", "a b") == 1.0 and s("", "a") == 0.0 and s("a", "a") == 1.0 and s(None, "a") == 0.0
    assert s("a b", "b a") == pytest.approx(0.7)
    from difflib import SequenceMatcher

    a, b = "the quick brown fox", "the brown quick fox"
    assert one(spark, tx.hybrid_similarity(F.lit(a), F.lit(b))) == pytest.approx(0.65 * SequenceMatcher(None, a, b).ratio() + 0.35)
    assert one(spark, tx.keyword_hits(F.lit("THE BROADCAST"))) == 1
    assert [round(one(spark, tx.credit_score_steps(F.lit(t))), 4) for t in ("", "MUSIC", "MUSIC STORY", "MUSIC STORY STARRING")] == [0.0, 0.5333, 0.7667, 1.0]
    assert one(spark, tx.normalize_lower(F.lit("A b  C!"))) == "a b c"
    assert one(spark, tx.normalize_markup(F.lit(None).cast("string"))) == ""


def test_formats(spark):
    assert one(spark, fm.clock_hundredths(F.lit(3661.255))) in ("01:01:01.25", "01:01:01.26")
    assert one(spark, fm.clock_millis(F.lit(59.5))) == "00:00:59.500"
    assert one(spark, fm.srt_seconds(F.lit("01:02:03,450"))) == 3723.45
    assert one(spark, fm.srt_seconds(F.lit("nothing"))) is None
    assert one(spark, fm.rational(F.lit("24000/1001"))) == pytest.approx(23.976, abs=1e-3)
    assert one(spark, fm.rational(F.lit("5/0"))) == 0.0
    assert one(spark, fm.media_id(F.lit("The Show!"), F.lit(1), F.lit(2))) == "the_show_s01e02"
    assert one(spark, fm.linspace(F.lit(0.0), F.lit(2.0), 1)) == [1.0]
    assert one(spark, temporal.clip_times(F.lit(10.0), 3)) == pytest.approx([0.0, 1.475, 2.95])
    assert one(spark, norm(doubles([3, 4]))) == 5.0 and one(spark, dot(doubles([1, 2]), doubles([3, 4]))) == 11.0
    assert one(spark, normalize(doubles([0, 0]), "null")) is None and one(spark, normalize(doubles([0, 0]))) == [0.0, 0.0]


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id long, truth_rank int")
    got = metrics.accuracy(ranks).first()
    assert (got["top1"], got["top5"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and got["mrr"] == pytest.approx(1.25 / 3)
    assert metrics.corrected(ranks).first()["corrected"] == 1
    assert metrics.hard_queries(spark).count() == 7
    import random

    assert [r[0] for r in metrics.sample_ids(spark, 100, 5).collect()] == random.Random(42).sample(range(100), 5)
    assert metrics.throughput(10, 5.0)["images_per_second"] == 2.0


def test_credit_override_orders_by_sight_without_strong_text(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 0.2, 0.5, "MAIN CAST"), (1, "b", 0.5, 0.3, 0.6, "MAIN CAST"), (2, "a", 0.9, 0.95, 0.5, "the cast"), (3, "a", 0.9, None, 0.4, None)], "query_id long, media_id string, visual double, subtitle double, fused double, query_text string")
    got = {(r["query_id"], r["media_id"]): (round(r["final"], 6), round(r["sort_key"], 6)) for r in subtitles.credit_override(rows).collect()}
    assert got == {(1, "a"): (0.69, 0.9), (1, "b"): (0.44, 0.5), (2, "a"): (0.945, 0.945), (3, "a"): (0.4, 0.4)}


def test_clustered_vectors_are_identified(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 16))
    rows = [(i, f"m{i % 4}", i % 4, i // 4 + 1, 2.0 * (i // 4), [float(v) for v in centers[i % 4] + 0.2 * rng.normal(size=16)]) for i in range(80)]
    fr = spark.createDataFrame(rows, "vec_id long, media_id string, episode int, frame_no int, ts double, embedding array<float>").withColumns({"season": F.lit(1), "embedding": normalize("embedding").cast("array<float>")})
    clips = fr.filter("vec_id IN (5, 9)").select((F.col("vec_id") * 0 + 1).alias("clip_id"), F.row_number().over(__import__("pyspark").sql.Window.orderBy("vec_id")).alias("step"), "embedding")
    assert identify(clips, fr).orderBy("position").first()["media_id"] == "m1"
    clips.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clips.schema).parquet(str(tmp_path / "in"))
    identify_stream(stream, fr, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("position").first()["media_id"] == "m1"


def test_kmeans_is_as_good_as_a_plain_one(spark):
    from reelquery.operators import fingerprints as fp

    fr = vectors(spark, 240, 6)
    got = fp.prototypes(fr).collect()
    x = {}
    for r in fr.collect():
        x.setdefault((r["media_id"], r["season"], r["episode"]), []).append(r["embedding"])
    for key, rows in x.items():
        rows = np.array(rows)
        mine = [r for r in got if (r["media_id"], r["season"], r["episode"]) == key]
        c = np.array([r["embedding"] for r in mine])
        assert len(mine) == 8 and sum(r["cluster_size"] for r in mine) == len(rows) and np.allclose(np.linalg.norm(c, axis=1), 1)
        inertia = lambda c: ((rows[:, None] - c[None]) ** 2).sum(-1).min(1).sum()  # noqa: E731, B023
        plain = []
        for s in range(5):  # Lloyd's steps from several starts
            p = rows[np.random.default_rng(s).choice(len(rows), 8, replace=False)]
            for _ in range(30):
                near = ((rows[:, None] - p[None]) ** 2).sum(-1).argmin(1)
                p = np.array([rows[near == j].mean(0) if (near == j).any() else p[j] for j in range(8)])
            plain.append(inertia(p / np.linalg.norm(p, axis=1, keepdims=True)))
        assert inertia(c) <= 1.15 * min(plain)


def gestalt(a, b):
    """Characters in the longest common part, and in those left and right of it, over the mean length."""

    def matched(a, b):
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        return n + matched(a[:i], b[:j]) + matched(a[i + n :], b[j + n :]) if n else 0

    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_hybrid_similarity_against_a_plain_one(spark):
    texts = ["", "a", "the cat sat", "the cat sat on the mat", "on the mat sat the cat", "a cat", "mat the", "ab ba", "ba ab ab"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in rows.select("a", "b", tx.hybrid_similarity("a", "b").alias("s")).collect():
        a, b = r["a"], r["b"]
        x, y = set(a.split()), set(b.split())
        want = 0.0 if not a or not b else 1.0 if a == b else 0.65 * gestalt(a, b) + 0.35 * len(x & y) / len(x | y)
        assert r["s"] == pytest.approx(want), (a, b)
