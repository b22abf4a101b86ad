"""Best lines and the text around them: rows are final where they are found, whatever batches and tasks an item lies in."""

import random

import pytest
from pyspark.sql import functions as F

from reelquery import weights as W
from reelquery.operators import subtitles as sub
from test_blocks import slow_lines, slow_similarity


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(30))]) for _ in range(rng.randrange(n)))
    entries = [(0 if i % 3 else i % 7, i, float(rng.randrange(40)), line(8)) for i in range(300)]
    around = {(m, t): line(20) for m, _, t, _ in entries}
    return [(100 + i, i % 9, 0.0, entries[i * 5][3] if i % 2 else line(8)) for i in range(30)], [(*e, around[e[0], e[2]]) for e in entries]


@pytest.fixture(params=[7, 10_000])
def frames(spark, talk, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark.createDataFrame(talk[0], "query_id long, media_id long, start double, norm string"), spark.createDataFrame(talk[1], "media_id long, entry_no long, start double, norm string, around string").repartition(5)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("large", [20, 1000])
def test_lines_and_texts_around_them(frames, talk, large):
    q, e = frames
    w = W.Subtitle()
    lines = slow_lines(talk[0], [x[:4] for x in talk[1]], None)
    norm, around = {x[0]: x[3] for x in talk[0]}, {(x[0], x[1]): x[4] for x in talk[1]}
    want = {k: (s, t, n, round(slow_similarity(norm[k[0]], around[k[1], n]) if n is not None else 0.0, 9)) for k, (s, t, n) in lines.items()}
    got = sub.line_window_scores(q, e, large=large).collect()
    assert len(got) == len(want) and {(r["query_id"], r["media_id"]): (round(r["line_score"], 9), r["line_start"], r["line_no"], round(r["window_score"], 9)) for r in got} == want
    score = {k: w.line * v[0] + w.around * v[3] for k, v in want.items()}
    ranks = {r["query_id"]: r["truth_rank"] for r in sub.line_window_ranks(q, e, F.col("query_id") % 9).collect()}
    assert ranks == {i: 1 + sum((-round(s, 9), m) < (-round(score[i, i % 9], 9), i % 9) for (j, m), s in score.items() if j == i) if (i, i % 9) in score else None for i in norm}


def test_rows_of_queries_and_items_are_not_shuffled(frames):
    q, e = frames
    for found in (sub.best_lines(q, e), sub.best_lines(q, e, apart=3.0), sub.line_window_scores(q, e)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Exchange") and "hashpartitioning(query_id" not in plan


def test_queries_of_one_id_are_put_together(frames):
    q, e = frames
    twice = q.withColumn("query_id", F.floor(F.col("query_id") / 2))
    got = sub.best_lines(twice, e).select("query_id", "media_id", F.round("line_score", 9).alias("s"))
    want = sub.best_lines(q, e).groupBy(F.floor(F.col("query_id") / 2).alias("query_id"), "media_id").agg(F.round(F.max("line_score"), 9).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())
