"""Queries against all rows in blocks: the same whether queries are broadcast or dealt, few or many, and where one item holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from reelquery.operators import blocks, fingerprints as fp, knn, subtitles as sub


def slow_similarity(a, b):
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    a, b = a.split(), b.split()
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 0.7 * share(set(a), set(b)) + 0.3 * share(set(zip(a, a[1:])), set(zip(b, b[1:])))  # noqa: B905


def slow_lines(queries, entries, apart):
    out = {}
    for q, m0, t0, text in queries:
        for m, no, start, line in entries:
            if apart is not None and m == m0 and abs(start - t0) <= apart:
                continue
            s = slow_similarity(text, line)
            key = (round(s, 9), -start, -no)
            if (q, m) not in out or key > out[q, m][0]:
                out[q, m] = (key, (round(s, 9), start if s > 0 else None, no if s > 0 else None))
    return {k: v[1] for k, v in out.items()}


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(60)]
    line = lambda: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(0, 9)))
    entries = [(0 if i % 3 else i % 7, i, float(rng.randrange(40)), line()) for i in range(400)]
    queries = [(100 + i, i % 7, float(rng.randrange(40)), entries[i * 5][3] if i % 2 else line()) for i in range(30)]
    return queries + [(999, 3, 0.0, ""), (998, 3, 0.0, "the")], entries + [(8, 0, 1.0, ""), (9, 0, 2.0, "the"), (9, 1, 1.0, "the")]


@pytest.mark.parametrize("most", [4096, 5])
@pytest.mark.parametrize("apart", [None, 3.0, 100.0])
def test_best_lines(spark, monkeypatch, talk, most, apart):
    monkeypatch.setattr(blocks, "MOST", most)
    queries, entries = talk
    q = spark.createDataFrame(queries, "query_id long, media_id long, start double, norm string")
    e = spark.createDataFrame(entries, "media_id long, entry_no long, start double, norm string").repartition(5)
    got = sub.best_lines(q, e, apart)
    assert {(r["query_id"], r["media_id"]): (round(r["line_score"], 9), r["line_start"], r["line_no"]) for r in got.collect()} == slow_lines(queries, entries, apart)


def test_no_queries_and_no_entries(spark, talk):
    q = spark.createDataFrame(talk[0], "query_id long, media_id long, start double, norm string")
    e = spark.createDataFrame(talk[1], "media_id long, entry_no long, start double, norm string")
    assert sub.best_lines(q.limit(0), e).count() == 0 and sub.best_lines(q, e.limit(0)).count() == 0


def vectors(n, seed):
    rng = random.Random(seed)
    return [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(n)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("most", [4096, 3])
def test_prototypes_and_other_items_at_the_same_time(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "MOST", most)
    rows = [(i, f"m{i % 4 if i % 2 else 0}", None if i % 4 else 1, None, float(i // 2), v) for i, v in enumerate(vectors(300, 1))]
    frames = spark.createDataFrame(rows, "vec_id long, media_id string, season int, episode int, ts double, embedding array<double>").repartition(4)
    asked = [(i, s, v) for i in range(9) for s, v in enumerate(vectors(2, 50 + i))]
    found = fp.prototype_scores(spark.createDataFrame(asked, "query_id long, step int, embedding array<double>"), frames)
    best = {}
    for q, s, v in asked:
        for _, m, season, episode, _, x in rows:
            best.setdefault((q, m, season, episode), {}).setdefault(s, []).append(dot(v, x))
    want = {k: sum(0.35 * x for x in [max(max(v) for v in steps.values())]) for k, steps in best.items()}
    got = {(r["query_id"], r["media_id"], r["season"], r["episode"]): r["best"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(0.35 * got[k] - want[k]) < 1e-9 for k in got)

    own = [(i, f"m{i % 4}", 10.0 * i, vectors(2, i)) for i in range(9)]
    pairs = {}
    for q, m0, t, ours in own:
        for _, m, _, _, ts, x in rows:
            if m != m0 and abs(ts - t) <= 7:
                pairs.setdefault((q, m), []).extend(dot(o, x) for o in ours)
    got = knn.beside(spark.createDataFrame(own, "query_id long, _m string, t double, ours array<array<double>>"), frames, 7.0)
    assert {(r["query_id"], r["media_id"]): (round(r["best"], 9), r["pairs"]) for r in got.collect()} == {k: (round(max(v), 9), len(v)) for k, v in pairs.items()}


def test_large_queries_are_dealt_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_BYTES", 200)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(50, 3))], "vec_id long, embedding array<double>")
    q = rows.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("self_id"), "embedding")
    found = knn.nearest(rows, q, 3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    monkeypatch.undo()
    assert [(*r[:2], round(r[2], 9), r[3]) for r in sorted(found.collect())] == [(*r[:2], round(r[2], 9), r[3]) for r in sorted(knn.nearest(rows, q, 3).collect())]
