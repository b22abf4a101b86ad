"""What a task holds and does grows no faster than its rows."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelquery import weights as W
from reelquery.functions.vector import normalize
from reelquery.operators import blockindex, fingerprints as fp, knn, temporal


def test_nearest_as_of_sums_no_frame_anew_for_each_row(spark):
    rows = spark.range(50).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"), "id")
    plan = temporal.nearest_as_of(rows, rows, "k", "t", "t", "id")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_lengths_are_found_once_a_vector(spark):
    rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (i % 7).cast("double")).alias("v"))
    began = time.time()
    assert rows.select(normalize("v")[1].alias("x")).agg(F.count("x")).first()[0] == 400
    assert time.time() - began < 10


def test_top_k_holds_the_same_for_many_queries():
    rng = np.random.default_rng(1)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 8))), pa.list_(pa.float64()))
    asked = pa.table({"query_id": np.arange(4096), "self_id": np.arange(4096), "embedding": vectors(4096)})
    rows = pa.RecordBatch.from_pydict({"vec_id": pa.array(np.arange(4096)), "embedding": vectors(4096)})
    tracemalloc.start()
    found = list(knn._search(10, True)(asked, iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 40_960 and peak < 150e6


@pytest.mark.parametrize("cells", [50, 1 << 21])
def test_fingerprints_around(spark, monkeypatch, cells):
    monkeypatch.setattr(fp, "CELLS", cells)
    rng, w = random.Random(2), W.Fingerprint()
    vector = lambda n: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    episodes = [("a", None, None), ("a", 1, 1), ("b", 1, None)]
    prints = [(*e, i, 30.0 * i, vector(3 if i % 5 else 2)) for n, e in enumerate(episodes) for i in range(1 + 9 * n)]
    asked = [(q, s, vector(3) if s else None, *e) for q in range(8) for s in range(3) for e in episodes]
    p = spark.createDataFrame(prints, "media_id string, season int, episode int, vec_id long, target_time double, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, step int, embedding array<double>, media_id string, season int, episode int").repartition(3)
    want = {}
    for i, s, v, *e in asked:
        own = [x for x in prints if list(x[:3]) == e]
        sims = [sum(a * b for a, b in zip(v, x[5], strict=True)) if v is not None and len(v) == len(x[5]) else None for x in own]
        for n, x in enumerate(own):
            near = [y for y in sims[max(0, n - 2) : n + 3] if y is not None]
            local = w.local_best * max(near) + w.local_mean * sum(near) / len(near) + w.local_share * sum(y >= w.strong for y in near) / len(near) if near else None
            want[i, *e, s, x[3]] = (sims[n], local if local is None else round(local, 9))
    rows = fp.local_scores(q, p).collect()
    key = lambda r: (r["query_id"], r["media_id"], r["season"], r["episode"], r["step"])
    assert len(rows) == len(want) and {(*key(r), r["vec_id"]): (r["sim"], r["local"] if r["local"] is None else round(r["local"], 9)) for r in rows} == want
    best = {}
    for k, v in want.items():
        order = (v[0] is not None, v[0] or 0.0, -k[5])
        if k[:5] not in best or order > best[k[:5]][0]:
            best[k[:5]] = (order, k[5], v)
    got = fp._met(q, p, w, best=True)
    assert {key(r): (r["vec_id"], (r["sim"], r["local"] if r["local"] is None else round(r["local"], 9))) for r in got.collect()} == {k: v[1:] for k, v in best.items()}
    assert "Window" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [4, 100])
def test_native_top_k_is_compiled_and_sorts_few_pairs(spark, size):
    rng = random.Random(size)
    vector = lambda n: [float(rng.randrange(-3, 4)) for _ in range(n)]
    rows = [(i, vector(size)) for i in range(900)] + [(1000, None), (1001, [None, *vector(size - 1)]), (1002, vector(size + 1)), (1003, vector(2))]
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = f.filter("vec_id % 90 = 0 OR vec_id > 999").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 20 != 0, F.col("vec_id")).alias("self_id"), "embedding")
    found = knn.nearest_native(f, q, 3)
    own = {r["query_id"]: r["self_id"] for r in q.collect()}
    want = set()
    for i, v in rows:
        if i in own and v is not None and None not in v:
            sims = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), j) for j, x in rows if x is not None and None not in x and len(x) == len(v) and j != own[i])[:3]
            want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(sims)}
    assert {(r["query_id"], r["vec_id"], r["sim"], r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_least" in plan and (size > knn.COLUMNS or "lambda" not in plan)


def test_opened_blocks_hold_few_products():
    rng = np.random.default_rng(3)
    queries = rng.normal(size=(500, 8))

    class Shared:
        value = np.arange(500), np.full(500, np.nan), queries, np.full(500, -np.inf)

    vectors = rng.normal(size=(200, 64, 8))
    lists = lambda x, kind: pa.array(x.tolist(), kind)
    blocks = pa.RecordBatch.from_pydict({
        "vec_ids": lists(np.arange(12_800).reshape(200, 64), pa.list_(pa.int64())),
        "vectors": lists(vectors, pa.list_(pa.list_(pa.float64()))),
        "centroid": lists(vectors.mean(1), pa.list_(pa.float64())),
        "radius": pa.array(np.sqrt(((vectors - vectors.mean(1, keepdims=True)) ** 2).sum(2)).max(1)),
    })
    tracemalloc.start()
    (found,) = blockindex._opened(5, Shared, 1 << 14)(iter([blocks]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = queries @ vectors.reshape(-1, 8).T
    got = np.lexsort((found["vec_id"].to_numpy(), -found["sim"].to_numpy(), found["query_id"].to_numpy()))
    assert (found["vec_id"].to_numpy()[got].reshape(500, 5) == np.argsort(-sims, 1)[:, :5]).all() and peak < 20e6
