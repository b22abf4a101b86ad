"""Operators over one key that holds most rows: the same results when it is split."""

import random

import pytest
from pyspark.sql import functions as F

from reelquery.operators import temporal
from reelquery.operators.quantiles import quantiles


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quantiles_equal_the_built_in_ones(spark, many_ranges):
    rng = random.Random(3)
    values = [0.0, -0.0, 7.5, float("inf"), float("nan"), None]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([*values, rng.gauss(0, 9), rng.gauss(0, 9)])) for _ in range(3000)]
    rows += [("one", 3.25), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "p60": 0.6, "median": 0.5, "p333": 0.333, "high": 1.0}
    got = quantiles(df, ["g"], "v", shares)
    want = df.groupBy("g").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items()))
    plain = lambda found: sorted(str([x + 0.0 if isinstance(x, float) else x for x in r]) for r in found.collect())  # noqa: E731  no -0.0
    assert plain(got) == plain(want.select(got.columns))
    assert quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_nearest_as_of_over_ranges_of_one_key(spark, many_ranges):
    rng = random.Random(5)
    left = [(0 if i % 9 else i % 4, float(rng.randrange(3000)) / 4 if i % 50 else None, i) for i in range(900)]
    right = [(0 if i % 9 else i % 3, float(rng.randrange(3000)) / 4 if i % 50 else None, i) for i in range(200)]
    a = spark.createDataFrame(left, "k long, t double, n long").repartition(3)
    b = spark.createDataFrame(right, "k long, t double, i long").repartition(3)
    want = {}
    for k, t, n in left:
        near = min(((abs(u - t), u, i) for j, u, i in right if j == k and u is not None), default=(None,) * 3) if t is not None else (None,) * 3
        want[n] = near[1:]
    for most in (10, None):
        got = temporal.nearest_as_of(a, b, "k", "t", "t", "i", most).collect()
        assert len(got) == 900 and {r["n"]: (r["_near_time"], r["_near_id"]) for r in got} == want
    one = temporal.nearest_as_of(a.withColumn("k", F.lit(0)), b.withColumn("k", F.lit(0)), "k", "t", "t", "i", 10)
    assert one.filter("t IS NOT NULL AND _near_id IS NULL").count() == 0


@pytest.mark.parametrize("longest", [None, 0.0, 90000.0])
def test_entries_of_a_day_take_few_cells(spark, longest):
    rng = random.Random(6)
    spans = [(rng.uniform(-100, 4000), rng.choice([0.0, 2.0, 40.0, 700.0, 86_400.0, 3e7])) for _ in range(60)] + [(5.0, -1.0)]
    points = [(i, rng.uniform(0, 5000)) for i in range(40)]
    p = spark.createDataFrame([("m", i, t) for i, t in points], "media_id string, p int, t double")
    e = spark.createDataFrame([("m", i, a, a + b) for i, (a, b) in enumerate(spans)], "media_id string, e int, start double, end double")
    for w in (6.0, 0.0):
        met = temporal.overlapping(p, e, w, longest=longest) if w or longest is None else None
        if met is not None:
            got = sorted((r["p"], r["e"]) for r in met.collect())
            assert got == sorted((i, j) for i, t in points for j, (a, b) in enumerate(spans) if b >= 0 and a + b >= t - w and a <= t + w)
    plan = temporal.overlapping(p, e, 6.0)
    assert plan.count() > 0
    assert temporal.overlapping(p, e.limit(0), 6.0).count() == 0


def test_a_long_entry_is_a_handful_of_rows(spark):
    """A window meets a day's entry once, and the entry is put into five cells at most."""
    rows = []
    real = temporal.F.explode
    e = spark.createDataFrame([("m", 0.0, 86_400.0)], "media_id string, start double, end double")
    p = spark.createDataFrame([("m", 40_000.0)], "media_id string, t double")
    try:
        temporal.F.explode = lambda c: rows.append(c) or real(c)
        met = temporal.overlapping(p, e, 6.0)
    finally:
        temporal.F.explode = real
    size = e.withColumnsRenamed({"media_id": "_key"}).withColumn("_level2", F.lit(6)).select(F.size(rows[0])).first()[0]
    assert met.count() == 1 and size <= 5


def test_prototypes_of_long_episodes(spark):
    """Episodes that are clustered by sums over tasks come out as well as those of one task; copies and short ones too."""
    import numpy as np

    from reelquery.operators import fingerprints as fp

    rng = np.random.default_rng(8)
    centers = rng.normal(size=(10, 5))
    rows = [(i, f"m{i % 3 // 2}", 1, None, [float(x) for x in centers[rng.integers(10)] + 0.3 * rng.normal(size=5)]) for i in range(900)]
    rows += [(5000 + i, "same", None, None, [1.0, 0.0, 0.0, 0.0, 2.0]) for i in range(60)] + [(6000, "one", 1, 1, [0.0, 3.0, 0.0, 0.0, 4.0])]
    fr = spark.createDataFrame(rows, "vec_id long, media_id string, season int, episode int, embedding array<double>").repartition(4)
    got = {n: fp.prototypes(fr, large=n).collect() for n in (50, 1000)}
    x = {}
    for _, m, _, _, v in rows:
        x.setdefault(m, []).append(v)
    spread = {}
    for n, found in got.items():
        assert {(r["media_id"], r["season"], r["episode"]) for r in found} == {(m, s, e) for _, m, s, e, _ in rows}
        for m, vectors in x.items():
            mine = [r for r in found if r["media_id"] == m]
            assert sum(r["cluster_size"] for r in mine) == len(vectors)
            assert np.allclose([np.linalg.norm(r["embedding"]) for r in mine], 1)
            v = np.array(vectors)
            near = ((v / np.linalg.norm(v, axis=1, keepdims=True)) @ np.array([r["embedding"] for r in mine]).T).argmax(1)
            spread[n, m] = sum(((v[near == j] - v[near == j].mean(0)) ** 2).sum() for j in set(near))
    assert spread[50, "m0"] <= 1.1 * spread[1000, "m0"] and spread[50, "m1"] <= 1.1 * spread[1000, "m1"]
