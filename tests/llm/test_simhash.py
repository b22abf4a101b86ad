from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelquery.llm import simhash
from reelquery.llm.components import components


def slow_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [least[find(i)] for i in range(len(fps))]


def test_odd_documents(spark, odd, none):
    got = simhash.near_duplicates(odd, "text").select("doc_id", "text", simhash.hexed("fp").alias("f"), "component_id").collect()
    fps = [slow_fingerprint(r["text"]) for r in got]
    assert [r["f"] for r in got] == [f"{x:016x}" for x in fps]
    assert [r["component_id"] for r in got] == slow_components(fps, [r["doc_id"] for r in got])
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == simhash.near_duplicates(odd).select("root").distinct().count()


@pytest.mark.parametrize("tile", [5, 8192])
def test_links_of_dense_groups(spark, tile):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(6):
        base = int(rng.integers(0, 2**64, dtype="u8"))
        for _ in range(25):
            base ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
            fps.add(base)
    fps |= {int(x) for x in rng.integers(0, 2**64, 60, dtype="u8")}
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(classes, tile=tile)).collect()}
    want = slow_components(fps, list(range(len(fps))))
    for i in range(len(fps)):
        for j in range(i):
            together = found.get(signed[i], ("alone", i)) == found.get(signed[j], ("alone", j))
            assert together == (want[i] == want[j])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (7, 8), (8, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_choices_cover_three_bits():
    m = [x % 2**64 for x in simhash.masks()]
    assert len(m) == 20 and all(31 <= x.bit_count() <= 33 for x in m)
    rng = np.random.default_rng(1)
    for _ in range(2000):
        d = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not d & x for x in m)


def test_shingles_hash_as_spark_does(spark):
    text = "a b c"
    assert spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"] % 2**64 == xxhash.xxh64_intdigest(text, 42)


def test_components_go_on_until_they_settle(spark, monkeypatch):
    from reelquery.llm import components as module

    monkeypatch.setattr(module, "MAX_ROUNDS", 1, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["root"] for r in module.components(edges).collect()} == {0}
