import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.llm import ann


def exact(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if d[i] < np.inf]


def frame(spark, x, ids):
    rows = [(int(i), None if v is None else [None if y is None else float(y) for y in v], "clash", 7) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, rank int")


@pytest.mark.parametrize("kind", ["random", "clustered", "equal"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    if kind == "clustered":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.2 * x
    if kind == "equal":
        x[:700] = x[0]
    x = x.astype("f4")
    ids = np.arange(1500)
    df = frame(spark, x, ids)
    got = {}
    for r in ann.neighbours(df, df.filter("vec_id % 100 = 0"), list_size=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    found = 0
    for q in range(0, 1500, 100):
        want = exact(x.astype("f8"), ids, q, 10)
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        found += len({i for i, _ in want} & {i for i, _ in got[q]})
        if kind == "equal" and q < 700:
            assert got[q] == want
    assert found >= 0.9 * 150


def test_odd_vectors(spark):
    x = [[1, 0], [0, 0], None, [1, None], [float("nan"), 1], [float("inf"), 0], [0, 1], [1, 0], [1, 0, 0], []]
    df = frame(spark, x, range(0, 1000, 100))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.neighbours(df, df).orderBy("query_id", "rank").collect()]
    root = round(2**0.5, 6)
    assert got == [(0, 1, 700, 0.0), (0, 2, 600, root), (600, 1, 0, root), (600, 2, 700, root), (700, 1, 0, 0.0), (700, 2, 600, root)]
    assert ann.neighbours(df.limit(0), df).count() == 0 and ann.neighbours(df, df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 100"), df).count() == 0


def test_search_finds_near_centroids():
    rng = np.random.default_rng(4)
    c = ann.Centroids(rng.normal(size=(4000, 8)).astype("f4"), 400)
    x = rng.normal(size=(200, 8)).astype("f4")
    for breadth in (8, 32, 300):
        found, far = c.search(x, breadth)
        true = ann.squares(x, c.points).argsort(1)[:, :4]
        assert np.mean([len(set(a) & set(b)) for a, b in zip(found[:, :4], true)]) > 3.8 and (np.diff(far, axis=1) >= 0).all()
        assert all(len(set(a)) == breadth for a in found)


def test_opened_lists_hold_enough_rows():
    rng = np.random.default_rng(5)
    c = ann.Centroids(rng.normal(size=(4000, 8)).astype("f4"), 400)
    sizes = np.r_[np.zeros(350, int), np.ones(50, int)]
    for lists in c.opened(rng.normal(size=(50, 8)), 1e-3, sizes, 40):
        assert sizes[lists].sum() >= 40 and len(set(lists)) == len(lists)


def compared(df, k=10):
    """Rows that a query is compared with on average, as a share of the table, and copies of a row."""
    seen = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "_searched", lambda postings, wanted, k, real=ann._searched: (seen.setdefault("p", (postings, wanted)), real(postings, wanted, k))[1])
        ann.neighbours(df, df.filter("vec_id % 100 = 0"), k).count()
    postings, wanted = seen["p"]
    met = wanted.select(F.explode("lists").alias("list")).join(postings.groupBy("list").count(), "list").agg(F.sum("count")).first()[0]
    n = df.count()
    return met / wanted.select("query_id").distinct().count() / n, postings.count() / n


def test_clustered_vectors_are_compared_with_few(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 24))
    share, copies = compared(frame(spark, x, range(6000)))
    assert share < 0.2 and 1 <= copies <= 2


def test_double_vectors_keep_their_precision(spark):
    x = np.random.default_rng(9).normal(size=(40, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.neighbours(df, df.filter("vec_id = 3"), k=5).orderBy("rank").collect()]
    assert got == exact(x, np.arange(40), 3, 5)


def test_queries_alone_in_their_lists(spark):
    # pairs far from each other: each pair draws a centroid of its own, at distance 0
    x = np.repeat(np.random.default_rng(3).normal(size=(60, 8)) * 100, 2, axis=0).astype("f4")
    df = frame(spark, x, range(120))
    got = {}
    for r in ann.neighbours(df, df.filter("vec_id % 10 = 0"), list_size=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(got[q]) == 10 and got[q][0] == q + 1 for q in range(0, 120, 10))


def test_outliers_and_tight_groups_get_all_their_neighbours(spark):
    # the usual vectors, outliers far apart and groups of ten nearly equal ones: each is asked
    rng = np.random.default_rng(12)
    usual, far = rng.normal(size=(2000, 12)), 50 * rng.normal(size=(40, 12))
    tight = np.repeat(30 * rng.normal(size=(6, 12)), 10, axis=0) + 1e-3 * rng.normal(size=(60, 12))
    x = np.vstack([usual, far, tight]).astype("f4")
    df, ids = frame(spark, x, range(2100)), np.arange(2100)
    got = {}
    for r in ann.neighbours(df, df.filter("vec_id >= 2000"), list_size=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    found = [len({i for i, _ in exact(x.astype("f8"), ids, q, 10)} & set(got[q])) for q in range(2000, 2100)]
    assert all(len(got[q]) == 10 for q in range(2000, 2100)) and np.mean(found) >= 9


def test_common_vectors_are_thinned_to_what_may_be_found(spark):
    x = np.random.default_rng(13).normal(size=(900, 6)).astype("f4")
    x[::3] = x[0]
    df = frame(spark, x, range(900)).select("vec_id", F.col("embedding").alias("v"))
    left = {r["vec_id"] for r in ann.thinned(df, 10, 256).collect()}
    assert left == {*range(0, 33, 3)} | {i for i in range(900) if i % 3}


def test_repeated_rows_count_once(spark):
    x = np.random.default_rng(6).normal(size=(200, 6)).astype("f4")
    df = frame(spark, x, range(200))
    near = df.filter("vec_id = 7")
    for _ in range(4):
        near = near.union(near)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows.collect())
    got = key(ann.neighbours(df.union(df).union(near), df.filter("vec_id % 20 = 0"), list_size=1000))
    assert got == key(ann.neighbours(df, df.filter("vec_id % 20 = 0"), list_size=1000)) and len(got) == 100
    # one vec_id with two vectors: the nearer one counts
    other = spark.createDataFrame([(7, [float(v) for v in x[0]], "clash", 7)], df.schema)
    first = [r for r in ann.neighbours(df.union(other), df.filter("vec_id = 0"), list_size=1000).orderBy("rank").collect()]
    assert first[0]["vec_id"] == 7 and first[0]["score"] == 0 and len({r["vec_id"] for r in first}) == 10


@pytest.mark.parametrize("kind, sizes", [("float", (1e20, 3e38, 1e-30, 1.0)), ("double", (1e200, 1e308, 1e-200, 1.0))])
def test_finite_vectors_of_any_size_are_found(spark, kind, sizes):
    """Queries and rows far larger or smaller than the others take part; nothing is lost to overflow or underflow."""
    from decimal import Decimal, localcontext

    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (400, 5))
    for i, size in enumerate(sizes):
        x[i * 100 : i * 100 + (30 if i else 3)] *= size
    x = x.astype("f4" if kind == "float" else "f8")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    asked = df.filter("vec_id % 100 < 2")
    got = {}
    for r in ann.neighbours(df, asked, list_size=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    with localcontext() as c:
        c.prec = 60
        rows = [[Decimal(float(v)) for v in r] for r in x]
        for q in (i for i in range(400) if i % 100 < 2):
            far = {i: sum(((a - b) ** 2 for a, b in zip(rows[i], rows[q], strict=True)), Decimal(0)).sqrt() for i in range(400) if i != q}
            want = sorted(far, key=lambda i: (float(far[i]), i))[:10]
            assert len(got[q]) == 10
            assert all(s == pytest.approx(float(far[i]), rel=1e-9) for i, s in got[q])
            hits += len(set(want) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 80


def test_all_vectors_large(spark):
    rng = np.random.default_rng(5)
    for size, kind in ((1e25, "float"), (1e250, "double"), (1e-250, "double")):
        rows = [(i, [float(v) * size for v in rng.uniform(-1, 1, 4)]) for i in range(200)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = ann.neighbours(df, df.filter("vec_id % 100 = 0"), list_size=20, recall=1.0).orderBy("query_id", "rank").collect()
        x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()]) / size
        found = sum(len({i for i, _ in exact(x, np.arange(200), q, 10)} & {r["vec_id"] for r in got if r["query_id"] == q}) for q in (0, 100))
        assert len(got) == 20 and found >= 18
