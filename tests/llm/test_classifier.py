import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.llm import classifier

GOOD = "The committee met on Tuesday, and its members agreed that the plan would be revised before spring."
BAD = "WIN!!! WIN!!! $$$ $$$ ### CLICK CLICK CLICK !!! $$$ WIN!!! "


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.filter("doc_id % 3 <> 0")
    found = classifier.classify(docs, known, F.col("source"), F.col("lang"))
    held = found.join(labels.filter("doc_id % 3 = 0"), "doc_id").select("keep", "quality").collect()
    assert len(held) > 50 and np.mean([r["keep"] == (r["quality"] == 1) for r in held]) >= 0.97


def test_sites_are_shrunk(spark):
    """A large bad site moves its documents far, a small one little; a path follows its host."""
    rows = [(i, GOOD + f" {i}", "big-bad" if i < 200 else "big-good", "p") for i in range(400)] + [(400, GOOD, "small-bad", "p"), (401, GOOD, "new", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, 0 if i < 180 else 1) for i in range(390)] + [(400, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classifier.classify(docs, labels, F.col("host"), F.col("path")).collect()}
    assert got[0]["host_posterior"] < 0.2 and got[300]["host_posterior"] > 0.9
    assert got[0]["host_posterior"] < got[400]["host_posterior"] < got[300]["host_posterior"]
    assert got[0]["score"] < got[401]["score"] < got[300]["score"]


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (11, 0), (None, 0), (3, None), (999, 0)], "doc_id long, quality int")
    got = classifier.classify(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = classifier.kept(odd, labels, F.col("source"), F.col("lang"))
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in got)
    assert classifier.classify(none, labels, F.col("source"), F.col("lang")).count() == 0
    alone = classifier.classify(odd, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(r["keep"] and r["evidence"] == 0.5 for r in alone)
    assert all(r["keep"] for r in classifier.classify(odd, labels.filter("quality = 1"), F.col("source"), F.col("lang")).collect())


def test_null_and_empty_hosts_are_two_groups(spark):
    rows = [(i, GOOD + f" {i}", None if i < 100 else "", "p") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r["host_posterior"] for r in classifier.classify(docs, labels, F.col("host"), F.col("path")).collect()}
    assert max(got[i] for i in range(100)) < 0.2 and min(got[i] for i in range(100, 200)) > 0.8


def test_regression_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 7))
    y = (x[:, 0] ** 2 + x[:, 1] > 1).astype(float)
    m = classifier.Regression(x, y)
    assert np.mean(((m._expand(x) @ m.weights) > 0) == (y > 0)) > 0.97


@pytest.mark.parametrize("text, sign", [(GOOD, 1), (BAD, -1)])
def test_features_tell_junk(spark, text, sign):
    f = classifier.described(spark.range(1).select(F.lit(text).alias("_text"))).first()
    words = text.lower().split()
    assert len(f["_s"]) == 7 and (f["_s"][0] < 0.2) == (sign > 0)
    assert len(f["_g"]) == 2 * len(words) - 1 and len(set(f["_g"][: len(words)])) == len(set(words))


def test_words_tell_where_shares_do_not(spark):
    """Good and bad documents of the same letters and lengths; only their words differ."""
    rng = np.random.default_rng(6)
    kinds = (["amber", "birch", "cedar", "daisy", "olive"], ["ambre", "brich", "cadre", "daysi", "ovile"])
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 12).tolist())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    got = classifier.classify(docs, labels, F.lit("h"), F.lit("p")).filter("doc_id >= 200").collect()
    assert np.mean([(r["evidence"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in got]) > 0.97


def test_posteriors_and_scores_against_plain_sums(spark):
    """Two hosts of several paths, some documents labelled; everything but the regression is worked out again."""
    rng = np.random.default_rng(5)
    site = [("one", "a"), ("one", "b"), ("two", "a"), ("two", "c"), ("two", "d"), (None, None)]
    rows = [(i, (GOOD if rng.random() < (0.9, 0.6, 0.3, 0.2, 0.7, 0.5)[i % 6] else BAD) + f" {i}", *site[i % 6]) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    label = {i: int(rows[i][1].startswith("The")) for i in range(0, 180, 4)}
    label[8] = 1 - label[8]
    labels = spark.createDataFrame(sorted(label.items()), "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classifier.classify(docs, labels, F.col("host"), F.col("path")).collect()}
    e = {i: float(label.get(i, got[i]["evidence"])) for i in got}
    where = {i: (h or "", p or "") for i, _, h, p in rows}

    def strength(groups):
        clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        n = sum(len(g) for g, _ in groups)
        spread = sum(len(g) * (sum(g) / len(g) - clip(x)) ** 2 - clip(x) * (1 - clip(x)) for g, x in groups) / (n - sum(len(g) ** 2 for g, _ in groups) / n)
        within = sum(len(g) * clip(x) * (1 - clip(x)) for g, x in groups) / n
        return min(max(within / spread - 1 if spread > 0 else 1e4, 2.0), 1e4)

    mean = sum(e.values()) / len(e)
    of = lambda key: {k: [e[i] for i in e if key(where[i]) == k] for k in {key(w) for w in where.values()}}
    hosts, paths = of(lambda w: w[0]), of(lambda w: w)
    m = strength([(g, mean) for g in hosts.values()])
    post = {h: (sum(g) + m * mean) / (len(g) + m) for h, g in hosts.items()}
    k = strength([(g, post[h]) for (h, _), g in paths.items()])
    odds = lambda p: np.log(p / (1 - p))
    for i, r in got.items():
        h, p = hosts[where[i][0]], paths[where[i]]
        host = (sum(h) - e[i] + m * mean) / (len(h) - 1 + m)
        path = (sum(p) - e[i] + k * host) / (len(p) - 1 + k)
        score = 1 / (1 + np.exp(-(odds(np.clip(r["evidence"], 1e-9, 1 - 1e-9)) + odds(path) - odds(mean))))
        assert (r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx((host, path, score), rel=1e-9)
        assert r["keep"] == (score >= 0.5)
