"""Quality of documents by hierarchical empirical Bayes.

A logistic regression, fitted on a bounded sample of labelled documents, gives each document's own evidence. Its
features are shares of kinds of characters and what the document's words and pairs of words say: each is
hashed into a bucket, a bucket's weight is its log odds among good and bad labelled documents, and the feature is
the mean weight. Weights that the regression is fitted on come from the other half of the sample, so it learns
how far they hold for documents that they weren't made from.

Labels, and where there are none the regression's probabilities, are summed by host and by path of a host. A
host's posterior is shrunk towards the global mean and a path's towards its host's, by as many pseudo-documents as the
spread between hosts, or between paths of a host, warrants (method of moments over the grouped sums). A
document's own label or probability is left out of the posteriors that it meets, so nothing counts twice; its
score adds the odds of its path over the global ones to its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import field, hinted, sealed, staged, table, unsealed

#: Labelled documents that the regression is fitted on, at most; buckets of words and pairs of words.
SAMPLE, BUCKETS = 20_000, 4096
#: Ridge penalty; steps of Newton's method; least and most pseudo-documents; documents from this score on are kept.
RIDGE, STEPS, PRIOR, KEEP = 1.0, 25, (2.0, 1e4), 0.5
BROADCAST_ROWS = 500_000
#: Features: seven shares and the mean weight of words.
WIDTH = 8


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shares(text: str, words: str) -> Column:
    """What tells prose from junk: shares of upper case among letters, of digits, of quoting and sentence
    marks, of other marks and of repeated words, and the lengths of words and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda drop: F.length(F.regexp_replace(t, drop, ""))
    letters, upper, digits, marks = count(r"\P{L}+"), count(r"\P{Lu}+"), count(r"\P{Nd}+"), count(r"[^.,;:'\"()\-]+")
    space = count(r"[^\x20\x09-\x0D]+")
    w = F.size(words)
    again = F.size(F.filter(F.arrays_zip(*_pairs(words)), lambda p: p["a"] == p["b"]))
    each = [upper / F.greatest(letters, F.lit(1)), digits / n, marks / n, (n - letters - digits - marks - space) / n, again / F.greatest(w, F.lit(1)), (letters / F.greatest(w, F.lit(1))) / 10.0, F.log1p(n.cast("double")) / 10.0]
    return F.array(*(x.cast("double") for x in each))


def _pairs(words: str) -> list[Column]:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return [F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b")]


def grams(words: str, buckets: int = BUCKETS) -> Column:
    """The buckets of a document's words and pairs of neighbouring words, without regard to case."""
    h = F.transform(words, lambda w: F.xxhash64(F.lower(w)))
    n = F.greatest(F.size(h) - 1, F.lit(0))
    both = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat(h, both), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def described(docs: DataFrame, weights: Column | None = None) -> DataFrame:
    """``docs`` (_text and others) with _s, the shares, _g, the buckets, and, given buckets' ``weights``, _f, all features.
    Each step is a projection of its own, so that a text is split and hashed once."""
    out = docs.withColumn("_w", words("_text")).withColumns({"_s": shares("_text", "_w"), "_g": grams("_w")}).drop("_w", "_text")
    return out if weights is None else out.withColumn("_f", F.concat("_s", F.array(mean_weight("_g", weights)))).drop("_s", "_g")


def mean_weight(grams: str, weights: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(weights, g))
    return total / F.greatest(F.size(grams), F.lit(1))


def log_odds(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """Of each bucket, from the documents it stands in; one is added to each count."""
    return np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))


class Regression:
    """Logistic regression on standardised features and their squares, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = x.mean(0) if len(y) else np.zeros(x.shape[1])
        self.scale = np.maximum(x.std(0), 1e-6) if len(y) else np.ones(x.shape[1])
        z = self._expand(x)
        self.weights = np.zeros(z.shape[1])
        if len(np.unique(y)) < 2:  # nothing to tell apart: every document gets the rate itself
            self.weights[0] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return
        penalty = np.full(z.shape[1], RIDGE)
        penalty[0] = 1e-6
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (y - p) - penalty * self.weights
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def _expand(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(s), 1)), s, s**2])

    def column(self, f: Column) -> Column:
        """The probability as an expression of the array column ``f``."""
        n = len(self.mean)
        total = F.lit(float(self.weights[0]))
        for i in range(n):
            s = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (f[i] - float(self.mean[i])) / float(self.scale[i])))
            total = total + s * float(self.weights[1 + i]) + s * s * float(self.weights[1 + n + i])
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _strength(groups: DataFrame, mean: Column, n: Column, good: Column) -> float:
    """Pseudo-documents of a Beta prior around ``mean``, by the spread of the groups' means beyond what chance gives."""
    m = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), mean))
    row = groups.agg(F.sum(n * F.pow(good / n - m, 2)).alias("s"), F.sum(m * (1 - m)).alias("w"), F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * m * (1 - m)).alias("v"), F.sum(F.pow(n.cast("double"), 2)).alias("q")).first()
    if not row["k"] or row["k"] < 2 or not row["n"]:
        return PRIOR[1]
    spread = (row["s"] - row["w"]) / max(row["n"] - row["q"] / row["n"], 1e-9)
    within = row["v"] / row["n"]
    return float(np.clip(within / spread - 1 if spread > 0 else PRIOR[1], *PRIOR))


def fitted(own: DataFrame, known: DataFrame, sample: int) -> tuple[Regression, np.ndarray]:
    """The regression and the buckets' weights, from at most about ``sample`` labelled documents. The driver gets a few
    numbers of each, and two counts a bucket and half."""
    total = known.count()
    part = known if total <= sample else known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1e6 * sample / total))
    rows = own.join(hinted(part, BROADCAST_ROWS), F.expr("doc_id = _id")).select("doc_id", "_h", "_y", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half"), "_text")
    rows = staged(described(rows), "quality-sample")
    good = F.col("_y") >= 0.5
    counts = rows.groupBy("half").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).collect()
    n = np.zeros((2, 2), int)  # half, label
    for r in counts:
        n[r["half"]] = r["bad"], r["good"]
    stands = np.zeros((2, 2, BUCKETS))
    each = rows.select("half", good.cast("int").alias("y"), F.explode(F.array_distinct("_g")).alias("g")).groupBy("half", "y", "g").count()
    for r in each.collect():
        stands[r["half"], r["y"], r["g"]] = r["count"]
    by_half = [log_odds(stands[h, 1], stands[h, 0], n[h, 1], n[h, 0]) for h in (1, 0)]  # of the other half
    told = F.when(F.col("half") == 0, mean_weight("_g", F.lit(by_half[0].tolist()))).otherwise(mean_weight("_g", F.lit(by_half[1].tolist())))
    fit = rows.select("doc_id", "_h", "_y", F.concat("_s", F.array(told)).alias("_f")).toPandas().sort_values(["doc_id", "_h", "_y"], kind="stable")
    model = Regression(np.array(fit["_f"].tolist(), float).reshape(len(fit), WIDTH), (fit["_y"].to_numpy(float) >= 0.5).astype(float))
    return model, log_odds(*stands.sum(0)[::-1], *n.sum(0)[::-1])


def _named(site: Column) -> Column:
    """A site's name, with null as a name that no site has."""
    return F.coalesce(F.concat(F.lit("="), site.cast("string")), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, _h (hash of the text), evidence, host_posterior, path_posterior, score and keep for each row
    of ``docs`` (doc_id, text and what host and path are made of).

    ``labels`` (doc_id, quality 0 or 1) may cover any part; repeated labels of a document are averaged, null
    ones ignored. Null or empty texts are judged by their features like others; null hosts or paths
    form groups of their own, beside that of empty ones; without labels every document's own evidence is one half and all are kept.
    Repeated rows are judged each and count each in their site. Texts of any length are read whole. Other columns, whatever they
    are called, are ignored; an empty table gives an empty result.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("_h"), _named(host).alias("_host"), _named(path).alias("_path"), F.col("text").alias("_text"))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).filter("_y IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.avg("_y").alias("_y"))
    known = staged(known, "quality-labels")
    model, weights = fitted(own, known, sample)
    judged = described(own, F.lit(weights.tolist()).cast("array<double>")).withColumn("evidence", model.column(F.col("_f")))
    judged = judged.join(hinted(known, BROADCAST_ROWS), F.expr("doc_id = _id"), "left")
    judged = staged(judged.select("doc_id", "_h", "_host", "_path", "evidence", F.coalesce("_y", "evidence").alias("_e")), "quality-evidence")
    paths = staged(judged.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_e").alias("good")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    n, good = hosts.agg(F.sum("hn"), F.sum("hgood")).first()
    mean = float(np.clip((good or 0.0) / n if n else 0.5, 1e-4, 1 - 1e-4))
    m = _strength(hosts, F.lit(mean), F.col("hn"), F.col("hgood"))
    hosts = hosts.withColumn("_whole", (F.col("hgood") + m * mean) / (F.col("hn") + m))
    both = staged(paths.join(hosts, "_host"), "quality-hosts")
    k = _strength(both, F.col("_whole"), F.col("n"), F.col("good"))
    out = judged.join(hinted(both, BROADCAST_ROWS), ["_host", "_path"])
    # a document isn't among its own site's evidence
    out = out.withColumn("host_posterior", (F.col("hgood") - F.col("_e") + m * mean) / (F.col("hn") - 1 + m))
    out = out.withColumn("path_posterior", (F.col("good") - F.col("_e") + k * F.col("host_posterior")) / (F.col("n") - 1 + k))
    odds = lambda p: F.ln(p / (1 - p))
    clipped = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(c)))
    score = 1 / (1 + F.exp(-(odds(clipped("evidence")) + odds(clipped("path_posterior")) - float(np.log(mean / (1 - mean))))))
    return out.withColumn("score", score).select("doc_id", "_h", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= keep).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; repeated rows stay or go together. An empty table
    gives an empty result."""
    gone = staged(classify(docs, labels, host, path).filter("NOT keep").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).distinct(), "quality-gone")
    rows = sealed(docs).withColumns({"doc_id": field("doc_id"), "_h": F.xxhash64(field("text"))})
    return unsealed(rows.join(hinted(gone, BROADCAST_ROWS), F.expr("doc_id <=> _d AND _h = _g"), "left_anti"), docs.columns)


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "evidence", "host_posterior", "path_posterior", "score", "keep")
