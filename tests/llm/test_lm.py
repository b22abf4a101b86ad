import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.llm import ctw, lm


class SlowTree:
    """Context-tree weighting by dictionaries: one tree for each prefix of a byte's bits."""

    def __init__(self, streams, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for s in streams:
            full = ctw.END * depth + s
            for p in range(depth, len(full)):
                context = full[p - depth : p][::-1]
                for j, bit in self.bits(full[p]):
                    for d in range(depth + 1):
                        self.counts[context[:d], j][bit] += 1
        self.children = defaultdict(list)
        for c, j in self.counts:
            if c:
                self.children[c[:-1], j].append(c)
        self.memo = {}

    @staticmethod
    def bits(x):
        return [(1 << t | x >> (8 - t), x >> (7 - t) & 1) for t in range(8)]

    def kt(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, j):
        if (c, j) not in self.memo:
            own = self.kt((c, j))
            if len(c) < self.depth:
                own = np.logaddexp(own, sum(self.weighted(x, j) for x in self.children[c, j])) - math.log(2)
            self.memo[c, j] = own
        return self.memo[c, j]

    def p1(self, context, j):
        left, total = 1.0, 0.0
        for d in range(self.depth + 1):
            c = context[:d]
            if (c, j) not in self.counts:
                return 0.5
            a, b = self.counts[c, j]
            k = (b + 0.5) / (a + b + 1)
            if d == self.depth or (context[: d + 1], j) not in self.counts:
                return total + left * k
            stop = math.exp(self.kt((c, j)) - math.log(2) - self.weighted(c, j))
            total, left = total + left * stop * k, left * (1 - stop)

    def score(self, s):
        full, out = ctw.END * self.depth + s, 0.0
        for p in range(self.depth, len(full)):
            context = full[p - self.depth : p][::-1]
            for j, bit in self.bits(full[p]):
                p1 = self.p1(context, j)
                out += math.log10(p1 if bit else 1 - p1)
        return out


TRAIN = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", None, "é ü"] * 3
TEST = ["the cat sat", "zebra the", "", None, "ü é q"]


@pytest.mark.parametrize("depth, block", [(1, 10**6), (2, 10**6), (4, 10**6), (4, 20), (5, 3)])
def test_scores(spark, depth, block):
    stream = lambda t: b" ".join(ctw.canonical(t)) + ctw.END
    slow = SlowTree([stream(t) for t in TRAIN], depth)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEST + TRAIN[:3])], "doc_id long, text string")
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    got = {r["doc_id"]: r for r in lm.score(docs, train, depth=depth, block=block, head=3).collect()}
    counts = Counter(w for t in TRAIN for w in [*ctw.canonical(t), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(TEST + TRAIN[:3]):
        words = [*ctw.canonical(t), "end"]
        assert got[i]["score"] == pytest.approx(slow.score(stream(t)), abs=1e-4)
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * math.log2(10) / len(stream(t)))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words), sum(w in counts for w in words), n)


def test_probabilities_sum_to_one():
    streams = [b"abracadabra\n", b"abc\n", b"cab\n"]
    levels = ctw.tree(*ctw.counted(ctw.grams(streams, 2)), 2, 0)
    above = None
    for level in levels:
        level.mix(above)
        above = level
    s = ctw.Scorer([(x.keys, x.logs()) for x in levels])
    for context in (b"ab", b"zz", b"\n\n", b"bz"):
        g = np.array([context[1] << 16 | context[0] << 8 | x for x in range(256)], "u8")
        assert (10 ** s.score(g)).sum() == pytest.approx(1, abs=1e-5)


def test_odd_documents(spark, odd, none):
    got = lm.score(odd, odd.filter(~lm.held_out()), held_out=lm.held_out()).collect()
    assert len(got) == odd.count() and all(r["score"] <= 0 and np.isfinite(r["score"]) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2) for r in got)
    assert lm.score(none, odd).count() == 0
    empty = lm.score(odd, none).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in empty)
    assert odd.filter(F.col("text").isNull()).count()
