import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelquery.llm import resample
from tables import SF


def slow_features(text, most=3):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return len(w), [zlib.crc32(b" ".join(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1)]


def slow(docs, target, percent=5):
    parts = [slow_features(t) for _, t in docs]
    s = Counter(c % 10000 for _, f in parts for c in f)
    t = Counter(c % 10000 for _, text in target for c in slow_features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for (d, _), (n, f) in zip(docs, parts, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % 10000] for c in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted(map(tuple, rows), key=repr)


def test_odd_documents(spark, odd, none, texts):
    target = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, "word1 word2 word3")], "item_id long, text string")
    want = slow(texts, [tuple(r) for r in target.collect()], 40)
    assert sorted(map(tuple, resample.resampled(odd, target, percent=40).collect()), key=repr) == want
    assert any(r[4] for r in want)
    assert resample.resampled(none, target).count() == 0
    assert sorted(map(tuple, resample.resampled(odd, target.limit(0)).collect()), key=repr) == slow(texts, [])
    assert {r["rank"] for r in resample.drawn(odd, target, percent=40).collect()} == {r[4] for r in want if r[4]}


def test_as_sql(spark, same_as_sql):
    same_as_sql(resample.op12_target_resampling(spark, SF), resample.SQL)


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 21])
def test_features_don_t_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    texts = ["Hello World foo bar", "", "a", "É it's x", "x " * 40 + "y" * 1000 + " b", "ends", "begins", "!!", "z" * 65 + " " + "q" * 64 + "-" + "r" * 129]
    column = pa.array(["left out", *texts]).slice(1)
    got, words = Counter(), np.zeros(len(texts), int)
    for row, crc, of_words in resample.features(column):
        got.update(zip(row.tolist(), crc.tolist(), strict=True))
        words += np.bincount(of_words, minlength=len(texts))
    assert got == Counter((i, c) for i, t in enumerate(texts) for c in slow_features(t)[1])
    assert words.tolist() == [slow_features(t)[0] for t in texts]


def test_copies_of_one_text_are_ranked_apart(spark):
    """Two thirds of the rows have one text; scores tie in part and go by id."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "many words " * 12).otherwise(F.concat(F.lit("other " * 20), F.col("id"))).alias("text")).repartition(9)
    target = spark.createDataFrame([(1, "many words")], "item_id long, text string")
    assert sorted(map(tuple, resample.resampled(docs, target, percent=50).collect()), key=repr) == slow([tuple(r) for r in docs.collect()], [(1, "many words")], 50)
