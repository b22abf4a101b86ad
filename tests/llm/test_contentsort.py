import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelquery.llm import contentsort
from tables import SF


def slow(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, size, kept, sha)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")].append(d)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda d: (d is None, -(d or 0)))
        out += [(d, ids[0], len(ids), i == 0, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_documents(odd, none, texts):
    assert found(contentsort.exact_groups(odd)) == slow(texts)
    assert contentsort.exact_groups(none).count() == 0 and contentsort.deduped(none).count() == 0
    kept = contentsort.deduped(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r[0]) for r in slow(texts) if r[3])


def test_as_sql(spark, same_as_sql):
    same_as_sql(contentsort.op11_content_sort(spark, SF), contentsort.SQL)


@pytest.mark.parametrize("parts", [1, 40])
def test_groups_run_over_many_ranges(spark, parts):
    """A third of the rows is one text, another has copies that differ in case; short and empty texts tie by the hundred."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        text = F.expr("CASE id % 6 WHEN 0 THEN 'the Same text' WHEN 3 THEN 'The same TEXT' WHEN 1 THEN '' WHEN 2 THEN concat('x', id % 50) WHEN 4 THEN repeat('Ä very long line ', 300) || (id % 4) ELSE NULL END")
        docs = spark.range(3000).select(F.expr("IF(id % 97 = 0, NULL, id * 31 % 2003)").alias("doc_id"), text.alias("text")).repartition(7)
        assert found(contentsort.exact_groups(docs)) == slow([tuple(r) for r in docs.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hashes_that_collide(spark, monkeypatch):
    """With one hash for all, only the full comparison tells texts apart."""
    monkeypatch.setattr(contentsort.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("same head " * 10), F.col("id") % 7).alias("text")).repartition(5)
    assert found(contentsort.sorted_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")))) == slow([tuple(r) for r in docs.collect()])


def test_only_letters_of_ascii_are_folded(spark):
    docs = spark.createDataFrame([(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "ÄB "), (5, "ab\n"), (6, "AB\n")], "doc_id long, text string")
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in contentsort.exact_groups(docs).collect()} == {1: (3, False), 3: (3, True), 2: (2, True), 4: (4, True), 5: (6, False), 6: (6, True)}
    assert {r["doc_id"] for r in contentsort.deduped(docs).collect()} == {2, 3, 4, 6}
