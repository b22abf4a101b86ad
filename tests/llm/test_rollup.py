import uuid

from pyspark.sql import functions as F

from tables import SF
from reelquery.llm import rollup
from reelquery.llm.common import shared_dir

KIND = "source string, lang string, tokenizer_version string, n_tokens long, sign int, doc_id long"


def totals(r):
    return {(x["source"], x["lang"], x["tokenizer_version"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}


def test_batches(spark):
    r = rollup.Rollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    assert totals(r) == {}
    first = spark.createDataFrame([("a", "en", "v1", 5, 1, 1), ("a", "en", "v1", 7, 1, 2), (None, None, "v1", None, 1, 3), ("b", "fr", "v1", 4, None, 4)], KIND)
    assert r.commit("one", first) and not r.commit("one", first)
    assert totals(r) == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 0)}
    revised = spark.createDataFrame([("a", "en", "v1", 5, -1, 1), ("a", "en", "v2", 6, 1, 1)], KIND)
    r.commit("two", revised)
    assert totals(r) == {("a", "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (1, 0)}
    r.commit("empty", first.limit(0))
    r.commit("three", spark.createDataFrame([("a", "en", "v1", 7, -1, 2)], KIND))
    before = totals(r)
    assert ("a", "en", "v1") not in before
    r.compact()
    assert totals(r) == before and len(r._live(r.commits.all())) == 1
    assert not r.commit("two", revised) and totals(r) == before
    r.commit("four", first)
    assert totals(r)["a", "en", "v1"] == (2, 12)


def test_sums_without_a_commit_are_not_read(spark):
    r = rollup.Rollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    rows = spark.createDataFrame([("a", "en", "v1", 5, 1, 1)], KIND)
    r.commit("one", rows)
    rows.select("source", "lang", "tokenizer_version", F.lit(9).cast("long").alias("n_docs"), "n_tokens").write.parquet(f"{r.path}/sums/two-failed")
    assert totals(r) == {("a", "en", "v1"): (1, 5)}


def test_counts(spark, odd, none, texts):
    import public_tokenizers

    known = rollup.encoding(public_tokenizers.path(f"{rollup.FIRST}.tiktoken"), public_tokenizers.PATTERN)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in rollup.counted(odd, rollup.FIRST, "doc_id").collect()), key=repr)
    assert got == sorted(((d, len(known.encode_ordinary(t or ""))) for d, t in texts), key=repr)
    assert rollup.counted(none, rollup.FIRST, "doc_id").count() == 0


def test_query(spark):
    import public_tokenizers
    import pandas as pd

    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs[~docs.doc_id.isin(labels[labels.toxic == 1].doc_id)]
    enc = {v: rollup.encoding(public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN) for v in (rollup.FIRST, rollup.SECOND)}
    want = {}
    for r in docs.itertuples():
        v = rollup.FIRST if r.lang == "en" else rollup.SECOND
        n, t = want.get((r.source, r.lang, v), (0, 0))
        want[r.source, r.lang, v] = (n + 1, t + len(enc[v].encode_ordinary(r.text)))
    assert {(x["source"], x["lang"], x["tokenizer_version"]): (x["n_docs"], x["n_tokens"]) for x in rollup.op6_token_rollup(spark, SF).collect()} == want


def test_racing_writers(spark):
    """Writers that have all found the batch missing, and folds of the same commits: one of each counts."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = lambda n: spark.createDataFrame([("a", "en", "v1", n, 1, 1)], KIND)
    writers = [rollup.Rollup(spark, path) for _ in range(4)]
    sums = rows(5).select("source", "lang", "tokenizer_version", F.lit(1).cast("long").alias("n_docs"), "n_tokens")
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(lambda w: w._put(w._name("one"), sums, [], "one"), writers)) == 1
        assert sum(pool.map(lambda w: w.commit("two", rows(7)), writers)) == 1
    assert totals(writers[0]) == {("a", "en", "v1"): (2, 12)}
    found = writers[0].commits.all()
    live = sorted(writers[0]._live(found))
    with ThreadPoolExecutor(4) as pool:  # all fold what all have seen
        assert sum(pool.map(lambda w: w._put("fold-000000001", w._summed(w._live(found)), live), writers)) == 1
    assert totals(writers[1]) == {("a", "en", "v1"): (2, 12)} and not writers[1].compact()
    assert writers[2].commit("three", rows(1)) and writers[3].compact() and not writers[3].commit("one", rows(5))
    assert totals(writers[0]) == {("a", "en", "v1"): (3, 13)}
    with ThreadPoolExecutor(4) as pool:
        writers[0].commit("four", rows(1))
        assert sum(pool.map(lambda w: w.compact(), writers)) >= 1
    assert totals(writers[0]) == {("a", "en", "v1"): (4, 14)}


def test_folds_retire_what_they_replace(spark):
    """Five batches and two folds leave one commit file; names stay known, also to a writer that comes late."""
    r = rollup.Rollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    rows = lambda n: spark.createDataFrame([("a", "en", "v1", n, 1, 1)], KIND)
    for i in range(3):
        r.commit(f"b{i}", rows(i))
    assert r.compact() and list(r.commits.all()) == ["fold-000000001"]
    for i in range(3, 5):
        r.commit(f"b{i}", rows(i))
    assert len(r.commits.all()) == 3 and r.compact() and list(r.commits.all()) == ["fold-000000002"]
    assert totals(r) == {("a", "en", "v1"): (5, 10)}
    assert not any(r.commit(f"b{i}", rows(9)) for i in range(5)) and totals(r) == {("a", "en", "v1"): (5, 10)}
    # a writer that looked for its batch before all this
    sums = rows(9).select("source", "lang", "tokenizer_version", F.lit(1).cast("long").alias("n_docs"), "n_tokens")
    assert r._put(r._name("b1"), sums, [], "b1") and r._put(r._name("b4"), sums, [], "b4")
    assert totals(r) == {("a", "en", "v1"): (5, 10)} and not r.compact()
    r.vacuum()
    assert totals(r) == {("a", "en", "v1"): (5, 10)}
    assert r.commit("b5", rows(1)) and r.compact() and totals(r) == {("a", "en", "v1"): (6, 11)}
    assert list(r.commits.all()) == ["fold-000000003"] and not r.commit("b1", rows(1)) and not r.commit("b4", rows(1))
