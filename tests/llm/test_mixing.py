import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tables import SF
from reelquery.llm import mixing


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, most=3):
    """Targets by the rule itself: share, stop, share the excess again."""
    total, out, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            return out
        for i in over:
            out[i] = float(most * sizes[i])
        open_ -= over
    return out


def test_sql(spark, same_as_sql):
    same_as_sql(mixing.op1_source_mix(spark, SF), mixing.SQL)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
@settings(max_examples=8, deadline=None)
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(rows).orderBy("source").collect()]
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, want))


def test_odd_documents(spark, odd, none, texts):
    got = mixing.mix(odd).collect()
    again = mixing.mix(odd.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert sorted((r["size"] for r in got)) == sorted(count(t) for _, t in texts)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0 for r in got), key
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    most = {r["source"]: 0 for r in got}
    for r in got:
        most[r["source"]] = max(most[r["source"]], r["size"])
    for source, biggest in most.items():
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 2 * biggest  # equal rows are taken alike


def test_repeated_keeps_columns_and_counts(spark, odd):
    got = mixing.repeated(odd)
    assert got.columns == odd.columns
    assert got.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]


def test_other_cycle_and_weight(spark, odd):
    got = mixing.mix(odd.filter("size IS NOT NULL"), weight=F.lit(1.0), cycle=(1,), max_epochs=2)
    assert all(r["taken"] <= 2 * r["size"] for r in got.collect())
