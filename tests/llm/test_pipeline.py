import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tables import SF
from reelquery.llm import classifier, packing
from reelquery.llm.common import staged
from test_linededup import slow as slow_lines
from test_mixing import count
from test_packing import check
from test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, lines, unique, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r["doc_id"] for r in classifier.classify(docs, labels, F.col("source"), F.col("lang")).filter("keep").collect()}
    first = [(r["doc_id"], r["text"]) for r in quality.collect()]
    assert {d for d, _ in first} == keep
    assert not keep & {r["doc_id"] for r in labels.filter("quality = 0").collect()} or len(keep) > 150
    want = {(d, t) for d, t, e, n in slow_lines(first) if t is None or e + n == 0 or t.strip(" \t\n\r\x0b\x0c")}
    second = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert set(second) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    comp = slow_components([slow_fingerprint(t) for _, t in second], [d for d, _ in second])
    third = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert {d for d, _ in third} == set(comp) and len(third) == len(set(comp)) and set(third) <= set(second)
    fourth = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert set(fourth) <= set(third) and abs(sum(count(t) for _, t in fourth) / sum(count(t) for _, t in third) - 1) < 0.3
    check(packed.collect(), fourth, packing.WINDOW, packing.tokenizer_path())


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    assert key(got) == key(stages[-1])


def test_without_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
