import pytest
from pyspark.sql import functions as F

from reelquery.operators.numbering import numbered


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_equal_a_window_even_where_one_group_holds_most_rows(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, F.col("id") % 7).alias("g"))
        for by in (["g"], []):
            got = {(r["g"], r["k"]): r["n"] for r in numbered(rows, [F.col("k").desc()], "n", by).collect()}
            groups = {}
            for r in rows.collect():
                groups.setdefault(r["g"] if by else 0, []).append((r["k"], r["g"]))
            want = {(g, k): i for members in groups.values() for i, (k, g) in enumerate(sorted(members, key=lambda x: -x[0]), 1)}
            assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_group_runs_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).withColumn("g", F.lit(None).cast("string"))
        out = numbered(rows, [F.col("id")], "n", ["g"])
        assert out.filter("n <> id + 1").count() == 0 and out.count() == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty(spark):
    assert numbered(spark.range(0), [F.col("id")]).collect() == []


def test_the_frame_table_follows_its_files(spark, tmp_path):
    from reelquery.plans import base

    rows = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    path = f"file://{tmp_path}"
    rows.filter("vec_id < 20").write.parquet(f"{path}/embeddings.parquet")
    first = base.frames(spark, path)
    assert first.count() == 20 and base.frames(spark, path).inputFiles() == first.inputFiles()
    rows.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    got = {(r["media_id"], r["frame_no"], r["ts"]): r["vec_id"] for r in base.frames(spark, path).collect()}
    assert len(got) == 40 and got["media_01", 3, 4.0] == 7 and got["media_00", 14, 26.0] == 39
