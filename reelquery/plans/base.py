"""The views that queries and their SQL share: frames, clips, hits, subtitle entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquery.operators.knn import leaks, nearest
from reelquery.operators.numbering import numbered
from reelquery.operators.temporal import offsets

#: Every hundredth vector is a query.
QUERY = 100
STEPS = [-2, -1, 0, 1, 2]
WIDE_STEPS = [-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Frame tables that this process has stored, by application, folder and state of the folder's files.
_STORED: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do: their number and size, and when the folder or the file was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.getContentSummary(at)
    return files.getFileCount(), files.getLength(), fs.getFileStatus(at).getModificationTime()


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of ten media items, two seconds apart; the last three items are films.

    The frame table is made once per application and state of the input, as an extraction run would: dealt by ranges of
    item and vector, numbered, and stored, so that no query sorts or numbers vectors again.
    """
    path = f"{sf_dir}/embeddings.parquet"
    key = (spark.sparkContext.applicationId, path, *_state(spark, path))
    if key not in _STORED:
        e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
        _STORED[key] = numbered(e, [F.col("vec_id")], "frame_no", ["label"])
    media = F.concat(F.lit("media_"), F.lpad(F.col("label").cast("string"), 2, "0"))
    is_series = F.col("label") < 7
    n = F.col("frame_no").cast("int")
    return _STORED[key].select("vec_id", media.alias("media_id"), F.when(is_series, (1 + F.col("label") % 2).cast("int")).alias("season"), F.when(is_series, (1 + F.col("label")).cast("int")).alias("episode"), n.alias("frame_no"), (2.0 * (n - 1)).alias("ts"), "embedding")


def queries(fr: DataFrame) -> DataFrame:
    return fr.filter(F.col("vec_id") % QUERY == 0)


def named(fr: DataFrame) -> DataFrame:
    """Queries as the search takes them."""
    return queries(fr).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("self_id"), "media_id", "embedding")


def hits(fr: DataFrame, k: int = 50) -> DataFrame:
    """query_id, vec_id, sim, rank and the frame's fields: the k nearest frames but the query's own."""
    return nearest(fr, named(fr), k).join(fr.drop("embedding"), "vec_id")


def clip_frames(fr: DataFrame, steps: list[int] = STEPS) -> DataFrame:
    """query_id, step and the frames of each query's clip; steps beyond the item are left out."""
    return offsets(queries(fr).withColumn("query_id", F.col("vec_id")), fr, steps, keep_missing=False)


def clip_hits(fr: DataFrame, k: int = 20, seconds: float = 6.0) -> DataFrame:
    """Hits of each clip frame (step), without what shows the query's own moment: taken out after the top k."""
    asked = clip_frames(fr).select((F.col("query_id") * 10 + F.col("step") + 2).alias("query_id"), F.lit(None).cast("long").alias("self_id"), "embedding")
    found = nearest(fr, asked, k, exclude_self=False)
    found = found.select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), (F.col("query_id") % 10 - 2).cast("int").alias("step"), "vec_id", "sim", "rank")
    own = queries(fr).select(F.col("vec_id").alias("query_id"), F.col("media_id").alias("_m"), F.col("ts").alias("_t"))
    rows = found.join(fr.drop("embedding"), "vec_id").join(own, "query_id")
    return rows.filter(~leaks(F.col("media_id"), F.col("ts"), F.col("_m"), F.col("_t"), seconds)).drop("_m", "_t")


def clip_sizes(fr: DataFrame) -> DataFrame:
    return clip_frames(fr).groupBy("query_id").agg(F.count("*").alias("clip_frames"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitles: an entry of three seconds every four."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("entry_no"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 3.0).alias("end"), "text")


# The same views in SQL.
FRAMES_SQL = """
fr AS (SELECT vec_id, 'media_' || lpad(CAST(label AS VARCHAR), 2, '0') AS media_id,
         CASE WHEN label < 7 THEN CAST(1 + label % 2 AS INTEGER) END AS season,
         CASE WHEN label < 7 THEN CAST(1 + label AS INTEGER) END AS episode,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS frame_no,
         CAST(2 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS DOUBLE) AS ts,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qu AS (SELECT * FROM fr WHERE vec_id % 100 = 0)"""
HITS_SQL = FRAMES_SQL + """,
allsims AS (SELECT q.vec_id AS query_id, f.* EXCLUDE (v), list_dot_product(q.v, f.v) AS sim FROM qu q JOIN fr f ON q.vec_id <> f.vec_id),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM allsims),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, vec_id) AS r FROM ranks WHERE rank <= 50)"""
CLIP_SQL = FRAMES_SQL + """,
steps AS (SELECT CAST(unnest([-2, -1, 0, 1, 2]) AS INTEGER) AS step),
clip AS (SELECT q.vec_id AS query_id, q.media_id AS qm, q.ts AS qt, s.step, f.v FROM qu q CROSS JOIN steps s JOIN fr f ON f.media_id = q.media_id AND f.frame_no = q.frame_no + s.step),
sizes AS (SELECT query_id, count(*) AS clip_frames FROM clip GROUP BY query_id),
clipsims AS (SELECT c.query_id, c.step, c.qm, c.qt, f.* EXCLUDE (v), list_dot_product(c.v, f.v) AS sim FROM clip c CROSS JOIN fr f),
clipranks AS (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY sim DESC, vec_id) AS rank FROM clipsims),
chits AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, vec_id, step) AS r
          FROM clipranks WHERE rank <= 20 AND NOT (media_id = qm AND abs(ts - qt) <= 6))"""
ENTRIES_SQL = """
en AS (SELECT conv_id AS media_id, turn AS entry_no, CAST(turn * 4 AS DOUBLE) AS s, CAST(turn * 4 + 3 AS DOUBLE) AS e, text FROM conversations)"""


def d(x: float) -> str:
    """A number as a double in SQL, where a bare one would be a decimal."""
    return f"CAST({x} AS DOUBLE)"


def six(c: str) -> F.Column:
    """Scores are compared to six decimals."""
    return F.round(c, 6).alias(c)
