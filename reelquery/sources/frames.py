"""Frame tables: manifests, vectors, the model and text-recognition boundaries, audits, sinks."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reelquery.functions.formats import clock_millis
from reelquery.functions.vector import norm, normalize
from reelquery.operators.numbering import numbered
from reelquery.schemas import FRAMES, MANIFEST, OCR_TEXT
from reelquery.sources.versions import Published

DIMENSION = 512
SAMPLING_SECONDS = 2


def manifest_rows(paths: DataFrame, media: DataFrame, seconds: int = SAMPLING_SECONDS) -> DataFrame:
    """One row a frame of (media_id, image_path): number by path, time, and the media item's fields."""
    rows = numbered(paths.select("media_id", "image_path"), [F.col("image_path")], "_n", ["media_id"])
    t = (F.col("_n") - 1) * seconds
    rows = rows.select("media_id", F.format_string("%06d", "_n").alias("frame_id"), t.cast("int").alias("timestamp_seconds"), clock_millis(t).alias("timestamp_formatted"), "image_path")
    fields = media.select(F.col("id").alias("media_id"), "title", "type", "season", "episode", "episode_title", F.col("video_path").alias("source_video"))
    return fields.join(rows, "media_id")


def manifests(rows: DataFrame, seconds: int = SAMPLING_SECONDS) -> DataFrame:
    """One row a media item with its frames as an array."""
    head = ["media_id", "title", "type", "season", "episode", "episode_title", "source_video"]
    frame = F.struct("frame_id", "timestamp_seconds", "timestamp_formatted", "image_path")
    return rows.groupBy(*head).agg(F.lit(seconds).alias("sampling_interval_seconds"), F.count("*").cast("int").alias("frame_count"), F.sort_array(F.collect_list(frame)).alias("frames"))


def load_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def exploded(manifest: DataFrame) -> DataFrame:
    return manifest.select("media_id", "title", "type", "season", "episode", "episode_title", F.explode("frames").alias("f")).select("*", "f.*").drop("f")


def frame_directory(kind: Column, title: Column, season: Column, episode: Column) -> Column:
    """series/title/S01/E02, or type/title."""
    return F.when(kind == "series", F.concat(F.lit("series/"), title, F.format_string("/S%02d/E%02d", season, episode))).otherwise(F.concat(kind, F.lit("/"), title))


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def first_paths(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("media_id", "image_path").limit(n)


EXTRACT_COMMAND = ("ffmpeg", "-v", "error", "-i", "{video}", "-vf", "fps=1/{seconds}", "-q:v", "2", "{directory}/%06d.jpg")
GRAB_COMMAND = ("ffmpeg", "-v", "error", "-ss", "{time}", "-i", "{video}", "-frames:v", "1", "-f", "image2pipe", "-c:v", "mjpeg", "-")


def extracted(videos: DataFrame, extract: Callable[[str, str], list[str]] | None = None, seconds: int = SAMPLING_SECONDS) -> DataFrame:
    """media_id, image_path of the frames that ``extract`` (video_path, directory) writes; by default a frame
    each two seconds by an external program. ``videos``: media_id, video_path, directory; what is done already
    is left out with ``missing`` beforehand."""

    def run(video: str, directory: str) -> list[str]:
        os.makedirs(directory, exist_ok=True)
        subprocess.run([a.format(video=video, directory=directory, seconds=seconds) for a in EXTRACT_COMMAND], check=True)
        return sorted(os.path.join(directory, f) for f in os.listdir(directory) if f.endswith(".jpg"))

    one = extract or run

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for media, video, directory in b.itertuples(index=False):
                paths = one(video, directory)
                yield pd.DataFrame({"media_id": [media] * len(paths), "image_path": paths})

    return videos.select("media_id", "video_path", "directory").mapInPandas(frames, "media_id string, image_path string")


def grabbed(clips: DataFrame, grab: Callable[[str, float], bytes] | None = None) -> DataFrame:
    """``clips`` (clip_id, video_path, times) as one row a time: clip_id, step, time, image, the encoded frame there."""

    def run(video: str, time: float) -> bytes:
        return subprocess.run([a.format(video=video, time=time) for a in GRAB_COMMAND], check=True, capture_output=True).stdout

    one = grab or run

    def images(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for videos, times in batches:
            yield pd.Series([one(v, t) for v, t in zip(videos, times, strict=True)])

    each = clips.select("clip_id", "video_path", F.posexplode("times").alias("step", "time"))
    return each.withColumn("image", F.pandas_udf(images, "binary")("video_path", "time")).drop("video_path")


def decoded(rows: DataFrame, decode: Callable[[bytes], np.ndarray], column: str = "image") -> DataFrame:
    """``rows`` with height, width and rgb, three bytes a pixel, by a function from encoded bytes to an array."""

    def pixels(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            arrays = [np.asarray(decode(v), "u1") for v in values]
            yield pd.DataFrame({"height": [a.shape[0] for a in arrays], "width": [a.shape[1] for a in arrays], "rgb": [a[..., :3].tobytes() for a in arrays]})

    return rows.withColumn("_p", F.pandas_udf(pixels, "height int, width int, rgb binary")(column)).select("*", "_p.*").drop("_p")


Encoder = Callable[[list], np.ndarray]


def encoded(rows: DataFrame, load: Callable[[], Encoder], column: str = "image_path", batch: int = 16) -> DataFrame:
    """``rows`` with embedding: unit vectors by an encoder that ``load`` makes once for each worker; it takes a list of
    at most ``batch`` values and returns a matrix. A failing model fails its task; no rows give none."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for values in batches:
            out: list = []
            for at in range(0, len(values), batch):
                m = np.asarray(encode(values.iloc[at : at + batch].tolist()), "f4")
                out.extend(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
            yield pd.Series(out)

    run = F.pandas_udf(vectors, "array<float>")
    return rows.withColumn("embedding", run(column))


def encoded_timed(rows: DataFrame, load: Callable[[], Encoder], column: str = "image_path", batch: int = 16) -> DataFrame:
    """As ``encoded``, for ``metrics.Measured``: with began, ended, batch (its size) and failed. A batch that the model fails on is
    tried value by value, and a value that it fails on has a null embedding."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = load()

        def unit(values: list) -> list:
            m = np.asarray(encode(values), "f4")
            return list(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))

        def one(value) -> np.ndarray | None:
            try:
                return unit([value])[0]
            except Exception:  # noqa: BLE001  whatever a model throws
                return None

        for values in batches:
            out: list = []
            for at in range(0, len(values), batch):
                part, began = values.iloc[at : at + batch].tolist(), time.time()
                try:
                    found = unit(part)
                except Exception:  # noqa: BLE001
                    found = [one(v) for v in part]
                out.extend((v, began, time.time(), len(part), v is None) for v in found)
            yield pd.DataFrame(out, columns=["embedding", "began", "ended", "batch", "failed"])

    run = F.pandas_udf(vectors, "embedding array<float>, began double, ended double, batch int, failed boolean")
    return rows.withColumn("_e", run(column)).select("*", "_e.*").drop("_e")


def recognised(rows: DataFrame, load: Callable[[], Callable[[str], list[str]]], combine: str = "join") -> DataFrame:
    """image_path, ocr_text by a recogniser that ``load`` makes once for each worker and that gives the texts of an
    image's variants. They are joined by newlines without repeats ("join"), by blanks ("space"), or the longest
    is taken ("longest")."""

    @F.pandas_udf("array<string>")
    def variants(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = load()
        for paths in batches:
            yield paths.map(lambda p: [t for t in read(p)])

    texts = F.array_distinct(F.filter(F.transform(F.col("_v"), lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))), lambda t: t != ""))
    longest = F.coalesce(F.element_at(F.array_sort(F.transform(texts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"], F.lit("")) if combine == "longest" else None
    joined = longest if longest is not None else F.array_join(texts, "\n" if combine == "join" else " ")
    return rows.select("image_path", variants("image_path").alias("_v")).select("image_path", joined.alias("ocr_text"))


class OcrCache:
    """Recognised texts by image path, in a folder of parts: each save adds one, which is seen whole or not at all, and
    of an image that was recognised twice the text of the last save counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        """image_path, ocr_text; none if nothing was saved."""
        saved = stored(self.spark, self.path, "image_path string, ocr_text string, saved_at timestamp")
        return saved.groupBy("image_path").agg(F.max_by("ocr_text", F.struct("saved_at", "ocr_text")).alias("ocr_text"))

    def save(self, texts: DataFrame) -> None:
        texts.select("image_path", "ocr_text", F.current_timestamp().alias("saved_at")).write.mode("append").parquet(self.path)

    def get(self, rows: DataFrame, load: Callable[[], Callable[[str], list[str]]], combine: str = "join") -> DataFrame:
        """image_path, ocr_text of ``rows`` (image_path): those that aren't there yet are recognised and saved first."""
        wanted = rows.select("image_path").distinct()
        self.save(recognised(missing(wanted, self.load(), "image_path"), load, combine))
        return self.load().join(wanted, "image_path", "left_semi")


def stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table of a folder, or an empty one where the folder isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def image_variants(rgb: np.ndarray) -> list[np.ndarray]:
    """The three pictures that text is recognised in: the grey one at twice the size, and that in black and white by a
    threshold around each pixel (weighted mean of 31 x 31, less 11) and by the one that parts the histogram best."""
    grey = doubled(np.round(rgb[..., :3].astype("f8") @ (0.299, 0.587, 0.114)))
    around = local_mean(grey, 15)
    return [grey, np.where(grey > around - 11, 255, 0).astype("u1"), np.where(grey > otsu(grey), 255, 0).astype("u1")]


def doubled(grey: np.ndarray) -> np.ndarray:
    """Twice the height and width by cubic convolution (a = -0.75); beyond the border its pixels repeat."""
    grey = grey.astype("f8")
    near = lambda t: (1.25 * t - 2.25) * t * t + 1
    far = lambda t: -0.75 * (((t - 5) * t + 8) * t - 4)
    for axis in (0, 1):
        n = grey.shape[axis]
        at = (np.arange(2 * n) + 0.5) / 2 - 0.5
        low = np.floor(at).astype(int)
        t = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        weights = (far(1 + t), near(t), near(1 - t), far(2 - t))
        grey = sum(w * np.take(grey, np.clip(low + i, 0, n - 1), axis) for i, w in zip((-1, 0, 1, 2), weights, strict=True))
    return np.clip(np.round(grey), 0, 255).astype("u1")


def local_mean(grey: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square around each pixel by a bell curve; beyond the border its pixels repeat."""
    spread = 0.3 * (radius - 1) + 0.8
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / spread) ** 2)
    out = np.pad(grey.astype("f8"), radius, mode="edge")
    for axis in (0, 1):
        n = out.shape[axis] - 2 * radius
        out = sum(w * np.take(out, range(i, i + n), axis) for i, w in enumerate(weights / weights.sum()))
    return out


def otsu(grey: np.ndarray) -> int:
    """The grey value that leaves the greatest variance between what is above it and what isn't."""
    n = np.bincount(grey.ravel(), minlength=256).astype("f8")
    below, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / total - sums) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def global_table(frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """Frames with their unit vectors: (media_id, frame_no) meets (media_id, position from 0)."""
    f = frames.withColumn("_p", F.col("frame_id").cast("int") - 1)
    v = vectors.select("media_id", F.col("position").alias("_p"), normalize("embedding").alias("embedding"))
    return f.join(v, ["media_id", "_p"]).drop("_p")


def unmatched(frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """media_id, frames_without_vector, vectors_without_frame of the items where ``global_table`` leaves rows out."""
    f = frames.select("media_id", (F.col("frame_id").cast("int") - 1).alias("_p"), F.lit(1).alias("_f"))
    v = vectors.select("media_id", F.col("position").alias("_p"), F.lit(1).alias("_v"))
    counts = f.join(v, ["media_id", "_p"], "full").groupBy("media_id").agg(F.count_if(F.col("_v").isNull()).alias("frames_without_vector"), F.count_if(F.col("_f").isNull()).alias("vectors_without_frame"))
    return counts.filter("frames_without_vector + vectors_without_frame > 0")


def save_frames(frames: DataFrame, path: str) -> None:
    """One folder a media item, so that a query for one prunes the rest; only the items written are replaced."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("media_id").parquet(path)


def load_frames(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Stored frames: the last version of a published table, or a folder's. With the ``manifest`` that they were made from (media_id, a row a frame), an item that has more or
    fewer vectors than frames fails the load: positions would no longer say which frame a vector is of."""
    table = Published(spark, path)
    if table.versions():
        rows, wanted = table.read(), spark.createDataFrame([], FRAMES).schema
        rows = rows.select(*((F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted))
    else:
        rows = spark.read.schema(FRAMES).parquet(path)
    return rows if manifest is None else checked(rows, manifest, ["media_id"])


def checked(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """``rows``, if each group ``by`` has as many as in ``wanted``; otherwise an error that names some that differ."""
    have, want = (x.groupBy(*by).agg(F.count("*").alias(n)) for x, n in ((rows, "_have"), (wanted, "_want")))
    differ = have.join(want, by, "full").filter("NOT _have <=> _want").limit(5).collect()
    if differ:
        raise ValueError(f"counts differ: {[tuple(r) for r in differ]}")
    return rows


def save_table(rows: DataFrame, path: str, by: str = "media_id") -> None:
    """Fingerprints or prototypes, one folder a media item; only the items written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load_table(spark: SparkSession, path: str, schema: str, sizes: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """What ``save_table`` stored; with ``sizes`` (``by`` and n) each group must have as many rows as it says."""
    rows = spark.read.schema(schema).parquet(path)
    by = by or ["media_id"]
    if sizes is None:
        return rows
    return checked(rows, sizes.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), by)


def index_new(frames: DataFrame, path: str, load: Callable[[], Encoder], column: str = "image_path") -> DataFrame:
    """Encodes the frames of media items that the published table at ``path`` doesn't have yet, publishes them as its next
    version and returns that. Readers keep the version they opened; a run that was broken off publishes nothing, and the
    next one encodes its items again."""
    table = Published(frames.sparkSession, path)
    kept = frames.select(*(c for c in frames.columns if c != "embedding"))
    new = missing(kept, table.items(), "media_id") if table.versions() else kept
    if not new.isEmpty():
        table.publish(encoded(new, load, column))
    return table.read() if table.versions() else encoded(new, load, column)


def manifest_from_images(media: DataFrame, images: DataFrame, seconds: int = SAMPLING_SECONDS) -> DataFrame:
    """Manifests of media whose frames exist already: ``images`` (media_id, image_path) are numbered by path."""
    return manifests(manifest_rows(images.filter(F.lower("image_path").endswith(".jpg")), media, seconds), seconds)


def audit(media: DataFrame, frames: DataFrame, vectors: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """media_id, frames, vectors, odd_vectors, problem: what keeps an item from being indexed; null: nothing.

    ``media``: media_id, one row an item (repeated ids are a problem); ``vectors``: media_id, embedding.
    """
    m = media.groupBy("media_id").agg(F.count("*").alias("_items"))
    f = frames.groupBy("media_id").agg(F.count("*").alias("frames"))
    odd = F.coalesce((F.size("embedding") != dimension) | (F.abs(norm("embedding") - 1) > 1e-3), F.lit(True))
    v = vectors.groupBy("media_id").agg(F.count("*").alias("vectors"), F.count_if(odd).alias("odd_vectors"))
    all_ = m.join(f, "media_id", "full").join(v, "media_id", "full").fillna(0, ["_items", "frames", "vectors", "odd_vectors"])
    problem = F.when(F.col("_items") == 0, "unknown media").when(F.col("_items") > 1, "repeated media id").when(F.col("frames") == 0, "no frames").when(F.col("vectors") == 0, "no vectors").when(F.col("frames") != F.col("vectors"), "counts differ").when(F.col("odd_vectors") > 0, "odd vectors")
    return all_.select("media_id", "frames", "vectors", "odd_vectors", problem.alias("problem"))


def failure_report(ranks: DataFrame, rows: DataFrame, path: str) -> None:
    """Queries whose truth isn't first, with what was found, as JSON."""
    rows.join(ranks.filter("truth_rank IS NULL OR truth_rank > 1"), "query_id").write.mode("overwrite").json(path)


