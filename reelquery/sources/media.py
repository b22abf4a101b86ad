"""Scans of media folders, sidecar files and probe reports."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelquery.functions.formats import episode_numbers, media_id, rational, safe_id
from reelquery.schemas import MEDIA, VIDEO_INFO

# The following are fixed values.
EXTENSIONS = (".mkv", ".mp4", ".avi", ".mov", ".webm", ".flv")
PROBE_COMMAND = ("ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def with_subtitles(videos: DataFrame, files: DataFrame) -> DataFrame:
    """``videos`` with subtitle_path: the .srt beside a video that has its name, or null."""
    base = lambda p: F.regexp_replace(p, r"\.[^./]+$", "")
    srt = files.filter(F.lower("path").endswith(".srt")).groupBy(base(F.col("path")).alias("_base")).agg(F.min("path").alias("subtitle_path"))
    return videos.join(srt, base(F.col("video_path")) == F.col("_base"), "left").drop("_base")


def movies(files: DataFrame, kind: str) -> DataFrame:
    """Films of a category folder: <kind>/<title>/<file>; several files of one title share an id, which the audit tells."""
    path = F.col("path")
    title = F.regexp_extract(path, rf"/{kind}/([^/]+)/[^/]+$", 1)
    rows = files.filter(is_video(path) & (title != "")).withColumn("title", title)
    return rows.select(safe_id("title").alias("id"), "title", F.lit("animated" if kind == "animated" else "movie").alias("type"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"), F.lit(None).cast("string").alias("episode_title"), F.col("path").alias("video_path"))


def series(files: DataFrame) -> DataFrame:
    """Episodes below series/<title>/, numbered by SxxExx in the file name; files without it are left out."""
    path = F.col("path")
    season, episode = episode_numbers(F.regexp_extract(path, r"([^/]+)$", 1))
    rows = files.filter(is_video(path)).withColumns({"title": F.regexp_extract(path, r"/series/([^/]+)/", 1), "season": season, "episode": episode})
    rows = rows.filter("title <> '' AND season IS NOT NULL")
    return rows.select(media_id("title", "season", "episode").alias("id"), "title", F.lit("series").alias("type"), "season", "episode", F.lit(None).cast("string").alias("episode_title"), F.col("path").alias("video_path"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All films, animated films and episodes below a folder, in catalogue order, with subtitles beside them."""
    files = listing(spark, root)
    found = movies(files, "movies").unionByName(movies(files, "animated")).unionByName(series(files))
    return with_subtitles(found, files).withColumn("video_info", F.lit(None).cast(VIDEO_INFO)).orderBy("type", "title", F.coalesce("season", F.lit(0)), F.coalesce("episode", F.lit(0)))


def parsed_probe(report: Column) -> Column:
    """video_info of a probe report in JSON: the first video stream's size and rate; the number of frames is
    estimated from duration and rate where the report has none."""
    kind = "struct<streams: array<struct<codec_type: string, width: int, height: int, avg_frame_rate: string, r_frame_rate: string, nb_frames: string, duration: string>>, format: struct<duration: string>>"
    r = F.from_json(report, kind)
    video = F.get(F.filter(r["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    fps = F.coalesce(F.nullif(rational(video["avg_frame_rate"]), F.lit(0.0)), rational(video["r_frame_rate"]))
    duration = F.coalesce(r["format"]["duration"].try_cast("double"), video["duration"].try_cast("double"))
    frames = F.coalesce(video["nb_frames"].try_cast("bigint"), F.bround(duration * fps).cast("bigint"))
    return F.struct(duration.alias("duration_seconds"), F.nullif(fps, F.lit(0.0)).alias("fps"), frames.alias("frame_count"), video["width"].alias("width"), video["height"].alias("height"))


def probe_with(command: Callable[[str], str] | None = None):
    """A vectorised function path -> probe report; by default it runs the probe program on the executor."""

    def run(path: str) -> str:
        return subprocess.run([*PROBE_COMMAND, path], capture_output=True, text=True, check=True).stdout

    one = command or run

    @F.pandas_udf("string")
    def reports(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in paths:
            yield batch.map(one)

    return reports


def load(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A catalogue: one JSON list, or with ``lines`` what ``save`` writes, an item a line."""
    return spark.read.schema(MEDIA).json(path, multiLine=not lines)


def by_id(media: DataFrame, id_: str) -> DataFrame:
    """The one item of an id; an error if there is none."""
    found = media.filter(F.col("id") == id_)
    if found.isEmpty():
        raise LookupError(f"no media item {id_!r}")
    return found


def save(media: DataFrame, path: str) -> None:
    media.write.mode("overwrite").json(path)
