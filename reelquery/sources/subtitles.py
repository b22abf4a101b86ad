"""Subtitle files and indexes as rows of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reelquery.functions.formats import episode_numbers_strict, safe_number, srt_seconds
from reelquery.functions.text import subtitle_clean
from reelquery.operators.numbering import numbered
from reelquery.schemas import CONTAINERS, LOOSE_ENTRY
from reelquery.staging import staged


def files(spark: SparkSession, root: str) -> DataFrame:
    """subtitle_file, text: each .srt below a folder as one row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.srt").load(root)
    return raw.select(F.col("path").alias("subtitle_file"), F.decode("content", "UTF-8").alias("text"))


def parsed(text: Column) -> Column:
    """Array of (start, end, text): blocks between blank lines whose first line with an arrow gives the times."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^﻿", "")

    def entry(block: Column) -> Column:
        lines = F.split(block, "\n")
        at = F.array_position(F.transform(lines, lambda line: line.contains("-->")), True).cast("int")
        arrow = F.try_element_at(lines, F.nullif(at, F.lit(0)))
        start = srt_seconds(F.trim(F.split_part(arrow, F.lit("-->"), F.lit(1))))
        end = srt_seconds(F.trim(F.split_part(arrow, F.lit("-->"), F.lit(2))))
        said = F.when(at > 0, subtitle_clean(F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), " ")))
        return F.struct(start.alias("start"), end.alias("end"), said.alias("text"))

    found = F.transform(F.split(plain, r"\n\s*\n"), entry)
    return F.filter(found, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & (F.coalesce(e["text"], F.lit("")) != ""))


def entries(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, entry_no, start, end, text of rows with a text column."""
    return rows.select(*keep, F.posexplode(parsed(F.col("text"))).alias("entry_no", "e")).select(*keep, "entry_no", "e.*")


def index(found: DataFrame, media: DataFrame) -> DataFrame:
    """Entries of subtitle files with the episode that the file's name and folder say, by the media table."""
    name = F.regexp_extract("subtitle_file", r"([^/]+)$", 1)
    season, episode = episode_numbers_strict(name)
    rows = found.withColumns({"_season": season, "_episode": episode})
    on = (F.col("_season") == media["season"]) & (F.col("_episode") == media["episode"]) & F.col("subtitle_file").contains(F.concat(F.lit("/"), media["title"], F.lit("/")))
    return entries(rows.join(media, on).select(F.col("id").alias("media_id"), "season", "episode", "subtitle_file", "text"), "media_id", "season", "episode", "subtitle_file")


def tolerant(report: Column) -> Column:
    """Array of (start, end, text) of a JSON text: a list of entries or an object that holds one under any of the
    usual names, at the top or one level down; entries under any of their usual field names, by start."""
    one = F.from_json(report, f"array<{LOOSE_ENTRY}>")

    def listed(at: str) -> Column:
        found = F.get_json_object(report, at)
        return F.when(F.ltrim(found).startswith("["), F.from_json(found, f"array<{LOOSE_ENTRY}>"))

    flat = F.coalesce(*(listed(f"$.{a}") for a in CONTAINERS))
    deep = F.coalesce(*(listed(f"$.{a}.{b}") for a in CONTAINERS for b in CONTAINERS))
    found = F.when(F.ltrim(report).startswith("["), one).otherwise(F.coalesce(flat, deep))
    rows = F.transform(F.coalesce(found, F.array().cast(f"array<{LOOSE_ENTRY}>")), lambda e: F.struct(F.coalesce(e["start"], e["start_seconds"]).alias("start"), F.coalesce(e["end"], e["end_seconds"], e["start"], e["start_seconds"]).alias("end"), F.coalesce(e["text"], e["content"], e["subtitle"]).alias("text")))
    return F.sort_array(F.filter(rows, lambda e: e["start"].isNotNull() & (F.trim(F.coalesce(e["text"], F.lit(""))) != "")))


def flat_candidates(rows: DataFrame, name: str = "candidate") -> DataFrame:
    """Candidates nested as {similarity, metadata} or flat, as flat rows; clip_similarity may be called similarity."""
    fields = {f.name for f in rows.schema[name].dataType.fields}
    inner = {f.name for f in rows.schema[name].dataType["metadata"].dataType.fields} if "metadata" in fields else set()
    pick = lambda c, kind: F.coalesce(*([F.col(f"{name}.{c}").cast(kind)] if c in fields else []), *([F.col(f"{name}.metadata.{c}").cast(kind)] if c in inner else []), F.lit(None).cast(kind)).alias(c)
    sims = [F.col(f"{name}.{c}").cast("double") for c in ("clip_similarity", "similarity") if c in fields]
    rest = [c for c in rows.columns if c != name]
    return rows.select(*rest, pick("media_id", "string"), pick("season", "int"), pick("episode", "int"), pick("frame_id", "string"), pick("timestamp_seconds", "double"), F.coalesce(*sims, F.lit(0.0)).alias("sim"))


def seconds_or(x: Column, default: float = 0.0) -> Column:
    return safe_number(x, default)


# The following are fixed values: names under which an item's id may stand, in order of precedence.
ID_NAMES = ("media_id", "id", "episode_id")


def _entry(node: Column) -> Column:
    """The entry that a variant object is: start, end and text under any of their names; null without two times."""
    text = lambda *names: F.coalesce(*(F.try_variant_get(node, f"$.{n}", "string") for n in names))
    time = lambda *names: text(*names).try_cast("double")
    start, end = time("start", "start_seconds"), time("end", "end_seconds")
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"), F.coalesce(text("text", "content", "subtitle"), F.lit("")).alias("text")))


def _is(node: Column, what: str) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith(what), F.lit(False))


def nested_entries(rows: DataFrame, node: str, *keep: str) -> DataFrame:
    """``keep``, start, end, text: the entries in a variant column of any nesting.

    A list holds entries, other items in it are passed over. An object gives what the first of the usual container names
    gives that gives anything; without such, itself if it is an entry; otherwise what all of its other values give. Objects
    are opened level by level, all rows at once, until none is left; which alternatives count is then decided
    from the top, so that the depth of a text is bounded by nothing but the number of levels worked through.
    """
    now = rows.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(node).alias("_node"), F.array().cast("array<string>").alias("_path"))
    now = staged(now, "subtitle-level")
    found, depth = None, 0
    while True:
        lists = now.filter(_is(F.col("_node"), "ARRAY")).withColumn("_e", F.explode(F.col("_node").cast("array<variant>"))).filter(_is(F.col("_e"), "OBJECT")).withColumn("_e", _entry(F.col("_e")))
        objects = now.filter(_is(F.col("_node"), "OBJECT"))
        selves = objects.withColumn("_e", _entry(F.col("_node"))).withColumn("_path", F.concat("_path", F.array(F.lit(f"{len(CONTAINERS)}:"))))
        level = lists.select("_row", *keep, "_path", "_e").union(selves.select("_row", *keep, "_path", "_e")).filter("_e IS NOT NULL")
        found = level if found is None else found.union(level)
        children = objects.select("_row", *keep, "_path", F.explode(F.col("_node").cast("map<string,variant>")).alias("_key", "_node"))
        place = F.coalesce(F.array_position(F.array(*map(F.lit, CONTAINERS)), F.col("_key")), F.lit(0))
        step = F.when(place > 0, F.concat((place - 1).cast("string"), F.lit(":"))).otherwise(F.concat(F.lit(f"{len(CONTAINERS) + 1}:"), F.col("_key")))
        now = staged(children.filter(_is(F.col("_node"), "OBJECT") | _is(F.col("_node"), "ARRAY")).select("_row", *keep, "_node", F.concat("_path", F.array(step)).alias("_path")), "subtitle-level")
        depth += 1
        if now.isEmpty():
            break
    found = staged(found, "subtitle-entries")
    for at in range(1, depth + 1):  # at each object only the alternatives of least number stay
        rank = F.split_part(F.get("_path", F.lit(at - 1)), F.lit(":"), F.lit(1)).cast("int")
        least = F.min(rank).over(Window.partitionBy("_row", F.slice("_path", 1, at - 1)))
        found = found.withColumns({"_rank": rank, "_least": least}).filter("_rank IS NULL OR _rank = _least")
    return found.select(*keep, "_e.*")


def subtitle_index(texts: DataFrame) -> DataFrame:
    """media_id, entry_no, start, end, text of subtitle indexes: ``texts`` has a JSON text a row, either an object of a value
    for each media id or a list of objects that name theirs; values may be nested in any way (``nested_entries``).
    An item's entries are numbered by start. What isn't JSON, or no object or list, has none."""
    root = texts.select(F.try_parse_json("text").alias("_root"))
    named = root.filter(_is(F.col("_root"), "OBJECT")).select(F.explode(F.col("_root").cast("map<string,variant>")).alias("media_id", "_node"))
    each = root.filter(_is(F.col("_root"), "ARRAY")).select(F.explode(F.col("_root").cast("array<variant>")).alias("_node")).filter(_is(F.col("_node"), "OBJECT"))
    ids = F.coalesce(*(F.nullif(F.try_variant_get("_node", f"$.{n}", "string"), F.lit("")) for n in ID_NAMES))
    listed = each.select(ids.alias("media_id"), "_node").filter("media_id IS NOT NULL")
    rows = nested_entries(named.union(listed), "_node", "media_id")
    order = [F.col("start"), F.col("end"), F.col("text")]
    return numbered(rows, order, "entry_no", ["media_id"]).withColumn("entry_no", F.col("entry_no") - 1).select("media_id", "entry_no", "start", "end", "text")


def load_subtitle_index(spark: SparkSession, path: str) -> DataFrame:
    """``subtitle_index`` of the .json files at a path, each read whole."""
    return subtitle_index(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))
