"""Exact dedup by a content sort.

Texts, lower-cased in A-Z, are range-partitioned by their bytes and sorted externally within each range, so equal ones
stand side by side; neighbours whose hashes agree are compared in full, and each run of equal texts keeps the row with the
largest doc_id. Splitters are sampled from bounded keys: the text's head, its hash, then the id. So a group of copies of
any size runs over as many ranges as its rows need, and a range's runs at its two ends, the only ones that may go on
elsewhere, are put together afterwards by their full text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import field, hinted, sealed, staged, table, unsealed
from .strings import flat, lowered

#: Characters of a text in the keys that splitters are drawn from.
HEAD = 64
BROADCAST_ROWS = 500_000

RUNS = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("sha", pa.binary()), ("part", pa.int32()), ("run", pa.int32()), ("text", pa.binary())])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lowered(b.column(2)).cast(b.schema.field(2).type)], ["doc_id", "raw", "text"])


@dataclass
class _Run:
    """Rows of equal text; ``group`` numbers the hashes of a range."""

    rows: int
    sha: bytes
    group: int
    text: bytes | None


def _sent(runs: list[_Run], ids: pa.Array, raws: pa.Array, number: int, last: int | None) -> pa.RecordBatch:
    """Rows of whole runs as in RUNS. Those of the range's first hash, and of its ``last``, have the text, once a run."""
    rows = np.array([r.rows for r in runs])
    first, of = np.cumsum(rows) - rows, np.repeat(np.arange(len(runs)), rows)
    top = np.zeros(len(ids), bool)
    top[first] = True
    edge = [r.group in (0, last) for r in runs]
    texts = pa.array([r.text if e else None for r, e in zip(runs, edge, strict=True)], pa.binary())
    numbers = pa.array([number + i if e else None for i, e in enumerate(edge)], pa.int32())
    part = pa.array(np.full(len(ids), TaskContext.get().partitionId(), "i4"))
    once = pa.array(np.where(top, of, 0), mask=~top)
    return pa.RecordBatch.from_arrays([ids, raws, ids.take(pa.array(first[of])), pa.array(rows[of]), pa.array(top), pa.array([r.sha for r in runs], pa.binary()).take(pa.array(of)), part, numbers.take(pa.array(of)), texts.take(once)], schema=RUNS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range (doc_id, raw, h, text) -> its rows as in RUNS. Rows are held back, as ids, while their hash goes on."""
    runs, ids, raws, number, last = [], [], [], 0, None
    for b in batches:
        h, (data, at) = b.column(2).to_numpy(), flat(b.column(3))
        text = lambda i: data[at[i] : at[i + 1]]  # noqa: B023, E731
        new = np.ones(len(h), bool)  # whether a row's text differs from the one before
        for i in np.flatnonzero(h == np.concatenate(([last if last is not None else ~h[0]], h[:-1]))) if len(h) else ():
            new[i] = not np.array_equal(text(i), text(i - 1) if i else np.frombuffer(runs[-1].text, "u1"))
        starts = np.flatnonzero(new)
        if len(h) and not new[0]:
            runs[-1].rows += int(starts[0] if len(starts) else len(h))
        for i, n in zip(starts.tolist(), np.diff(starts, append=len(h)).tolist(), strict=True):
            group = runs[-1].group if runs else 0
            if last is not None and h[i] != last:
                for r in reversed(runs):
                    if r.group != group:
                        break
                    r.text = r.text if group == 0 else None
                group += 1
            own = text(i).tobytes()
            runs.append(_Run(n, hashlib.sha256(own).digest(), group, own))
            last = h[i]
        ids.append(b.column(0))
        raws.append(b.column(1))
        whole = [r for r in runs if r.group < runs[-1].group] if runs else []
        if whole:
            some, more = pa.concat_arrays(ids), pa.concat_arrays(raws)
            n = sum(r.rows for r in whole)
            yield _sent(whole, some.slice(0, n), more.slice(0, n), number, None)
            runs, ids, raws, number = runs[len(whole) :], [some.slice(n)], [more.slice(n)], number + len(whole)
    if runs:
        yield _sent(runs, pa.concat_arrays(ids), pa.concat_arrays(raws), number, runs[-1].group)


def sorted_groups(docs: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text as given), keep_id, group_size, kept, sha (of the normalised text) for each row of
    ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"))
    texts = staged(rows.mapInArrow(_normalised, "doc_id long, raw long, text string"), "sort-texts", "zstd")
    keyed = texts.select("doc_id", "raw", F.xxhash64("text").alias("h"), "text", F.substring("text", 1, HEAD).alias("head"))
    by_id = F.col("doc_id").desc_nulls_last()
    ranges = keyed.repartitionByRange("head", "h", by_id).sortWithinPartitions("head", "h", "text", by_id, "raw")
    found = staged(ranges.select("doc_id", "raw", "h", "text").mapInArrow(_neighbours, "doc_id long, raw long, keep_id long, group_size long, kept boolean, sha binary, part int, run int, text binary"), "sort-runs")
    # two runs a range and no more, unless hashes collide
    same = Window.partitionBy("text")
    order = same.orderBy(F.col("keep_id").desc_nulls_last(), "part", "run")
    ends = found.filter("text IS NOT NULL").select(F.col("part").alias("_part"), F.col("run").alias("_run"), F.max("keep_id").over(same).alias("_keep"), F.sum("group_size").over(same).alias("_size"), (F.row_number().over(order) == 1).alias("_first"))
    joined = found.join(hinted(staged(ends, "sort-ends"), BROADCAST_ROWS), F.expr("part = _part AND run = _run"), "left")
    edge = F.col("run").isNotNull()
    return joined.select("doc_id", "raw", F.when(edge, F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("_size", "group_size").alias("group_size"), (F.col("kept") & F.coalesce("_first", F.lit(True))).alias("kept"), "sha")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    A null text counts as empty. Of equal texts one row stays: the one with the largest doc_id, null ids last; rows that tie
    in text and id are told apart by the text as given, and of repeated rows one stays. Texts of any length are read and
    compared whole. Other columns are ignored; an empty table gives an empty result. Rows equal in id as well as text
    lie in one range.
    """
    return sorted_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in ``exact_groups``."""
    found = sorted_groups(docs.select("doc_id", "text"))
    keys = staged(found.groupBy("doc_id", "raw").agg(F.max("kept").alias("_stays"), F.count("*").alias("_rows")).filter("NOT _stays OR _rows > 1").select(F.col("doc_id").alias("_d"), F.col("raw").alias("_g"), "_stays"), "sort-gone")
    rows = sealed(docs).withColumns({"doc_id": field("doc_id"), "_h": F.xxhash64(field("text"))})
    out = rows.join(hinted(keys, BROADCAST_ROWS), F.expr("doc_id <=> _d AND _h = _g"), "left")
    single = out.filter("_stays IS NULL").select("row")
    return unsealed(single.union(out.filter("_stays").dropDuplicates(["_d", "_g"]).select("row")), docs.columns)


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
