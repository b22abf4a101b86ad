"""A set of queries against all rows of a table, in blocks: each task meets its rows with a block of queries and keeps
what its operator keeps of them, so that pairs never leave the task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Queries up to so many, and so many bytes, go to every task; more are dealt into blocks.
MOST, MOST_BYTES = 4096, 64 << 20


def against(rows: DataFrame, queries: DataFrame, search: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, bytes_: Column, by: tuple[Column, Column], most: int | None = None) -> DataFrame:
    """What ``search`` finds of each block of ``queries`` (as a table) in each part of ``rows`` (as batches).

    Queries are counted, and measured by ``bytes_`` (a query's size), first. Few and small ones are broadcast and
    the rows stay where they are. Otherwise blocks of queries meet parts of the rows by cogrouping, both
    dealt by the hashes of ``by`` (of the rows, of the queries), and neither passes through the driver.
    """
    most, most_bytes = most or MOST, MOST_BYTES
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    if n <= most and size <= most_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(shared.value):
                yield from search(shared.value, batches)

        return rows.mapInArrow(run, schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = int(max(-(-2 * n // most), -(-2 * size // most_bytes)))  # dealt by hash: half full, so that hardly any is over-full
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"_part": F.pmod(F.xxhash64(by[0]), F.lit(parts)).cast("int"), "_block": each(blocks)})
    right = queries.withColumns({"_block": F.pmod(F.xxhash64(by[1]), F.lit(blocks)).cast("int"), "_part": each(parts)})
    empty = pa.schema([])

    def meet(part: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(search(asked, iter(part.combine_chunks().to_batches()))) if len(asked) and len(part) else []
        return pa.Table.from_batches(found) if found else pa.Table.from_batches([], empty)

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(meet, schema)
