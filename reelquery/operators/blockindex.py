"""A stored index for exact top-k search that leaves out blocks of vectors which can't hold a hit.

Frames of a media item that follow each other look alike, so a block is a run of them: its vectors, their mean and the
greatest distance of any of them from it. No product of a query with a block's vector exceeds the product with
the mean by more than the query's length times that distance. A search first looks through the blocks of greatest bound,
which gives each query a k-th hit to beat, and then only through blocks whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reelquery.operators.blocks import MOST, against
from reelquery.staging import staged

#: Vectors of a block.
BLOCK = 64
#: Products that one task holds at a time.
CELLS = 1 << 20
HITS = "query_id long, vec_id long, sim double"
PAIRS = "query_id long, block long, n long, bound double"


def build(frames: DataFrame, size: int = BLOCK) -> DataFrame:
    """media_id, block (its id), n, centroid, radius, vec_ids, vectors of frames (media_id, frame_no, vec_id, embedding).
    Null vectors are left out. Stored as it is, or published by media item, it serves any number of searches, which
    read vectors only of the blocks they open."""
    each = F.struct("vec_id", "embedding")
    rows = frames.filter("embedding IS NOT NULL").groupBy("media_id", F.floor((F.col("frame_no") - 1) / size).alias("_b")).agg(F.sort_array(F.collect_list(each)).alias("_v"))
    rows = rows.select("media_id", F.xxhash64("media_id", "_b").alias("block"), F.size("_v").cast("long").alias("n"), F.col("_v.vec_id").alias("vec_ids"), F.col("_v.embedding").alias("vectors"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centroids, radii = [], []
            for vectors in b["vectors"]:
                x = vectors.values.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), -1)
                c = x.mean(0)
                centroids.append(c)
                radii.append(float(np.sqrt(((x - c) ** 2).sum(1)).max()))
            yield pa.RecordBatch.from_arrays([b["media_id"], b["block"], b["n"], pa.array(centroids, pa.list_(pa.float64())), pa.array(radii, pa.float64()), b["vec_ids"], b["vectors"]], ["media_id", "block", "n", "centroid", "radius", "vec_ids", "vectors"])

    kind = rows.schema["media_id"].dataType.simpleString()
    return rows.mapInArrow(summed, f"media_id {kind}, block long, n long, centroid array<double>, radius double, vec_ids array<long>, vectors {rows.schema['vectors'].dataType.simpleString()}")


def _bounds(first: int | None):
    """Queries and batches of blocks (block, n, centroid, radius) -> blocks with their bounds: with ``first``, for each query
    those of greatest bound that hold so many vectors; without, those whose bound reaches the query's ``least``."""

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        return flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1 if len(column) else 0)

    def search(asked: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = matrix(asked["embedding"]), asked["query_id"].to_numpy()
        length = np.sqrt((q * q).sum(1))[:, None]
        step = max(16, CELLS // max(1, len(q)))
        for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            n, c, r = part["n"].to_numpy(), matrix(part["centroid"]), part["radius"].to_numpy()[None]
            # products are rounded, so bounds are given some room
            bound = q @ c.T + length * r
            bound += 1e-9 * length * (np.sqrt((c * c).sum(1))[None] + r)
            if first is None:
                row, column = np.nonzero(bound >= asked["least"].to_numpy()[:, None])
            else:
                order = np.argsort(-bound, 1, kind="stable")
                held = n[order]
                row, at = np.nonzero(np.cumsum(held, 1) - held < first)
                column = order[row, at]
            yield pa.RecordBatch.from_arrays([pa.array(names[row].astype("i8")), part["block"].take(pa.array(column)), pa.array(n[column]), pa.array(bound[row, column])], ["query_id", "block", "n", "bound"])

    return search


def _opened(k: int, queries, cells: int):
    """Blocks with the ids of the queries that open them (asked), or blocks that open for each query whose ``least`` their bound
    reaches -> each query's k best of a task. Beside these, ``cells`` products are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, q, least = queries.value
        least, length = least.copy(), np.sqrt((q * q).sum(1))
        none = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        found, held = [none], 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            who, ids, sims = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, -sims, who))
            who, ids, sims = who[order], ids[order], sims[order]
            starts = np.flatnonzero(np.diff(who, prepend=who[:1] - 1))
            place = np.arange(len(who)) - np.repeat(starts, np.diff(starts, append=len(who)))
            last = place == k - 1
            least[who[last]] = np.maximum(least[who[last]], sims[last])
            return who[place < k], ids[place < k], sims[place < k]

        for b in batches:
            for i in range(b.num_rows):
                ids, c, r = b["vec_ids"][i].values.to_numpy(), b["centroid"][i].values.to_numpy(), b["radius"][i].as_py()
                x = b["vectors"][i].values.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(ids), -1)
                room = 1e-9 * length * (np.sqrt((c * c).sum()) + r)  # products are rounded
                at = np.searchsorted(names, b["asked"][i].values.to_numpy()) if "asked" in b.schema.names else np.flatnonzero(q @ c + length * r + room >= least)
                step = max(1, cells // len(ids))
                for some in (at[lo : lo + step] for lo in range(0, len(at), step)):
                    sims = q[some] @ x.T
                    row, column = np.nonzero((sims >= (least - room)[some][:, None]) & (own[some][:, None] != ids[None]))
                    found.append((some[row], ids[column], sims[row, column]))
                    held += len(row)
                    if held > cells:
                        found, held = [best()], 0
        who, ids, sims = best()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[who].astype("i8"), ids, sims)], ["query_id", "vec_id", "sim"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, work). hits: query_id, vec_id, sim, rank, the same as ``knn.nearest`` over the indexed frames gives. work: query_id,
    blocks, opened, the number of blocks and of those whose vectors were looked at.

    ``index``: a stored table that ``build`` made; ``queries``: query_id (each once), self_id, embedding. Sets of more than
    ``MOST`` queries are searched in groups.
    """
    queries = queries.filter("embedding IS NOT NULL").select("query_id", "self_id", "embedding")
    groups = -(-2 * queries.count() // MOST) if queries.count() > MOST else 1
    parts = [_search(index, queries if groups == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), k, exclude_self) for g in range(groups)]
    hits, work = parts[0]
    for h, w in parts[1:]:
        hits, work = hits.union(h), work.union(w)
    return hits, work


def _search(index: DataFrame, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    spark = index.sparkSession
    asked = queries.orderBy("query_id").toArrow()
    own = asked["self_id"].to_pandas().to_numpy("float64", na_value=np.nan) if exclude_self else np.full(len(asked), np.nan)
    vectors = asked["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("f8")
    names, vectors = asked["query_id"].to_numpy(), vectors.reshape(len(asked), -1 if len(asked) else 0)
    outlines = index.select("block", "n", "centroid", "radius")
    size, by = 8 * F.size("embedding") + 24, (F.col("block"), F.col("query_id"))
    least = np.full(len(asked), float("-inf"))

    def opened(blocks: DataFrame, *asked_: str) -> DataFrame:
        shared = spark.sparkContext.broadcast((names, own, vectors, least))
        return index.join(blocks, "block").select("vec_ids", "vectors", "centroid", "radius", *asked_).mapInArrow(_opened(k, shared, CELLS), HITS)

    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    need = k + 1 if exclude_self else k
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = against(outlines, queries, _bounds(need), PAIRS, size, by)
    first = staged(first.withColumn("_held", F.sum("n").over(order) - F.col("n")).filter(F.col("_held") < need).select("query_id", "block", "bound"), "index-first")
    found = staged(top(opened(first.groupBy("block").agg(F.collect_list("query_id").alias("asked")), "asked")), "index-hits")  # at most MOST ids
    beaten = found.groupBy("query_id").agg(F.min("sim").alias("least"), F.count("*").alias("_n")).filter(F.col("_n") >= k).toArrow()
    least[np.searchsorted(names, beaten["query_id"].to_numpy())] = beaten["least"].to_numpy()
    asked_again = staged(queries.join(spark.createDataFrame(pa.table({"query_id": names.astype("i8"), "least": least})), "query_id").select("query_id", "embedding", "least"), "index-least")
    # pairs of queries and blocks aren't listed: the blocks that any query opens are, and each finds its queries when it is read
    reached = against(outlines, asked_again, _bounds(None), PAIRS, size, by)
    hits = top(opened(staged(reached.select("block").distinct(), "index-more")))
    total = index.count()
    looked = reached.select("query_id", F.lit(1).alias("o")).unionAll(first.join(asked_again.select("query_id", "least"), "query_id").filter("bound < least").select("query_id", F.lit(1)))
    work = queries.select("query_id").join(looked.groupBy("query_id").agg(F.sum("o").alias("opened")), "query_id", "left")
    return hits, work.select("query_id", F.lit(total).alias("blocks"), F.coalesce("opened", F.lit(0)).alias("opened"))
