"""Exact vector top-k for sets of queries, and the filters that keep a query from finding itself."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelquery.functions.vector import dot
from reelquery.operators.blocks import against
from reelquery.staging import hinted, staged

FOUND = "query_id long, vec_id long, sim double"


def nearest(frames: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, block: int | None = None) -> DataFrame:
    """query_id, vec_id, sim, rank: each query's ``k`` frames of greatest inner product, ties to the smaller vec_id.

    ``frames``: vec_id, embedding; ``queries``: query_id, self_id (the frame that it is, or null), embedding.
    A block of queries is multiplied with frames at a time, and of each block and part of the frames the top k are
    kept, so the shuffle to the window that merges them carries k rows a query and part. How blocks meet frames,
    and when they are broadcast, is ``blocks.against``'s. Null vectors take no part.
    """
    frames = frames.filter("embedding IS NOT NULL").select("vec_id", "embedding")
    queries = queries.filter("embedding IS NOT NULL").select("query_id", "self_id", "embedding")
    rows = against(frames, queries, _search(k, exclude_self), FOUND, 8 * F.size("embedding") + 16, (F.col("vec_id"), F.col("query_id")), block)
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(k: int, exclude_self: bool, cells: int = 1 << 20):
    """Queries and batches of frames -> the top k of each query. It is sent to the workers whole, so that they
    needn't have this library."""

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        return flat.to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1 if len(column) else 0)

    def search(queries: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = queries["query_id"].to_numpy(), matrix(queries["embedding"])
        own = queries["self_id"].to_pandas().to_numpy("float64", na_value=np.nan)
        best, near = np.zeros((len(q), 0), "i8"), np.zeros((len(q), 0))
        step = max(64, cells // max(1, len(q)))  # what is held beside the hits is the same for few and many queries
        for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            ids = part["vec_id"].to_numpy()
            sims = q @ matrix(part["embedding"]).T
            sims[np.isnan(sims)] = -np.inf
            if exclude_self:
                sims[own[:, None] == ids[None]] = -np.inf
            best, near = np.hstack([best, np.broadcast_to(ids, sims.shape)]), np.hstack([near, sims])
            if near.shape[1] > k:
                at = np.argpartition(near, -k, 1)[:, -k:]
                bound = np.take_along_axis(near, at, 1).min(1)
                # of those equal to the k-th greatest as many stay as there is room for, by id
                for row in np.flatnonzero(((near >= bound[:, None]).sum(1) > k) & (bound > -np.inf)):
                    equal, above = np.flatnonzero(near[row] == bound[row]), np.flatnonzero(near[row] > bound[row])
                    at[row] = np.concatenate([above, equal[np.argsort(best[row, equal], kind="stable")]])[:k]
                best, near = np.take_along_axis(best, at, 1), np.take_along_axis(near, at, 1)
        row, column = np.nonzero(near > -np.inf)
        yield pa.RecordBatch.from_pydict({"query_id": names[row].astype("i8"), "vec_id": best[row, column], "sim": near[row, column]})

    return search


#: Queries that may be broadcast; components of a vector that are columns, as compiled code of more is left uncompiled.
BROADCAST_QUERIES, COLUMNS = 100_000, 96


def nearest_native(frames: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """The same with built-in expressions alone, for few queries; they are broadcast if their stored table is small.

    Components become columns, so that a product is compiled arithmetic, summed in array order. The k-th hit of each query among
    a share of the frames is found first; of all pairs, only those that reach it are sorted.
    """
    frames, queries = (df.filter(F.forall("embedding", lambda x: x.isNotNull())) for df in (frames.select("vec_id", "embedding"), queries.select("query_id", "self_id", "embedding")))
    sizes = sorted(r[0] for r in queries.select(F.size("embedding")).distinct().collect())  # vectors of other lengths have no product
    parts = [_nearest_native(*(df.filter(F.size("embedding") == n) for df in (frames, queries)), n, k, exclude_self) for n in sizes]
    found = reduce(DataFrame.unionAll, parts) if parts else frames.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("sim")).limit(0)
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest_native(frames: DataFrame, queries: DataFrame, n: int, k: int, exclude_self: bool) -> DataFrame:
    """query_id, vec_id, sim: pairs of vectors of ``n`` components, among them each query's ``k`` best."""
    if n <= COLUMNS:
        each = lambda name: [F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"_{name}{i}") for i in range(n)]
        product = reduce(lambda s, i: s + F.col(f"_q{i}") * F.col(f"_f{i}"), range(n), F.lit(0.0))
    else:
        each, product = (lambda name: [F.col("embedding").alias(f"_{name}")]), dot("_q", "_f")
    f = staged(frames.select("vec_id", *each("f")), "native-frames")
    q = staged(queries.select("query_id", "self_id", *each("q")), "native-queries")
    other = ~F.col("vec_id").eqNullSafe(F.col("self_id")) if exclude_self else F.lit(True)
    of = max(1, math.isqrt(f.count() // k))
    part = f.filter(F.pmod(F.xxhash64("vec_id"), F.lit(of)) == 0)
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    some = part.join(hinted(q, BROADCAST_QUERIES), other).select("query_id", product.alias("sim"), "vec_id").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k)
    least = some.groupBy("query_id").agg(F.min("sim").alias("_least"), F.count("*").alias("_n")).filter(F.col("_n") >= k).select("query_id", "_least")
    q = staged(q.join(least, "query_id", "left").withColumn("_least", F.coalesce("_least", F.lit(float("-inf")))), "native-least")
    return f.join(hinted(q, BROADCAST_QUERIES), other & (product >= F.col("_least"))).select("query_id", "vec_id", product.alias("sim"))


def nearest_in_group(frames: DataFrame, queries: DataFrame, k: int, by: str = "media_id", exclude_self: bool = True) -> DataFrame:
    """The top k among the frames of the query's own group: an equi-join on the group. ``queries`` has ``by``."""
    pairs = frames.select(by, "vec_id", "embedding").join(queries.select(by, "query_id", "self_id", F.col("embedding").alias("_q")), by)
    if exclude_self:
        pairs = pairs.filter(~F.col("vec_id").eqNullSafe(F.col("self_id")))
    scored = pairs.select("query_id", "vec_id", dot("_q", "embedding").alias("sim")).filter("sim IS NOT NULL")
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best_beside(seconds: float):
    """Queries and batches of frames -> for each query and other item of a batch the greatest product between what the
    query's item shows and what that item shows within ``seconds`` of the query, and how many products that takes.
    It is sent to the workers whole, so that they needn't have this library."""

    def search(asked: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = [np.array(x.as_py(), "f8") for x in asked["ours"]]
        names, times, own = asked["query_id"].to_pylist(), asked["t"].to_numpy(), asked["_m"].to_pylist()
        for part in batches:
            ts = part["ts"].cast(pa.float64()).to_numpy(zero_copy_only=False)
            order = np.argsort(ts, kind="stable")
            part, ts = part.take(pa.array(order)), ts[order]
            media = part["media_id"].dictionary_encode()
            code, vectors = media.indices.to_numpy(), part["embedding"]
            found = []
            for i, name in enumerate(names):
                lo, hi = np.searchsorted(ts, times[i] - seconds, "left"), np.searchsorted(ts, times[i] + seconds, "right")
                if lo == hi:
                    continue
                x = vectors.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(hi - lo, -1)
                best, of = (x @ ours[i].T).max(1), code[lo:hi]
                for item in np.unique(of):
                    if media.dictionary[int(item)].as_py() != own[i]:
                        found.append((name, int(item), best[of == item].max(), int((of == item).sum()) * len(ours[i])))
            q, m, b, n = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), media.dictionary.take(pa.array(m, pa.int32())), pa.array(b, pa.float64()), pa.array(n, pa.int64())], ["query_id", "media_id", "best", "pairs"])

    return search


def beside(queries: DataFrame, frames: DataFrame, seconds: float) -> DataFrame:
    """query_id, media_id, best, pairs: other items' frames at most ``seconds`` from a query's time against the
    query's own. ``queries``: query_id, _m (its item), t, ours (its frames' vectors); ``frames``: media_id, ts, embedding. Blocks
    of queries meet frames where these lie; a row for each query, item and batch goes on, and no pairs of vectors."""
    frames = frames.filter("embedding IS NOT NULL AND ts IS NOT NULL AND media_id IS NOT NULL").select("media_id", "ts", "embedding")
    size = F.aggregate("ours", F.lit(16), lambda a, v: a + 8 * F.size(v))
    found = against(frames, queries.select("query_id", "_m", "t", "ours"), _best_beside(seconds), f"query_id long, media_id {frames.schema['media_id'].dataType.simpleString()}, best double, pairs long", size, (F.struct("media_id", "ts"), F.col("query_id")))
    return found.groupBy("query_id", "media_id").agg(F.max("best").alias("best"), F.sum("pairs").alias("pairs"))


def leaks(media: Column, time: Column, query_media: Column, query_time: Column, seconds: float = 6.0) -> Column:
    """Whether a candidate shows the query's own moment: the same media, at most ``seconds`` away."""
    return F.coalesce((media == query_media) & (F.abs(time - query_time) <= seconds), F.lit(False))
