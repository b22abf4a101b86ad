"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted by k-means on a bounded sample; every row is then indexed. A row goes into the list
of its nearest centroid and, if it lies at a boundary, into the next one's as well. Lists stand together in
buckets of neighbouring lists; buckets longer than ``PART`` are dealt into parts, which balances them
whatever the vectors, equal ones included. A query opens its nearest lists until they hold some candidates, and
all lists whose centroids lie within a ratio of their distance; the rows are searched exactly in double
precision and merged. A query that found fewer neighbours than asked is searched again, over all rows, and so is one whose
components lie far beyond those of most rows.

The ratio is fitted too: for some rows the true neighbours are found by brute force, and the ratio is the
least that opens a list of the wanted share of them. So it follows from the data how many lists a query
opens, not from a setting: few where vectors cluster, many where they fill their space evenly.

Centroids are found in memory by a best-first search over a graph that links each centroid to its nearest
ones and to some far ones; it runs for a batch of vectors at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import hinted, staged, table

#: Rows of a list on average; most lists; rows of the sample for each list; k-means rounds.
LIST, MOST, SAMPLE, ROUNDS = 32, 8192, 24, 8
#: Lists a row stands in at most, and how much farther than the nearest centroid the next may be.
COPIES, NEARLY = 2, 1.02
#: Share of the true neighbours whose lists are to be opened, and the rows that this is fitted on.
RECALL, TRIALS = 0.95, 192
#: Links of a centroid, near and far; lists of a bucket; rows of a part of a bucket; queries of a part's queries.
LINKS, BUCKET, PART, QUERIES = (16, 4), 16, 8192, 4096
BROADCAST_ROWS = 500_000
#: Components beyond so many times a usual row's greatest are cut to that where lists are chosen.
CUT = 1e9
#: Vectors with a greatest component outside of these bounds have squares that doubles may not hold.
TINY, HUGE = 1e-70, 1e70


def sound(v: Column, size: int) -> Column:
    """Whether a vector has the size, finite components and isn't zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all of x to all of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


class Centroids:
    """K-means centroids and the graph over them. Neighbouring centroids have neighbouring numbers."""

    def __init__(self, sample: np.ndarray, lists: int, copies: int = COPIES, nearly: float = NEARLY, seed: int = 7):
        self.copies, self.nearly = copies, nearly
        rng = np.random.default_rng(seed)
        tops = np.abs(sample.astype("f8")).max(1, initial=0)
        usual = float(np.clip(np.median(tops[tops > 0]), 1e-300, 1e300)) if (tops > 0).any() else 1.0
        #: What brings usual vectors near one, where single precision doesn't hold their squares as they are.
        self.scale = 1.0 if 1e-9 < usual < 1e9 else 1 / usual
        sample = np.unique(self.routed(sample), axis=0)
        lists = max(1, min(lists, len(sample)))
        c = _means(sample, lists, ROUNDS, rng)
        groups = -(-lists // BUCKET)
        self.points = np.ascontiguousarray(c[np.argsort(_nearest(c, _means(c, groups, ROUNDS, rng)), kind="stable")])
        near = [np.argsort(squares(self.points[i : i + 512], self.points), 1)[:, 1 : 1 + LINKS[0]] for i in range(0, lists, 512)]
        self.links = np.hstack([np.concatenate(near), rng.integers(0, lists, (lists, LINKS[1]))]).astype("i4")
        self.norms = (self.points * self.points).sum(1)
        far = np.concatenate([squares(sample[i : i + 2048], self.points).min(1) for i in range(0, len(sample), 2048)])
        #: A query nearer to its centroid than most rows is treated as if it were as far as the median row.
        self.floor = float(np.sqrt(np.median(far)))

    def routed(self, x: np.ndarray) -> np.ndarray:
        """Vectors as lists are chosen for them: scaled, cut and in single precision."""
        with np.errstate(over="ignore"):
            return np.clip(x.astype("f8") * self.scale, -CUT, CUT).astype("f4")

    def search(self, x: np.ndarray, breadth: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """The ``breadth`` nearest centroids found for each row of x and their distances, nearest first: from
        the same few starts, the nearest centroids not yet followed are followed until there are none
        among the best."""
        x, lists = self.routed(x), len(self.points)
        breadth = min(breadth, lists)
        if 4 * breadth >= lists:  # most centroids would be met anyway
            far = squares(x, self.points)
            best = np.argsort(far, 1, kind="stable")[:, :breadth]
            return best, np.sqrt(np.take_along_axis(far, best, 1))
        starts = np.linspace(0, lists - 1, 16).astype("i4")
        best = np.tile(starts, (len(x), 1))
        far = squares(x, self.points[starts])
        followed = np.zeros(best.shape, bool)
        done: list[tuple] = []
        rows, square = np.arange(len(x)), (x * x).sum(1)
        wide = max(wide, breadth // 8)
        while len(rows):
            open_far = np.where(followed, np.inf, far)
            at = np.argsort(open_far, 1)[:, :wide]
            is_open = np.take_along_axis(open_far, at, 1) < np.inf
            alive = is_open.any(1)
            if not alive.all():
                done.append((rows[~alive], best[~alive], far[~alive]))
                rows, best, far, followed, at, is_open = (a[alive] for a in (rows, best, far, followed, at, is_open))
                if not len(rows):
                    break
            np.put_along_axis(followed, at, True, 1)
            to = self.links[np.where(is_open, np.take_along_axis(best, at, 1), np.take_along_axis(best, at[:, :1], 1))].reshape(len(rows), -1)
            new = np.maximum(square[rows, None] + self.norms[to] - 2 * np.einsum("nd,nkd->nk", x[rows], self.points[to], optimize=True), 0)
            # by number, those that were met before first: of equal ones only the first stays
            best, far = np.hstack([best, to]), np.hstack([far, new])
            followed = np.hstack([followed, np.zeros(to.shape, bool)])
            order = np.argsort(best, 1, kind="stable")
            best, far, followed = (np.take_along_axis(a, order, 1) for a in (best, far, followed))
            far[:, 1:][best[:, 1:] == best[:, :-1]] = np.inf
            order = np.argsort(far, 1, kind="stable")[:, :breadth]
            best, far, followed = (np.take_along_axis(a, order, 1) for a in (best, far, followed))
            followed |= far == np.inf
        out, dist = np.zeros((len(x), breadth), "i4"), np.full((len(x), breadth), np.inf, "f4")
        for r, b, d in done:
            order = np.argsort(d, 1, kind="stable")
            out[r, : b.shape[1]], dist[r, : b.shape[1]] = np.take_along_axis(b, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
        return out, dist

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the lists it may stand in, and whether it does."""
        found, far = (a[:, : self.copies] for a in self.search(x, max(8, self.copies)))
        return found, far <= far[:, :1] * self.nearly + 1e-12

    def needed(self, x: np.ndarray, queries: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """For each of x and its query, the ratio from which on the query opens a list that x stands in."""
        found, mine = self.lists_of(x)
        q = self.routed(queries)
        far = np.sqrt(np.maximum(((q[:, None] - self.points[found]) ** 2).sum(2), 0))
        return np.where(mine, far, np.inf).min(1) / np.array([base for base, _, _ in self._around(queries, 0, sizes, least)])

    def opened(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query opens, by number: those up to ``ratio`` times as far as the nearest ones that
        hold ``least`` rows."""
        return [np.sort(found[far <= max(ratio, 1) * base]) for base, found, far in self._around(x, ratio, sizes, least)]

    def _around(self, x: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each query the distance within which lists hold ``least`` rows, and all lists within ``ratio`` of it."""
        out: list = [None] * len(x)
        todo, breadth = np.arange(len(x)), 64
        while len(todo):
            found, far = self.search(x[todo], breadth)
            enough = np.cumsum(sizes[found] * (far < np.inf), 1) >= least
            last = np.where(enough.any(1), enough.argmax(1), found.shape[1] - 1)
            base = np.maximum(np.where(far < np.inf, far, 0)[np.arange(len(todo)), last], max(self.floor, 1e-12))
            whole = enough.any(1) & (far[:, -1] > ratio * base) | (found.shape[1] == len(self.points))
            for i in np.flatnonzero(whole):
                out[todo[i]] = (float(base[i]), found[i][far[i] < np.inf], far[i][far[i] < np.inf])
            todo, breadth = todo[~whole], breadth * 4
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), "f4")


def thinned(rows: DataFrame, k: int, often: int = 256) -> DataFrame:
    """``rows`` (vec_id, v) without those that are nobody's neighbour: of rows of the same vector, ties go to smaller
    ids, so beyond the k + 1 smallest (one may be the query's own) none is ever returned. Vectors that
    stand in more than ``often`` rows are thinned so; a third of all rows may be one vector."""
    h = F.xxhash64("v")
    common = staged(rows.groupBy(h.alias("_h")).agg(F.count("*").alias("n")).filter(F.col("n") > often).select("_h"), "ann-common")
    if common.isEmpty():
        return rows
    common = hinted(common, BROADCAST_ROWS)
    first = F.row_number().over(Window.partitionBy("_h", "v").orderBy("vec_id"))
    hot = rows.withColumn("_h", h).join(common, "_h", "left_semi").dropDuplicates(["vec_id", "v"]).withColumn("_r", first).filter(F.col("_r") <= k + 1)
    return rows.withColumn("_h", h).join(common, "_h", "left_anti").select("vec_id", "v").union(hot.select("vec_id", "v"))


def listed(rows: DataFrame, centroids, kind: str) -> DataFrame:
    """bucket, list, vec_id, v: each row (vec_id, v) once for each of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            found, mine = c.lists_of(_matrix(part.column(1)))
            row, column = np.nonzero(mine)
            which = found[row, column].astype("i4")
            out = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(which // BUCKET), pa.array(which), *out.columns], ["bucket", "list", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, f"bucket int, list int, vec_id long, v array<{kind}>")


def asking(queries: DataFrame, centroids, ratio: float, sizes, least: int, kind: str) -> DataFrame:
    """bucket, lists, query_id, q: each query (query_id, q) once for each bucket that it opens lists of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            row, bucket, lists = [], [], []
            for i, found in enumerate(c.opened(_matrix(part.column(1)), ratio, sizes.value, least)):
                for which in np.split(found, np.flatnonzero(np.diff(found // BUCKET)) + 1):
                    row.append(i)
                    bucket.append(which[0] // BUCKET)
                    lists.append(which)
            out = part.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(lists, pa.list_(pa.int32())), *out.columns], ["bucket", "lists", "query_id", "q"])

    return queries.select("query_id", "q").mapInArrow(run, f"bucket int, lists array<int>, query_id long, q array<{kind}>")


def safe_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of one vector to all of x, whatever their size: where squares overflow or vanish, differences are
    scaled by the greatest of them. Distances beyond the greatest double are infinite."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        d = np.abs(q / 2 - x / 2)
        plain = np.sqrt(((x - q) ** 2).sum(1))
        top = d.max(1)
        scaled = np.where(top > 0, 2 * (top * np.sqrt(((d / top[:, None]) ** 2).sum(1))), 0.0)
        return np.where((plain > TINY) & (plain < np.inf), plain, scaled)


def _far_apart(x: np.ndarray, q: np.ndarray) -> bool:
    tops = [np.abs(a).max(1, initial=0) for a in (x, q)]
    return any((t > HUGE).any() for t in tops) or all(((t > 0) & (t < TINY)).any() for t in tops)


def closest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, distance) of each query's k nearest rows of x by distance, then id; rows of one id count
    once, by the nearest, and a query's own id doesn't count. ``ids`` are sorted."""
    firsts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    single = len(firsts) == len(ids)
    each = ids[firsts]
    if _far_apart(x, q):
        near = np.stack([np.minimum.reduceat(safe_distances(v, x), firsts) for v in q])
        who, which = np.nonzero(own[:, None] != each[None])
        return first_of(who, each[which], near[who, which], k)
    near = squares(q, x)
    if not single:
        near = np.minimum.reduceat(near, firsts, 1)
    near[own[:, None] == each[None]] = np.inf
    # products tell which rows may be among the nearest, up to rounding; differences then give the distances
    k = min(k, len(each))
    bound = np.partition(near, k - 1, 1)[:, k - 1]
    slack = 1e-9 * (bound + (q * q).sum(1) + (x * x).sum(1).max())
    maybe = (near <= (bound + slack)[:, None]) & (near < np.inf)
    who, which = np.nonzero(maybe)
    far = np.zeros(len(who))
    ends = np.append(firsts[1:], len(ids))
    for at in range(0, len(who), 1 << 16):  # bounds memory where many rows are equally near
        i, j = who[at : at + (1 << 16)], which[at : at + (1 << 16)]
        if single:
            far[at : at + len(i)] = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
        else:
            far[at : at + len(i)] = [np.sqrt(((x[firsts[b] : ends[b]] - q[a]) ** 2).sum(1).min()) for a, b in zip(i, j, strict=True)]
    return first_of(who, each[which], far, k)


def first_of(who: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (distance, id) of each ``who``, each id once."""
    order = np.lexsort((far, ids, who))
    who, ids, far = who[order], ids[order], far[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
    who, ids, far = who[new], ids[new], far[new]
    order = np.lexsort((ids, far, who))
    who, ids, far = who[order], ids[order], far[order]
    starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, int)
    rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
    return who[rank < k], ids[rank < k], far[rank < k]


def _best(k: int):
    """A part of a bucket and queries for it -> each query's nearest rows there."""

    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        if len(rows) and len(queries):
            ids, lists = rows["vec_id"].to_numpy(), rows["list"].to_numpy()
            order = np.lexsort((ids, lists))
            ids, lists, x = ids[order], lists[order], _matrix(rows["v"]).astype("f8")[order]
            own, q = queries["query_id"].to_numpy(), _matrix(queries["q"]).astype("f8")
            wanted = queries["lists"].combine_chunks()
            who = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
            which = wanted.flatten().to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(lists)), strict=True):
                mine = who[which == lists[a]]
                for at in range(0, len(mine), 512):
                    some = mine[at : at + 512]
                    i, near, far = closest(x[a:b], ids[a:b], q[some], own[some], k)
                    found.append((some[i], near, far))
            i, near, far = first_of(*(np.concatenate(z) for z in zip(*found, strict=True)), k)
            return pa.table({"query_id": own[i].astype("i8"), "vec_id": near, "score": far})
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found[0], strict=True)))

    return search


def _searched(postings: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's nearest rows in each part of its buckets."""
    # one row for each bucket: no more than there are lists
    counts = F.broadcast(postings.groupBy("bucket").count().join(wanted.groupBy("bucket").agg(F.count("*").alias("asked")), "bucket").select("bucket", F.ceil(F.col("count") / PART).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("blocks")))
    p = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    b = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
    left = postings.join(counts, "bucket").select("bucket", p.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "vec_id", "v")
    right = wanted.join(counts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), b.alias("block"), "lists", "query_id", "q")
    key = ["bucket", "part", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), "query_id long, vec_id long, score double")


def fitted_ratio(rows: DataFrame, centroids, trials: pa.Table, sizes, least: int, k: int, recall: float) -> float:
    """The least ratio that opens a list of the share ``recall`` of the true neighbours of ``trials`` (vec_id, v).

    Each task keeps the k nearest of its rows for each trial, so the shuffle carries k narrow rows a trial and
    task, and the driver gets k numbers a trial.
    """
    shared = rows.sparkSession.sparkContext.broadcast((trials["vec_id"].to_numpy(), _matrix(trials["v"]).astype("f8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        needs: dict[tuple, float] = {}
        for part in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(part.column(1)).astype("f8")[order]
            who, near, far = closest(x, ids, q, own, k)
            who, near, far = first_of(*(np.concatenate(z) for z in zip(best, (who, near, far), strict=True)), k)
            best, at = (who, near, far), np.searchsorted(ids, near)
            mine = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == near)
            need = centroids.value.needed(x[at[mine]], q[who[mine]], sizes.value, least)
            needs |= dict(zip(zip(who[mine].tolist(), near[mine].tolist()), need.tolist(), strict=True))
            needs = {key: needs[key] for key in zip(who.tolist(), near.tolist(), strict=True)}
        need = np.array([needs[key] for key in zip(best[0].tolist(), best[1].tolist(), strict=True)], "f8")
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*best, need)], ["trial", "vec_id", "score", "need"])

    near = Window.partitionBy("trial").orderBy("score", "vec_id")
    found = rows.select("vec_id", "v").mapInArrow(run, "trial long, vec_id long, score double, need double")
    found = found.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k)
    needs = found.select("need").toArrow()["need"].to_numpy()
    # at most TRIALS * k numbers; where tables hold fewer rows than that there are fewer
    return float(np.quantile(needs, recall, method="higher")) * 1.0001 if len(needs) else 1.0


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, list_size: int = LIST, copies: int = COPIES, nearly: float = NEARLY, recall: float = RECALL, trials: int = TRIALS, most: int = MOST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by distance, then vec_id.

    ``vectors`` and ``queries``: vec_id, embedding. A row is no neighbour of the query with its own vec_id.
    Vectors that are null, zero, of another size than most, or hold null or non-finite components take no
    part; finite ones do, however large or small; with k or fewer candidates all are returned; equal vectors all count; a row that is repeated
    under one vec_id counts once, by the nearest of its vectors; other columns are ignored; no vectors give an empty result.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes["n"] if sizes else 0
    kind = "double" if any(isinstance(x.schema["embedding"].dataType.elementType, T.DoubleType) for x in (vectors, queries)) else "float"
    rows = vectors.filter(sound(F.col("embedding"), width)).filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    asked = queries.filter(sound(F.col("embedding"), width)).filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast(f"array<{kind}>").alias("q"))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = min(most, max(1, total // list_size))

    def drawn(n: int, seed: int) -> pa.Table:
        """A share by hash, then the first of them: the same rows each time, never more than ``n``."""
        h = F.xxhash64("vec_id", F.lit(seed))
        share = rows.filter(F.pmod(F.xxhash64(h), F.lit(1_000_000)) < max(1, int(2e6 * n / total)))
        return share.orderBy(h, "vec_id").limit(n).toArrow()

    # rows that centroids are fitted on lie nearer to them than others; trials are drawn from both alike, as queries are
    fitted, tried = drawn(SAMPLE * lists, 1), drawn(trials, 2)
    shared = spark.sparkContext.broadcast(Centroids(_matrix(fitted["v"]) if len(fitted) else np.zeros((1, width), "f4"), lists, copies, nearly))
    rows = thinned(rows, k)
    postings = staged(listed(rows, shared, kind), "ann-postings")
    held = np.zeros(len(shared.value.points), "i8")
    for r in postings.groupBy("list").count().collect():  # one number a list
        held[r["list"]] = r["count"]
    held = spark.sparkContext.broadcast(held)
    ratio = fitted_ratio(rows, shared, tried, held, 4 * k, k, recall)
    wanted = staged(asking(asked, shared, ratio, held, 4 * k, kind), "ann-probes")
    found = staged(_searched(postings, wanted, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "ann-found")
    # queries whose lists gave fewer than k: all rows are one list for them
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    cut = F.lit(CUT / shared.value.scale)
    loud = F.exists("q", lambda x: F.abs(x.cast("double")) > cut)
    short = staged(asked.join(full, "query_id", "left_anti").union(asked.filter(loud).join(full, "query_id", "left_semi")), "ann-short")
    if not short.isEmpty():
        everywhere = short.select(F.lit(0).alias("bucket"), F.array(F.lit(0)).alias("lists"), "query_id", "q")
        found = found.union(_searched(rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("list"), "vec_id", "v"), everywhere, k))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
