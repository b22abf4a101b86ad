"""Importance resampling towards the benchmark's distribution of hashed words, pairs and triples of words.

Two passes over the texts, Arrow batch by Arrow batch. The first counts features by bucket: ``np.bincount`` gives each
partition one vector of ``BUCKETS`` counts, and ``treeReduce`` adds them up on the executors. From the counts of all documents and
of the target every bucket has a gain, an integer; the second pass has the gains by broadcast, gathers them for a batch's features
and sums them by document with ``np.bincount`` weights. A Gumbel draw on top makes the highest scores a sample without
replacement, ranked by range partitions (``numbered``) and not in one task.

Features are never built as strings. A word's crc32 comes from a table look-up a byte, all words of a block at once; the crc32 of a
run of words follows from those of its words, as appending n bytes is a linear map of the crc that precomputed tables
hold for every n.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelquery.operators.numbering import numbered

from .common import staged, table
from .strings import LOWER, flat

BUCKETS, MOST_WORDS, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a block of text that is handled at once, in whole words.
BLOCK = 1 << 21
#: Words beyond this many bytes are given to zlib one by one.
LONG = 64
DEPTH = 3

#: The bytes of words, after lower-casing: digits, letters and all that isn't ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype="u4")
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def _zeros(most: int) -> np.ndarray:
    """By n, byte of the crc and its value: what the crc becomes when n zero bytes are appended."""
    now = np.arange(256, dtype="u4")[None, :] << np.arange(0, 32, 8, dtype="u4")[:, None]
    found = [now]
    for _ in range(most):
        now = CRC[now & 255] ^ (now >> 8)
        found.append(now)
    return np.stack(found)


ZEROS = _zeros(2 * LONG)
SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of crc32(a + b) that comes of a, by crc32(a) and the number of bytes of b; crc32(b) is its other part."""
    most, n = len(ZEROS) - 1, n.copy()
    while len(far := np.flatnonzero(n > most)):
        crc = crc.copy()
        crc[far] = shifted(crc[far], np.full(len(far), most))
        n[far] -= most
    return ZEROS[n, 0, crc & 255] ^ ZEROS[n, 1, crc >> 8 & 255] ^ ZEROS[n, 2, crc >> 16 & 255] ^ ZEROS[n, 3, crc >> 24]


def word_crcs(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    crc = np.full(len(n), 0xFFFFFFFF, "u4")
    at = np.arange(len(n))
    for j in range(min(LONG, int(n.max(initial=0)))):
        at = at[n[at] > j]
        crc[at] = CRC[(crc[at] ^ data[start[at] + j]) & 255] ^ (crc[at] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > LONG):
        crc[i] = zlib.crc32(data[start[i] : start[i] + n[i]])
    return crc


def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, crc32 and length of the words of a column, in blocks of some ``BLOCK`` bytes that end between words."""
    data, offsets = flat(column)
    data = LOWER[data]
    inside = INSIDE[data]
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            breaks = [int(x[-1]) for x in (np.flatnonzero(~inside[at:end]) + at + 1, offsets[(offsets > at) & (offsets <= end)]) if len(x)]
            if not breaks:  # one word fills the block
                breaks = [min([int(x[0]) for x in (np.flatnonzero(~inside[end:]) + end, offsets[offsets > end]) if len(x)])]
            end = max(breaks)
        here = inside[at:end]
        cut = np.zeros(end - at + 1, bool)
        cut[offsets[(offsets >= at) & (offsets <= end)] - at] = True
        before, after = np.concatenate(([False], here[:-1])), np.concatenate((here[1:], [False]))
        start = np.flatnonzero(here & (~before | cut[:-1])) + at
        n = np.flatnonzero(here & (~after | cut[1:])) + at + 1 - start
        yield np.searchsorted(offsets, start, "right") - 1, word_crcs(data, start, n), n
        at = end


def features(column: pa.Array, most: int = MOST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row and crc32 of all runs of 1 to ``most`` words of a row, and the rows of the words alone, block by block."""
    row, crc, n = np.zeros(0, "i8"), np.zeros(0, "u4"), np.zeros(0, "i8")
    for new_row, new_crc, new_n in blocks(column):
        k = len(row)  # the last words of the block before
        row, crc, n = np.concatenate((row, new_row)), np.concatenate((crc, new_crc)), np.concatenate((n, new_n))
        rows, found, runs = [row[k:]], [crc[k:]], crc
        spaced = shifted(np.full(len(n), SPACE), n) ^ crc
        for m in range(1, most):
            runs = shifted(runs[:-1], n[m:] + 1) ^ spaced[m:]
            whole = row[m:] == row[:-m] if len(row) > m else np.zeros(0, bool)
            whole[: max(0, k - m)] = False
            rows.append(row[m:][whole])
            found.append(runs[whole])
        yield np.concatenate(rows), np.concatenate(found), new_row
        row, crc, n = (x[max(0, len(x) - most + 1) :] for x in (row, crc, n))


def counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS, depth: int = DEPTH) -> np.ndarray:
    """Features of all ``texts`` (text) by bucket. The driver gets the last few of the vectors that tasks add up."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for b in batches:
            for _, crc, _ in features(b.column(0), most):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = texts.select(F.coalesce("text", F.lit(""))).mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], "i8"))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, "i8")], 1)
    return none.union(vectors).treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier the target makes a bucket, each count taken as one more."""
    up, down = (target + 1.0) * float(source.sum() + len(source)), (source + 1.0) * float(target.sum() + len(source))
    return np.floor(1000 * np.log(up / down)).astype("i8")


def weighed(docs: DataFrame, gain: np.ndarray, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight: a document's features and the sum of their gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            words, n, weight = (np.zeros(b.num_rows, "i8") for _ in range(3))
            for row, crc, of_words in features(b.column(1), most):
                words += np.bincount(of_words, minlength=b.num_rows)
                n += np.bincount(row, minlength=b.num_rows)
                weight += np.bincount(row, gain[crc % np.uint32(len(gain))], b.num_rows).astype("i8")  # doubles hold such sums exactly
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(summed, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """A Gumbel draw by the id, in thousandths; a null id draws as the text "null"."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words for every row of ``docs``; rank is null where a row isn't drawn.

    Null and texts without words have no features and weigh 0. Repeated rows are drawn each; ties in score go
    to the smaller doc_id, null ids last. Texts of any length are read whole, block by block. Other columns are ignored.
    Without documents the result is empty; an empty target leaves every bucket's count at one.
    """
    gain = gains(counts(docs.select("text")), counts(target.select("text")))
    rows = staged(weighed(docs, gain).withColumn("score", F.col("weight") + noise(seed)), "resample-scores")
    able = rows.filter(F.col("n_words") >= least_words)
    n = able.count() * percent // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(F.col("place") <= n, F.col("place"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank"), "n_words").union(rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"), "n_words"))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id and rank of the rows that are drawn, in no order; rules as in ``resampled``."""
    return resampled(docs, target, **options).filter("rank IS NOT NULL").select("doc_id", "rank")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 as the bytes of a feature folded over a table that is made from the polynomial.
SQL = r"""
WITH g AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)),
             lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc),
d AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
u AS (SELECT kind, id, unnest(w) AS f FROM w
      UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
      UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
n AS (SELECT kind, id, f, count(*) AS n FROM u GROUP BY ALL),
e AS (SELECT f, hex(encode(f)) AS e FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(range(len(e) // 2), lambda i: CAST('0x' || substr(e, 2 * i + 1, 2) AS BIGINT))),
             lambda r, c: xor(r >> 8, crc[xor(r & 255, c) + 1])), 4294967295) % 10000 AS b FROM e, g),
c AS (SELECT r.b, CAST(coalesce(sum(n) FILTER (kind = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (kind = 1), 0) AS DOUBLE) AS t
      FROM (SELECT unnest(range(10000)) AS b) r LEFT JOIN (SELECT b.b, kind, n FROM n JOIN b USING (f)) x ON x.b = r.b GROUP BY r.b),
l AS (SELECT b, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
f AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN b USING (f) JOIN l USING (b) WHERE kind = 0 GROUP BY id),
r AS (SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
      FROM w LEFT JOIN f USING (id) WHERE w.kind = 0),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank, n_words FROM r LEFT JOIN k USING (doc_id)
"""
