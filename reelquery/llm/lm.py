"""Language-model scoring: a context-tree-weighting byte model learned from part of a corpus, applied to all of it.

Training counts grams (``ctw``) and words over all training documents; both are summed in Spark, none is
pruned. The context trees are then weighed range by range of contexts. A range is cut between contexts of
three bytes, so the driver holds about ``BLOCK`` grams at a time, and no more than one such context has (2^24 at
depth 5; a million or so in text) if that is more. What all ranges share are the levels of up to two bytes of context,
a bounded number of records at any corpus size. Workers load one range's model after the other for each block of
texts, so work grows with texts times ranges; ranges grow with the distinct grams, not with the corpus. Frequent words' counts are broadcast, ``HEAD`` of them at
most; the rare rest of a document's words are joined to their counts by shuffling.

Words are counted under their XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import ctw
from .common import staged, table

DEPTH, FOLDS, HELD_FOLD = 5, 7, 2
#: Bytes of context that ranges are cut between.
CUT = 3
#: Grams of a model range; words whose counts are broadcast; grams weighed at once; bytes of text at once, and if there are ranges.
BLOCK, HEAD, CHUNK, TEXT, TEXT_BY_RANGE = 2_000_000, 250_000, 50_000, 1 << 19, 1 << 22


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_FOLD


def word_counts(train: DataFrame) -> DataFrame:
    """w (XXH64 of the word, A-Z lower-cased), c; ends of texts are not among them."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = train.select(F.explode(F.split(low, r"[\x20\x09-\x0D]+")).alias("x")).filter("x <> ''")
    return each.groupBy(F.xxhash64("x").alias("w")).agg(F.count("*").alias("c"))


def gram_counts(train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """k (a gram, below 2^63), c."""
    assert depth <= 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in parts(batch.column(0)):
                k, c = ctw.counted(ctw.grams([b" ".join(ctw.canonical(t)) + ctw.END for t in part], depth))
                keys, counts, held = [*keys, k], [*counts, c], held + len(k)
                if held > 1_000_000:
                    k, c = ctw.merged(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [c], len(k) // 2
                    if len(k) > 700_000:
                        yield from sent(k, c)
                        keys, counts, held = [], [], 0
        if keys:
            yield from sent(*ctw.merged(np.concatenate(keys), np.concatenate(counts)))

    def sent(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(k), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 17)].view("i8")), pa.array(c[i : i + (1 << 17)].astype("i8"))], ["k", "c"])

    return train.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def parts(column: pa.Array, most: int = TEXT) -> Iterator[list[str | None]]:
    """The texts in runs of about ``most`` characters, or single longer texts."""
    run, size = [], 0
    for cell in column:
        text = cell.as_py()
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


class Model:
    """Ranges of contexts and the levels that they share."""

    def __init__(self, counts: DataFrame, depth: int = DEPTH, block: int = BLOCK):
        """``counts``: k, c, staged. Ranges are by the nearest bytes of context."""
        self.counts, self.depth, self.top = counts, depth, min(CUT, depth)
        self.shift = 8 * (depth - self.top + 1)
        by_context = counts.groupBy(F.shiftright("k", self.shift).alias("p")).count().toPandas().sort_values("p")
        self.ranges, held = [], 0
        for p, n in zip(by_context["p"].tolist(), by_context["count"].tolist(), strict=True):
            if not self.ranges or held + n > block:
                self.ranges.append([p << self.shift, 0])
                held = 0
            held += n
            self.ranges[-1][1] = (p + 1) << self.shift
        self._share()

    def _grams(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole subtrees, about ``CHUNK`` grams at a time."""
        got = self.counts.filter((F.col("k") >= lo) & (F.col("k") < hi)).toArrow()
        keys, counts = got["k"].to_numpy().view("u8"), got["c"].to_numpy()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        del got, order
        starts = np.flatnonzero(np.diff(keys >> np.uint64(self.shift), prepend=np.uint64(2**63)))
        at = 0
        while at < len(keys):
            later = starts[starts >= at + CHUNK]
            end = int(later[0]) if len(later) else len(keys)
            yield keys[at:end], counts[at:end]
            at = end

    def _share(self) -> None:
        """Weighs the levels of less context than the ranges are cut by, from what each subtree sums up to."""
        keys, counts, parents, weighted = [np.zeros(0, "u8")], [np.zeros(0, "i8")], [np.zeros(0, "u8")], [np.zeros(0)]
        for lo, hi in self.ranges:
            for k, c in self._grams(lo, hi):
                top = ctw.tree(k, c, self.depth, self.top)[0]
                a, b = top.above()
                keys.append(a)
                counts.append(b)
                nodes, at = np.unique(top.parents(), return_inverse=True)
                parents.append(nodes)
                weighted.append(np.bincount(at, top.weighted, len(nodes)))
        last = ctw.Level(*ctw.merged(np.concatenate(keys), np.concatenate(counts)))
        last.weigh_by(np.concatenate(parents), np.concatenate(weighted))
        self.shared = [last]
        for _ in range(self.top - 1):
            above = ctw.Level(*self.shared[0].above())
            above.weigh(self.shared[0])
            self.shared.insert(0, above)
        above = None
        for level in self.shared:
            level.mix(above)
            above = level

    def range_levels(self, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What a scorer of the range needs: grams and their bits' logs by depth."""
        found: list[list] = [[] for _ in range(self.depth - self.top + 1)]
        for k, c in self._grams(lo, hi):
            above = self.shared[-1]
            for d, level in enumerate(ctw.tree(k, c, self.depth, self.top)):
                level.mix(above)
                found[d].append((level.keys, level.logs()))
                above = level
        levels = [(x.keys, x.logs()) for x in self.shared]
        while found:  # a depth's parts go as soon as they are joined
            parts_ = found.pop(0)
            levels.append((np.concatenate([k for k, _ in parts_]), np.concatenate([v for _, v in parts_], 1)))
        return levels


def score(docs: DataFrame, train: DataFrame, depth: int = DEPTH, block: int = BLOCK, head: int = HEAD, **keep: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte and the columns ``keep`` of each row
    of ``docs`` (doc_id, text), by a model of ``train`` (text).

    A text is its words, A-Z lower-cased, with one space between them, and an end. score is the model's
    log10 probability of these bytes; bits_per_byte is its code length for each of them. base_score is that of the words and the end by counts with one
    added. Null and empty texts are the end alone; repeated rows are scored each; without training texts
    every bit has probability one half and only the end's and words' added counts remain. Texts of any length are scored whole;
    other columns, whatever they are called, are ignored unless kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    train = train.select(F.coalesce("text", F.lit("")).alias("text"))
    words = staged(word_counts(train), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n, v = n + ends, v + (ends > 0)
    least = 1
    while words.filter(F.col("c") >= least).count() > head:
        least *= 2
    frequent = words.filter(F.col("c") >= least).toArrow()
    known = spark.sparkContext.broadcast((frequent["w"].to_numpy().view("u8"), frequent["c"].to_numpy()))
    counts = staged(gram_counts(train, depth), "lm-grams")
    model = Model(counts, depth, block)
    ranges = [(lo, hi, spark.sparkContext.broadcast(model.range_levels(lo, hi))) for lo, hi in model.ranges]
    names = [*keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        table_ = ctw.Table(*known.value)
        scorer = ctw.Scorer(ranges[0][2].value) if len(ranges) == 1 else None
        for batch in batches:
            at = 0
            for texts in parts(batch.column("text"), TEXT if len(ranges) < 2 else TEXT_BY_RANGE):
                words_ = [ctw.canonical(t) for t in texts]
                streams = [b" ".join(w) + ctw.END for w in words_]
                total = np.zeros(len(texts))
                firsts = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
                grams = ctw.grams(streams, depth)
                if scorer:
                    total += np.add.reduceat(scorer.score(grams), firsts[:-1])
                elif not ranges:
                    total += np.diff(firsts) * 8 * np.log10(0.5)
                else:
                    total += np.add.reduceat(by_range(grams), firsts[:-1])
                sizes = np.array([len(w) for w in words_])
                hashes = np.fromiter((xxh64_intdigest(w, 42) for ws in words_ for w in ws), "u8", int(sizes.sum()))
                c = table_.get(hashes, 0.0)
                spans = np.concatenate(([0], np.cumsum(sizes)))
                sums = np.concatenate(([0.0], np.cumsum(np.log10(c + 1))))
                hits = np.concatenate(([0], np.cumsum(c > 0)))
                tails = [hashes[a:b][c[a:b] == 0].view("i8") for a, b in zip(spans[:-1], spans[1:], strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in tails])))
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tails)))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(x) for x in ["doc_id", *names]), pa.array(sizes.astype("i8")), pa.array(np.diff(hits[spans]).astype("i8")), pa.array(np.array([np.log10(c[a:b] + 1).sum() for a, b in zip(spans[:-1], spans[1:], strict=True)])), pa.array(total), pa.array(np.diff(firsts).astype("i8")), tail],
                    ["doc_id", *names, "_words", "_hits", "_sum", "score", "_bytes", "_tail"],
                )

    def by_range(grams: np.ndarray) -> np.ndarray:
        """Grams outside all ranges have contexts that no training text has beyond one byte."""
        out, todo = np.zeros(len(grams)), np.ones(len(grams), bool)
        for i, (lo, hi, levels) in enumerate(ranges):
            mine = (grams >= np.uint64(lo)) & (grams < np.uint64(hi))
            if i == len(ranges) - 1:
                mine = todo
            if mine.any():
                out[mine] = ctw.Scorer(levels.value).score(grams[mine])
                todo &= ~mine
                if hasattr(levels, "_value"):
                    del levels._value  # one range's model in memory at a time
        return out

    kept = docs.select("doc_id", *(c.alias(k) for k, c in keep.items()))
    schema = kept.schema.add("_words", "long").add("_hits", "long").add("_sum", "double").add("score", "double").add("_bytes", "long").add("_tail", T.ArrayType(T.LongType()))
    rows = docs.select("doc_id", *(c.alias(k) for k, c in keep.items()), "text").mapInArrow(run, schema)
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-rows")
    rare = words.filter(F.col("c") < least)
    tail = rows.select("_row", F.explode("_tail").alias("w")).join(rare, "w").groupBy("_row").agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("c") + 1)).alias("_plus"))
    scale = float(np.log10(n + v + 1))
    end = float(np.log10(ends + 1))
    out = rows.join(tail, "_row", "left")
    base = F.col("_sum") + F.coalesce("_plus", F.lit(0.0)) + end - (F.col("_words") + 1) * scale
    n_known = F.col("_hits") + F.coalesce("_more", F.lit(0)) + int(ends > 0)
    return out.select("doc_id", *names, (F.col("_words") + 1).alias("n_tokens"), n_known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("_bytes")).alias("bits_per_byte"))


def op5_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, docs.filter(~held_out()), held_out=held_out())
