"""Pairs of texts whose sets of word shingles are similar, linked by their fingerprints.

Texts that agree on one of ``BANDS`` bands of ``ROWS`` min-hashes are compared by their whole sets: two at
similarity 0.8 miss each other with a chance of about 3 in a million. A band's key with two texts gives its pair
directly; keys with the same texts are searched once, larger ones outwards from a text, in parts of so many shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hinted, staged

WORDS, SEED = 5, 42
BANDS, ROWS = 32, 5
#: Shingles of a part of a key's texts.
TILE = 1_000_000
BROADCAST_ROWS = 500_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of a text's distinct shingles, sorted; of the whole text if it has fewer words."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, "u8")
    return np.unique(np.array([xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(max(1, len(tokens) - words + 1))], "u8"))


def _bands(found: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(11)
    odd, flip = rng.integers(0, 2**63, (2, BANDS * ROWS, 1), "u8")
    least = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048] ^ flip) * (2 * odd + np.uint64(1))).min(1))
    return [xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]


def _mapped(docs: DataFrame, words: int, what, kind: str) -> DataFrame:
    """h (of the text), fp, n (shingles) and x, which ``what`` makes of the shingles; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .simhash import fingerprint

        for part in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            rows = []
            for h, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = shingles(text.as_py(), words)
                if len(found):
                    rows.append((h, fingerprint(text.as_py()), len(found), np.array(what(found), "u8").view("i8")))
            a, b, c, d = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.array(b, "u8").view("i8")), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["h", "fp", "n", "x"])

    return docs.mapInArrow(run, f"h long, fp long, n long, x {kind}")


def _stars(least: float):
    """The texts of one part -> edges between fingerprints that connect all similar ones."""

    def search(rows: pa.Table) -> pa.Table:
        fps, n = rows["fp"].to_numpy(), rows["n"].to_numpy()
        x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values, x = np.unique(x, return_inverse=True)
        sets = np.split(x, np.cumsum(n)[:-1])
        rest, edges = np.arange(len(fps)), []
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            queue = [root]
            while queue and len(rest):
                at = queue.pop()
                mark = np.zeros(len(values), "i8")
                mark[sets[at]] = 1
                both = np.add.reduceat(mark[np.concatenate([sets[i] for i in rest])], np.cumsum(n[rest]) - n[rest])
                near = both >= least * (n[at] + n[rest] - both)
                queue.extend(rest[near])
                edges.extend((fps[root], fps[i]) for i in rest[near])
                rest = rest[~near]
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def links(docs: DataFrame, least: float, words: int = WORDS, tile: int = TILE) -> DataFrame:
    """Edges a, b between fingerprints that connect all texts of ``docs`` whose shingles' Jaccard similarity is ``least`` or more."""
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    seen = staged(_mapped(texts, words, _bands, "array<long>").dropDuplicates(["h"]), "similar-bands")
    keyed = seen.select("h", "n", F.explode("x").alias("key"))
    sums = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("h").alias("a"), F.max("h").alias("b"), F.bit_xor(F.xxhash64("h")).alias("all"), F.sum("n").alias("size")).filter("m > 1")
    # keys that hold the same texts are one
    sums = staged(sums.groupBy("m", "a", "b", "all", "size").agg(F.min("key").alias("key")), "similar-keys")
    pairs = sums.filter("m = 2").select("a", "b").distinct()
    large = hinted(staged(sums.filter("m > 2").select("key", F.ceil(F.col("size") / tile).cast("int").alias("parts")), "similar-large"), BROADCAST_ROWS)
    members = staged(keyed.join(large, "key").select("key", "parts", "h"), "similar-members")
    wanted = members.select("h").union(pairs.select("a")).union(pairs.select("b")).distinct()
    asked = texts.join(hinted(staged(wanted, "similar-wanted"), BROADCAST_ROWS), "h", "left_semi")
    sets = staged(_mapped(asked, words, lambda found: found, "array<long>").dropDuplicates(["h"]), "similar-sets")
    left, right = (sets.select(F.col("h").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("fp", "n", "x"))) for s in ("a", "b"))
    both = F.size(F.array_intersect("x_a", "x_b"))
    close = pairs.join(left, "a").join(right, "b").filter(both >= least * (F.col("n_a") + F.col("n_b") - both)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    p = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = members.withColumn("p", p).select("key", "h", "p", others.alias("q")).select("key", "h", F.least("p", "q").alias("t"), F.greatest("p", "q").alias("u"))
    found = dealt.join(sets, "h").groupBy("key", "t", "u").applyInArrow(_stars(least), "a long, b long")
    return close.union(found).filter("a <> b").distinct()
