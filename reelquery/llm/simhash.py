"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Fingerprints are cut into six blocks. Two that differ in at most three bits agree on at least three whole
blocks, so they meet under one of the twenty choices of three blocks, whose 31 to 33 bits are the join
key. Equal fingerprints are one class throughout. A key with two classes gives its pair directly. The
classes of larger keys are searched group by group: from a class outwards, each class taking what lies
within the bound of it out of the rest, so a group gives one edge for each class found and never its
pairs. Groups beyond ``TILE`` are split by the bits that their key leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import field, hinted, sealed, staged, table, unsealed
from .components import components
from .similar import links as similar_links

WORDS, BITS, SEED = 3, 3, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
TILE = 8192
BROADCAST_ROWS = 500_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64, repeats included."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), "int64", len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, "int64")
    for at in range(0, len(starts), 1 << 16):
        h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column("_text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def masks() -> list[int]:
    """Signed 64-bit masks of all choices of three blocks."""
    ends = np.cumsum(BLOCKS)
    block = [((1 << n) - 1) << int(e - n) for n, e in zip(BLOCKS, ends, strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in combinations(block, 3))]


def _stars(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what the links within ``fps`` connect."""
    rest, found = np.unique(fps), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= bits
            if near.any():
                new, rest = rest[near], rest[~near]
                queue.extend(new)
                found.append((root, new))
    return found


def _searched(bits: int):
    """Batches sorted by group -> edges; a group may run over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(groups) -> pa.RecordBatch:
            got = [(np.full(len(new), root), new) for g in groups for root, new in _stars(g, bits)]
            a, b = (np.concatenate(x) if got else np.zeros(0, "u8") for x in (zip(*got, strict=True) if got else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(x.view("i8")) for x in (a, b)], ["a", "b"])

        open_key, open_fps = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in GROUP], 1)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view("u8")
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            parts, firsts = np.split(fps, cuts), keys[np.concatenate(([0], cuts))] if len(keys) else []
            done = []
            for key, part in zip(map(tuple, firsts), parts, strict=False):
                if key != open_key:
                    if open_fps:
                        done.append(np.concatenate(open_fps))
                    open_key, open_fps = key, []
                open_fps.append(part)
            yield edges(done)
        if open_fps:
            yield edges([np.concatenate(open_fps)])

    return run


def links(classes: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Edges a, b between distinct fingerprints (``classes``: fp) that connect all within ``bits`` of each other."""
    assert bits <= len(BLOCKS) - 3
    choices = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks())))
    keyed = classes.select("fp", F.explode(choices).alias("c")).select("fp", "c.mask", "c.key")
    sums = staged(keyed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-keys")
    pairs = sums.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()
    large = hinted(staged(sums.filter("n > 2").select("mask", "key", (F.col("n") > tile).alias("split")), "simhash-large"), BROADCAST_ROWS)
    members = keyed.join(large, ["mask", "key"])
    groups = members.filter("NOT split").select("mask", "key", F.lit(-1).alias("slice"), F.lit(0).cast("long").alias("sub"), F.lit(0).alias("t"), F.lit(0).alias("u"), "fp")
    if not large.filter("split").isEmpty():
        groups = groups.union(_split(members.filter("split").select("mask", "key", "fp"), bits, tile))
    found = groups.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_searched(bits), "a long, b long")
    return pairs.union(found)


GROUP = ["mask", "key", "slice", "sub", "t", "u"]


def _split(members: DataFrame, bits: int, tile: int) -> DataFrame:
    """The members of large keys in smaller groups. Under one key, fingerprints differ only in the bits that it leaves
    out; cut into one slice more than may differ, two that are linked agree on one of them as well. What is
    still large then is dealt into parts, and each two parts are searched together."""

    def slices(mask: int) -> list[int]:
        rest = [i for i in range(64) if not mask >> i & 1]
        found = [sum(1 << i for i in rest[j :: bits + 1]) for j in range(bits + 1)]
        return [m - (1 << 64) if m >> 63 else m for m in found]

    by_mask = F.array(*(F.array(*map(F.lit, slices(m % (1 << 64)))).cast("array<long>") for m in masks()))
    each = members.select("mask", "key", "fp", F.posexplode(F.element_at(by_mask, F.col("mask") + 1)).alias("slice", "m")).withColumn("sub", F.col("fp").bitwiseAND(F.col("m"))).drop("m")
    key = ["mask", "key", "slice", "sub"]
    counts = each.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key, F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    dealt = each.join(hinted(staged(counts, "simhash-slices"), BROADCAST_ROWS), key).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*key, F.least("p", "q").alias("t"), F.greatest("p", "q").alias("u"), "fp")


def grouped(rows: DataFrame, bits: int = BITS, further: DataFrame | None = None) -> DataFrame:
    """fp, root for the fingerprints of ``rows`` (fp) that are linked to others, by ``further`` edges (a, b) too;
    root names the component."""
    classes = staged(rows.select("fp").distinct(), "simhash-classes")
    edges = links(classes, bits)
    return components(edges if further is None else edges.union(further)).withColumnsRenamed({"node": "fp"})


def near_duplicates(docs: DataFrame, *keep: str, words: int = WORDS, bits: int = BITS, similar: float | None = None) -> DataFrame:
    """The columns ``keep`` of each row, fp, root and component_id, the least doc_id of the rows whose
    fingerprints are reached over links.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows of equal text share their
    component, repeated rows are returned each, null ids never name a component that has another id. Texts of any length are
    read whole; other columns, whatever they are called, are ignored; an empty table gives an empty result. With ``similar``, rows whose
    sets of five-word shingles have that Jaccard similarity or more are linked as well.
    """
    assert similar is None or words == WORDS  # the links name default fingerprints
    rows = staged(fingerprints(docs, *dict.fromkeys(("doc_id", *keep)), words=words), "simhash-rows")
    further = None if similar is None else similar_links(docs, similar)
    roots = staged(grouped(rows, bits, further), "simhash-roots")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n"))
    # a class of one row and no links is its own component, so only the others are joined to the rows
    known = classes.join(hinted(roots, BROADCAST_ROWS), "fp", "left").filter("_n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp"))
    known = staged(known, "simhash-known")
    least = known.groupBy("root").agg(F.min("_least").alias("_component"))
    named = hinted(staged(known.join(least, "root").select("fp", "root", "_component"), "simhash-named"), BROADCAST_ROWS)
    out = rows.join(named, "fp", "left")
    return out.select(*rows.columns, F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"))


def representatives(docs: DataFrame, similar: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component: the one of least (doc_id, text hash), null ids last."""
    marked = sealed(docs).withColumns({"doc_id": field("doc_id"), "_h": F.xxhash64(field("text"))})
    slim = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = staged(near_duplicates(slim, "_h", similar=similar).select("doc_id", "_h", "root"), "simhash-ids")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_h")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    of = rows.join(hinted(staged(first, "simhash-first"), BROADCAST_ROWS), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("_h") == F.col("f._h"))
    keys = of.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(F.max(stays).alias("_stays"), F.count("*").alias("_rows")).filter("NOT _stays OR _rows > 1")
    out = marked.join(hinted(staged(keys, "simhash-gone"), BROADCAST_ROWS), F.expr("doc_id <=> _d AND _h = _g"), "left")
    single = out.filter("_stays IS NULL").select("row")
    return unsealed(single.union(out.filter("_stays").dropDuplicates(["_d", "_g"]).select("row")), docs.columns)


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def hexed(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
