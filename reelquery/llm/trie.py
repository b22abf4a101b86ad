"""The prefix trie of conversations: what training or serving saves when shared openings are computed once.

Every conversation's turns are chained: a prefix's digest is the SHA-256 of the shorter prefix's digest and its last turn.
Each prefix is a row, and rows that agree in (depth, digest) are a node, named by its smallest member. If a member is the smallest at
one node it is so at all nodes further down its own branch, so a conversation names a path: a run of depths that ends with
it. Sums over subtrees are taken by exploding each path, at its top, to all its ancestors, the deepest node of
each other path that it hangs from, and running sums from the bottom of a path up. So a conversation of n turns costs n rows and not n
squared.

Texts are read once, for digests and counts; from there on rows are narrow. What a chain is made of passes one task in order,
one row at a time, so does the digest over a node's ends, which are dealt by ranges into blocks of ids first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, hinted, staged, table

BROADCAST_ROWS = 500_000
#: Conversations of a family share their opening; at most so many turns of it.
FAMILY, SHARED = 20, 3
#: Ids of a block over which a node's ends are digested.
IDS = 16_384
NONE = hashlib.sha256(b"").hexdigest()

CHAIN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("digest", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_())])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, x (digest of role and text), words (of the text): a narrow row for each turn of a named conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    x = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), x.alias("x"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def in_order() -> list[Column]:
    """Null turns first; turns with the same number by their digest."""
    return [F.col("turn").asc_nulls_first(), F.col("x")]


def plain(rows: DataFrame) -> DataFrame:
    """Conversations as they are: own turns, none of which is left out."""
    return rows.select("conv_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("skip"), "turn", "x", "words")


def grafted(rows: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % family in place of its own first h, where h is the CRC-32 of c's
    decimal form modulo shared + 1. Turns that the other doesn't have are left out."""
    skip = F.when(F.col("conv_id") % family == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (shared + 1)).cast("long")
    own = plain(rows).withColumn("skip", skip)
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(*in_order()))
    heads = rows.filter(F.col("conv_id") % family == 0).withColumn("at", at).filter(F.col("at") <= shared).select(F.col("conv_id").alias("head"), F.col("at").cast("long").alias("turn"), "x", "words")
    of = own.filter("skip > 0").select("conv_id", "skip").distinct().withColumn("head", F.col("conv_id") - F.col("conv_id") % family)
    taken = of.join(heads, "head").filter(F.col("turn") <= F.col("skip"))
    return taken.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("skip"), "turn", "x", "words").union(own)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation in order -> a row for each prefix, the empty one included. The last row waits for the next one."""
    columns = tuple([] for _ in CHAIN)
    conv = depth = own = None
    digest = b""

    def add(*row) -> None:
        for column, value in zip(columns, row, strict=True):
            column.append(value)

    def out(n: int) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c[:n], f.type) for c, f in zip(columns, CHAIN, strict=True)], schema=CHAIN)
        for column in columns:
            del column[:n]
        return batch

    for b in batches:
        for c, kind, skip, x, words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if c != conv:
                if conv is not None:
                    columns[-1][-1] = True
                conv, depth, own, digest = c, 0, 0, b""
                add(c, 0, None, digest, 0, False)
            own += kind
            if kind and own <= skip:
                continue
            depth, parent = depth + 1, digest
            digest = hashlib.sha256(parent + x).digest()
            add(c, depth, parent, digest, words, False)
        if len(columns[0]) > 1:
            yield out(len(columns[0]) - 1)
    if conv is not None:
        columns[-1][-1] = True
        yield out(1)


def chained(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent, digest, words, ends (whether the conversation goes no further) for each prefix."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *in_order())
    return dealt.select("conv_id", "kind", "skip", "x", "words").mapInArrow(_chained, "conv_id long, depth long, parent binary, digest binary, words long, ends boolean")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, conv_id in order -> digest, the first id and all ids as text, of up to IDS rows of one digest."""
    node, ids = None, []
    for b in batches:
        found = []
        for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest != node or len(ids) == IDS:
                if ids:
                    found.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = digest, []
            ids.append(conv)
        yield _of(found, [pa.binary(), pa.int64(), pa.string()], ["digest", "first", "ids"])
    if ids:
        yield _of([(node, ids[0], ",".join(map(str, ids)))], [pa.binary(), pa.int64(), pa.string()], ["digest", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of (digest, first) -> digest, the SHA-256 of its ids, comma-joined."""
    node, sha = None, None
    for b in batches:
        found = []
        for digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if digest != node:
                if node is not None:
                    found.append((node, sha.hexdigest()))
                node, sha = digest, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield _of(found, [pa.binary(), pa.string()], ["digest", "ends_sha256"])
    if node is not None:
        yield _of([(node, sha.hexdigest())], [pa.binary(), pa.string()], ["digest", "ends_sha256"])


def _of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def ends(chain: DataFrame) -> DataFrame:
    """digest, ends_sha256 over the ids of the conversations that end at a node, ascending."""
    rows = chain.filter("ends").select("digest", "conv_id")
    blocks = rows.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_blocks, "digest binary, first long, ids string")
    return blocks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_digested, "digest binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, kind, skip, turn, x, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    chain = staged(chained(rows), "trie-chain")
    node = chain.filter("depth > 0").groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.count_if("ends").alias("n_ends"))
    nodes = staged(node.select("conv_id", "depth", "digest", "n_convs", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie-nodes")
    paths = staged(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves")), "trie-paths")
    # each path meets its ancestors by the digests of its own chain above its top; of each other path the deepest counts
    above = chain.filter("depth > 0").select(F.col("conv_id").alias("path"), "depth", "digest").join(paths.filter("top > 1").withColumnRenamed("conv_id", "path"), "path").filter("depth < top")
    named = above.join(nodes.select("digest", F.col("conv_id").alias("owner")), "digest")
    hung = staged(named.groupBy("path", "owner", "top", "leaves", "saves").agg(F.max("depth").alias("depth")), "trie-ancestors")
    zero, null = F.lit(0).cast("long"), lambda kind: F.lit(None).cast(kind)
    direct = F.col("depth") == F.col("top") - 1
    own = nodes.select("conv_id", "depth", "digest", "n_convs", "leaf", "saved", zero.alias("hung"), null("long").alias("parent"))
    below = hung.select(F.col("owner").alias("conv_id"), "depth", null("binary"), null("long"), "leaves", "saves", direct.cast("long"), null("long"))
    tops = hung.filter(direct).select(F.col("path").alias("conv_id"), F.col("top").alias("depth"), null("binary"), null("long"), zero, zero, zero, F.col("owner"))
    sums = own.union(below).union(tops).groupBy("conv_id", "depth").agg(*(F.max(c).alias(c) for c in ("digest", "n_convs", "parent")), *(F.sum(c).alias(c) for c in ("leaf", "saved", "hung")))
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    first = F.lag("depth").over(up).isNull()
    whole = sums.select("conv_id", "depth", "digest", "n_convs", "parent", (F.col("hung") + (~first).cast("long")).alias("n_children"), F.sum("leaf").over(up).alias("n_leaves"), F.sum("saved").over(up).alias("saved_tokens"), F.lead("depth").over(up).isNotNull().alias("within"))

    root = chain.filter("depth = 0").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not root["n"]:
        return rows.sparkSession.createDataFrame([], NODES)
    parent = F.when(F.col("within"), F.col("conv_id")).otherwise(F.coalesce("parent", F.lit(root["conv_id"])))
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    under = whole.select("conv_id", "depth", "digest", parent.alias("parent_conv_id"), *counts)
    sum_of = lambda c: F.coalesce(F.sum(c), zero)
    children = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(sum_of("leaf"), F.lit(1)).cast("long").alias("n_leaves"), sum_of("saved").alias("saved_tokens"))
    top = children.select(F.lit(root["conv_id"]).alias("conv_id"), zero.alias("depth"), F.lit(b"").alias("digest"), null("long").alias("parent_conv_id"), F.lit(root["n"]).alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    done = ends(chain).withColumnRenamed("digest", "_at")
    return under.union(top).join(done, F.col("digest") == F.col("_at"), "left").select("conv_id", "depth", "parent_conv_id", *counts, F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, graft: bool = False) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text), the root included.

    Null roles and texts count as empty, null turns come first, turns of the same number stand in the order of their digests, and
    repeated rows are turns each. Rows without a conv_id belong to no conversation. Texts of any length are digested whole.
    Other columns are ignored; an empty table gives an empty result. With ``graft``, families share openings (``grafted``).
    """
    rows = staged(turns(conversations), "trie-turns")
    return trie(grafted(rows) if graft else plain(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), graft=True)


SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
                  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations),
o AS (SELECT c, list(x ORDER BY i) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
               lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) & 1)))),
               lambda s, b: xor(s >> 1, 3988292384 * xor(s & 1, b))), 4294967295) % 4 AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(p.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs FROM h LEFT JOIN h p ON p.c = h.c - h.c % 20),
e AS (SELECT c, len(xs) AS n, unnest(range(len(xs) + 1)) AS d, xs FROM b),
p AS (SELECT c, d, n, sha256(CAST(xs[1:d] AS VARCHAR)) AS k, sha256(CAST(xs[1:d - 1] AS VARCHAR)) AS up, xs[d].t AS t FROM e),
v AS (SELECT d, k, min(c) AS c, any_value(up) AS up, count(*) AS m, count(*) FILTER (n = d) AS stop, any_value(t) AS t,
             coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ids FROM p GROUP BY d, k),
w AS (SELECT *, CAST(stop = m AS BIGINT) AS leaf, CASE WHEN d = 0 THEN 0 ELSE (m - 1) * len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) END AS saved FROM v),
a AS (SELECT p.d, p.k, sum(w.leaf) AS leaves, sum(w.saved) AS saved FROM w JOIN p ON p.c = w.c AND p.d <= w.d GROUP BY p.d, p.k)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, q.c AS parent_conv_id, w.m AS n_convs,
       (SELECT count(*) FROM w z WHERE z.d = w.d + 1 AND z.up = w.k) AS n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN a ON a.d = w.d AND a.k = w.k LEFT JOIN w q ON q.d = w.d - 1 AND q.k = w.up AND w.d > 0
"""
