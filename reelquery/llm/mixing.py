"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, ``-ln(u) / quality``, with ``u`` drawn from a hash of its
id, so reruns agree. Within a source, documents in ascending key order form a weighted sample
without replacement. A source whose target holds whole epochs takes all its documents that many
times; the rest of the target is the prefix of the key order whose words come nearest to it.

The key order is never materialised for a whole source. Keys map monotonically to 48-bit positions, by their
logarithm, so that large keys are told apart as well as small ones; four rounds of 4096-way sums per source find the
position where the budget ends, and only documents at that one position are sorted. What each source needs is then one row: its epochs and the last key
taken. Documents join it by source, without a shuffle while sources are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, field, hinted, sealed, staged, table, unsealed

CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Sources up to this many are broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """Share of letters and white space among a text's characters, 0.05 at least."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\s]", ""))
    return F.greatest(F.lit(0.05), F.coalesce(letters / F.nullif(F.length(t), F.lit(0)), F.lit(0.0)))


def keyed(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text and others) with _size, _key (ascending: taken first) and _at, the key's 48-bit
    position. The draw is by id and text, so rows without ids or with the same id are drawn each."""
    drawn = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    bits = F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10)
    u = (bits.cast("double") + 0.5) / float(2**52)
    keyed = docs.withColumns({"_size": word_count(), "_key": -F.ln(u) / (quality() if weight is None else weight)})
    # keys lie between 2^-53 and 37 over the least weight, so logarithms between -64 and 64
    at = F.floor((F.ln(F.col("_key")) + 64) * float(2**41))
    return keyed.withColumn("_at", F.greatest(F.lit(0), F.least(at, F.lit(2**48 - 1))).cast("long"))


def targets(sizes: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> the same with target.

    Sources by code point, null last, weigh ``cycle`` repeating and share the sum of all sizes; none
    gets over ``max_epochs`` times its size, and the excess goes to the others by weight. In order of
    cap over weight, the capped sources come first; the level at the first uncapped one is the share
    of a unit of weight. The windows hold one row a source.
    """
    all_ = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    caps = sizes.withColumns({"_w": w.cast("long"), "_cap": F.col("source_size") * max_epochs, "_all": F.sum("source_size").over(all_)})
    caps = caps.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    caps = caps.withColumn("_level", level)
    share = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source", "_level"))).over(all_)["_level"]
    return caps.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * share).alias("target"))


def plan(rows: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target, epochs and _cut, the last (key, doc_id, size)
    of the fractional epoch (null: none). ``rows``: doc_id, source, _size, _key, _at."""
    goal = targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), cycle, max_epochs)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    goal = staged(goal.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goal")
    at = goal.select("source", "_rest", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    for shift in (36, 24, 12, 0):
        s = hinted(at, BROADCAST_SOURCES) if shift == 36 else at
        here = rows.alias("r").join(s.alias("s"), F.expr(f"r.source <=> s.source AND shiftright(r._at, {shift + 12}) = s._prefix"))
        sums = here.groupBy(F.col("s.source").alias("source"), F.expr(f"shiftright(_at, {shift})").alias("_p"), "_rest", "_before").agg(F.sum("_size").alias("_n"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("source").orderBy("_p"))
        step = sums.withColumn("_to", upto).filter("_to > _rest").groupBy("source", "_rest").agg(F.min(F.struct("_p", (F.col("_to") - F.col("_n")).alias("_from"))).alias("m"))
        at = hinted(staged(step.select("source", "_rest", F.col("m._p").alias("_prefix"), F.col("m._from").alias("_before")), "mix-at"), BROADCAST_SOURCES)
    here = rows.alias("r").join(at.alias("s"), F.expr("r.source <=> s.source AND r._at = s._prefix"))
    same = here.groupBy(F.col("s.source").alias("source"), "_key", "doc_id", "_size", "_rest", "_before").agg(F.sum("_size").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("source").orderBy("_key", "doc_id", "_size"))
    inside = same.withColumn("_to", upto).filter("_to - _n / 2 <= _rest")
    last = inside.groupBy("source").agg(F.max(F.struct("_key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "_size")).alias("_last"))
    at = at.join(last.withColumnRenamed("source", "_s"), F.expr("source <=> _s"), "left").select(F.col("source").alias("_s"), "_prefix", "_last")
    return goal.join(at, F.expr("source <=> _s"), "left").select("source", "source_size", "target", "epochs", "_prefix", "_last")


def decided(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with _source_size, _target, _copies: how often the mix takes each document."""
    p = hinted(staged(per_source, "mix-plan"), BROADCAST_SOURCES).withColumnsRenamed({"source": "_source", "source_size": "_source_size", "target": "_target", "epochs": "_epochs"})
    mine = F.struct("_key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "_size")
    extra = F.coalesce((F.col("_at") < F.col("_prefix")) | ((F.col("_at") == F.col("_prefix")) & (mine <= F.col("_last"))), F.lit(False))
    return rows.join(p, F.expr("source <=> _source")).withColumn("_copies", F.when(F.col("_size") > 0, F.col("_epochs") + extra.cast("long")).otherwise(0))


def mix(docs: DataFrame, weight: Column | None = None, cycle=CYCLE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row of ``docs``.

    Whole documents are taken, so a source misses its target by at most half of one document, or half of a group
    of rows that agree in id and text, which are taken alike. Null or empty texts have size 0 and are never
    taken; a null source is a source of its own, the last in order; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = staged(keyed(docs.select("doc_id", "text", "source"), weight, seed).select("doc_id", "source", "_size", "_key", "_at"), "mix-rows")
    out = decided(rows, plan(rows, cycle, max_epochs))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), "source")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = staged(keyed(docs.select("doc_id", "text", "source"), **options).select("doc_id", "source", "_size", "_key", "_at"), "mix-rows")
    whole = sealed(docs).select("row", *(field(c).alias(c) for c in ("doc_id", "text", "source")))
    out = decided(keyed(whole, **options), plan(rows)).filter("_copies > 0")
    return unsealed(out.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy")), docs.columns)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         greatest(CAST(0.05 AS DOUBLE), coalesce(CAST(length(regexp_replace(coalesce(text, ''), '[^\p{L}\s]', '', 'g')) AS DOUBLE)
           / nullif(length(coalesce(text, '')), 0), CAST(0 AS DOUBLE))) AS q,
         (CAST(CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
k AS (SELECT *, -ln(u) / q AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM k GROUP BY source),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM c) - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
             / CAST((SELECT sum(w) FROM c) - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
      FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE),
             w * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM l),
e AS (SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, k.source, e.source_size, e.target, e.epochs,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies, source
FROM (SELECT *, CASE WHEN size = 0 THEN CAST(0 AS BIGINT)
                ELSE epochs + CAST(upto - size / CAST(2 AS DOUBLE) <= target - epochs * source_size AS BIGINT) END AS copies FROM p)
"""
