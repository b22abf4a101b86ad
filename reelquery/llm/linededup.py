"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as sequences of words; white space doesn't count. A line goes if an earlier one, by
(doc_id, line number), has the same words, or if one edit (a word put in, left out or replaced) leads from one
to the other and that is no more than one in ``PER_EDIT`` words of the longer one. The bound is relative for
every length: "Chapter 1" and "Chapter 2" are a half apart and both stay. Blank lines stay.

Every line's variants are the line without its i-th word, as hashed keys. Two lines that share variant and
i differ by one replacement at most; a line that equals another's variant lacks one of its words. So
per key only the earliest line is needed, and no pairs are listed: lines that come later name the
earliest one as witness, and the edit distance to it is then verified on the words.

Only lines that may have a partner emit variants. One edit leaves the first or the last half of a line as it
is, so partners share a hash of a half; lines that share none are left out before anything is exploded.
A variant's hash is the exclusive or of hashes of (word, place): what stands behind the missing word
moves down by one, so running sums give all variants of a line in linear time.

Lines and variants are named by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import field, hinted, mix64, sealed, staged, table, unsealed

PER_EDIT = 8
BROADCAST_ROWS = 1_000_000
#: A line's place is doc_id * LINES + line number; a null id comes first.
LINES = 2**31
PLACE = "decimal(31,0)"


def words(line: Column) -> Column:
    """Words of a line; splitting at single blanks needs no regular expression."""
    for blank in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def place(doc_id: str, line: str) -> Column:
    doc = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    return (doc * F.lit(LINES).cast("decimal(10,0)") + F.col(line)).cast(PLACE)


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, _t (hash of the text), line (number), text: one row a line."""
    return docs.select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split("text", "\n")).alias("line", "text"))


def halves(w: Column, n: Column) -> Column:
    """Hashes of the first and the last half, as a line of n words and as one of n - 1 with a word put in."""

    def keys(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(2 * m, F.slice(w, F.lit(1), h)), F.xxhash64(2 * m + 1, F.slice(w, n - (m - h) + 1, m - h))]

    return F.array(*keys(n), *keys(n - 1))


def occurrences(docs: DataFrame) -> DataFrame:
    """A narrow row for each line: its document, place, 128 bits of hash, number of words and half keys."""
    rows = exploded(docs).withColumn("w", words(F.col("text"))).withColumn("n", F.size("w"))
    # a line one word short of the bound may be an edit of a longer one
    rows = rows.withColumn("k", F.when(F.col("n") >= PER_EDIT - 1, halves(F.col("w"), F.col("n"))))
    shorter = lambda i: F.when(F.col("n") >= PER_EDIT, F.col("k")[i]) if i > 1 else F.col("k")[i]
    return rows.select("doc_id", "_t", "line", place("doc_id", "line").alias("place"), F.xxhash64("w").alias("h1"), mix64("w").alias("h2"), *(shorter(i).alias(f"k{i}") for i in range(4)))


def blank() -> Column:
    """The hash of a line without words."""
    return F.xxhash64(F.array().cast("array<string>"))


def candidates(distinct: DataFrame) -> DataFrame:
    """The distinct lines that share a half with another."""
    keys = distinct.filter("k0 IS NOT NULL").select("h1", "h2", "at", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k")).filter("k IS NOT NULL")
    shared = staged(keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "line-halves")
    return keys.join(hinted(shared, BROADCAST_ROWS), "k", "left_semi").select("h1", "h2", "at").distinct()


def variants(lines: DataFrame) -> DataFrame:
    """v1, v2, i, h1, h2, place for each line (h1, h2, place, w): its variants by missing word, and itself at i = -1.
    A line that is too short to be the longer one of a pair emits itself alone."""
    each = lines.select("h1", "h2", "place", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    here, moved = F.xxhash64("x", "i"), F.xxhash64("x", F.col("i") - 1)
    each = each.select("h1", "h2", "place", "n", "i", here.alias("f1"), moved.alias("g1"), mix64("x", "i").alias("f2"), mix64("x", F.col("i") - 1).alias("g2"))
    line, whole = Window.partitionBy("h1", "h2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("h1", "h2")
    each = each.withColumns({f"_{c}": F.bit_xor(c).over(line) for c in ("f1", "g1", "f2", "g2")} | {f"_all{k}": F.bit_xor(f"g{k}").over(whole) for k in (1, 2)})
    without = [F.col(f"_f{k}").bitwiseXOR(F.col(f"f{k}")).bitwiseXOR(F.col(f"_all{k}")).bitwiseXOR(F.col(f"_g{k}")) for k in (1, 2)]
    own = F.when(F.col("i") == F.col("n") - 1, F.struct(F.col("_f1").alias("v1"), F.col("_f2").alias("v2"), F.lit(-1).alias("i")))
    one = F.when(F.col("n") >= PER_EDIT, F.struct(without[0].alias("v1"), without[1].alias("v2"), F.col("i")))
    return each.select("h1", "h2", "place", F.inline(F.array_compact(F.array(one, own))))


def witnesses(v: DataFrame) -> DataFrame:
    """h1, h2, witness: the place of the earliest line before it with which a line shares a key."""
    key = ["v1", "v2"]
    replaced = v.filter("i >= 0").groupBy(*key, "i").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select(*key, "i", "first")
    missing = v.groupBy(*key).agg(F.min(F.when(F.col("i") >= 0, F.col("place"))).alias("longer"), F.min(F.when(F.col("i") < 0, F.col("place"))).alias("shorter")).filter("longer IS NOT NULL AND shorter IS NOT NULL")
    replaced, missing = (hinted(staged(x, "line-keys"), BROADCAST_ROWS) for x in (replaced, missing))
    by_replaced = v.join(replaced, [*key, "i"]).select("h1", "h2", "place", F.col("first").alias("witness"))
    by_missing = v.join(missing, key).select("h1", "h2", "place", F.when(F.col("i") >= 0, F.col("shorter")).otherwise(F.col("longer")).alias("witness"))
    return by_replaced.union(by_missing).filter("witness < place").groupBy("h1", "h2", "place").agg(F.min("witness").alias("witness"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether one word put in, left out or replaced leads from a to b (or none does)."""
    na, nb = F.size(a), F.size(b)
    same = lambda x, y: F.zip_with(x, y, lambda p, q: p == q)
    longer, shorter = F.when(na > nb, a).otherwise(b), F.when(na > nb, b).otherwise(a)
    ns = F.least(na, nb)
    at = F.array_position(same(F.slice(longer, F.lit(1), ns), shorter), False).cast("int")
    behind = F.slice(longer, at + 1, ns - at + 1) == F.slice(shorter, F.greatest(at, F.lit(1)), ns - at + 1)
    return F.when(na == nb, F.size(F.filter(same(a, b), lambda e: ~e)) <= 1).when(F.abs(na - nb) == 1, (at == 0) | behind).otherwise(False)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that an earlier one is one edit away from."""
    # a candidate is read from the document that it stands in first, by that document's id and text
    at = candidates(distinct).select("h1", "h2", "at.*")
    doc = F.floor(F.col("place") / F.lit(LINES)).cast("decimal(20,0)")
    line = (F.col("place") - doc * F.lit(LINES).cast("decimal(10,0)")).cast("int")
    wanted = at.select(F.when(doc >= -(2**63), doc).cast("long").alias("_d"), "_t", F.struct("h1", "h2", "place", line.alias("line")).alias("c"))
    wanted = hinted(staged(wanted.groupBy("_d", "_t").agg(F.collect_list("c").alias("c")), "line-candidates"), BROADCAST_ROWS)
    found = docs.withColumn("_h", F.xxhash64("text")).join(wanted, F.expr("doc_id <=> _d AND _h = _t")).select("c", F.split("text", "\n").alias("ls"))
    lines = found.select(F.inline(F.transform("c", lambda c: F.struct(c["h1"].alias("h1"), c["h2"].alias("h2"), c["place"].alias("place"), F.get("ls", c["line"]).alias("text")))))
    lines = lines.withColumn("w", words(F.col("text"))).filter((F.xxhash64("w") == F.col("h1")) & (mix64("w") == F.col("h2"))).select("h1", "h2", "place", "w")
    lines = staged(lines.dropDuplicates(["h1", "h2"]), "line-words", "zstd")
    named = witnesses(staged(variants(lines), "line-variants"))
    later = named.join(lines.select("h1", "h2", F.col("w").alias("a")), ["h1", "h2"])
    tested = later.join(lines.select(F.col("place").alias("witness"), F.col("w").alias("b")), "witness").filter(one_edit(F.col("a"), F.col("b")))
    return tested.select("h1", "h2").distinct()


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, _t, exact, near: for each document (doc_id, text) that loses lines, their numbers."""
    rows = staged(occurrences(docs), "lines")
    distinct = staged(rows.filter(F.col("h1") != blank()).groupBy("h1", "h2").agg(F.min(F.struct("place", "_t")).alias("at"), F.max("place").alias("last"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))), "line-distinct")
    near = near_lines(docs, distinct).withColumn("near", F.lit(True))
    gone = distinct.select("h1", "h2", F.col("at.place").alias("first"), "last").join(hinted(staged(near, "line-near"), BROADCAST_ROWS), ["h1", "h2"], "left").filter("near OR first < last")
    gone = hinted(staged(gone.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-gone"), BROADCAST_ROWS)
    out = rows.join(gone, ["h1", "h2"]).filter("near OR place > first")
    exact = F.col("place") > F.col("first")
    by_doc = out.groupBy("doc_id", "_t").agg(F.collect_set(F.when(exact, F.col("line"))).alias("exact"), F.collect_set(F.when(~exact, F.col("line"))).alias("near"))
    return staged(by_doc, "line-dropped")


def marked(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text without the lines that earlier documents have, and n_lines, n_exact, n_near:
    how many lines it had, and how many went as repeats and as near repeats.

    A null text stays null; one that loses all lines becomes empty. Rows with the same id and line number
    are at the same place, so none of them is later than the other: repeated rows keep the same lines, and so
    do different rows without an id.
    """
    found = hinted(dropped(docs.select("doc_id", "text")), BROADCAST_ROWS).select(F.col("doc_id").alias("_d"), F.col("_t").alias("_g"), F.col("exact").alias("_e"), F.col("near").alias("_n"))
    rows = sealed(docs).withColumns({"doc_id": field("doc_id"), "whole": field("text"), "_h": F.xxhash64(field("text"))})
    rows = rows.join(found, F.expr("doc_id <=> _d AND _h = _g"), "left")
    lines = F.split("whole", "\n")
    lost = F.concat("_e", "_n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(lost, i))
    text = F.when(F.col("_e").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return rows.select("row", text.alias("text"), F.when(F.col("whole").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), count("_e").alias("n_exact"), count("_n").alias("n_near"))


def deduped(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, text without its later lines. An empty table gives an empty result."""
    return unsealed(marked(docs), docs.columns, text=F.col("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "documents")).select(field("doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_exact").cast("long").alias("exact_dropped"), F.col("n_near").cast("long").alias("near_dropped"), "text")


SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM s),
o AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
d AS (SELECT w, min({'d': doc_id, 'i': i}) AS p FROM o WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, p, unnest(range(len(w))) AS j FROM d WHERE len(w) >= 8),
u AS (SELECT w, p, j, array_to_string(list_concat(w[1:j], w[j + 2:]), ' ') AS x FROM v),
f AS (SELECT w, p, CAST(-1 AS BIGINT) AS j, array_to_string(w, ' ') AS x FROM d WHERE len(w) >= 7),
n AS (SELECT u.w FROM u JOIN (SELECT x, j, min(p) AS q FROM u GROUP BY x, j) r ON u.x = r.x AND u.j = r.j WHERE r.q < u.p
      UNION SELECT u.w FROM u JOIN f ON u.x = f.x WHERE f.p < u.p
      UNION SELECT f.w FROM u JOIN f ON u.x = f.x WHERE u.p < f.p),
k AS (SELECT o.*, len(o.w) > 0 AND {'d': doc_id, 'i': i} > d.p AS exact,
             len(o.w) > 0 AND {'d': doc_id, 'i': i} = d.p AND n.w IS NOT NULL AS near
      FROM o LEFT JOIN d ON o.w = d.w LEFT JOIN n ON o.w = n.w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS exact_dropped, count(*) FILTER (near) AS near_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(exact, false) AND NOT coalesce(near, false)), '') AS text
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""
