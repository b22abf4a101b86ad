"""Queries of text: normalisation, similarities, credit scores, subtitles; and of ids, times and catalogue work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reelquery.functions import formats as fm, text as tx
from reelquery.operators import metrics, scoring, subtitles as sub, temporal
from reelquery.operators.scoring import KEY
from reelquery.plans.base import ENTRIES_SQL, FRAMES_SQL, QUERY, d, entries, frames, hits, six, table
from reelquery.sources import frames as src, subtitles as subtitles_src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Each function of text in SQL, on the column x.


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


LOWER = squeeze("regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")
UPPER = squeeze("regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9À-ÖØ-Ý\\s]', ' ', 'g')")
MARKUP = squeeze("regexp_replace(" + squeeze("regexp_replace(upper(coalesce({x}, '')), '<[^>]+>', ' ', 'g')") + ", '[^A-Z0-9À-ÿ''\\- ]+', ' ', 'g')")
OCR = squeeze("regexp_replace(replace(coalesce({x}, ''), chr(10), ' '), '[^A-Za-z0-9 .,''!?():;\\-]', ' ', 'g')")
SUBTITLE = squeeze("regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\\{{[^}}]+\\}}', '', 'g')")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _each(name: str, source: str, key: str, column: str, spark_function, sql: str) -> None:
    """Registers a query that applies a function to a whole text column; the upper case of the German sharp s
    differs between engines and is put out of the way on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, spark_function(F.replace(F.col(column), F.lit("ß"), F.lit("s"))).alias("out"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {sql.format(x=f'''replace({column}, 'ß', 's')''')} AS out FROM {source}"


_each("normalize_lower", "documents", "doc_id", "text", tx.normalize_lower, LOWER)
_each("normalize_upper", "documents", "doc_id", "text", tx.normalize_upper, UPPER)
_each("normalize_markup", "pages", "page_id", "html", tx.normalize_markup, MARKUP)
_each("ocr_clean", "documents", "doc_id", "text", tx.ocr_clean, OCR)
_each("subtitle_clean", "pages", "page_id", "html", tx.subtitle_clean, SUBTITLE)
_each("drop_short_tokens", "documents", "doc_id", "text", lambda x: tx.drop_short_tokens(tx.normalize_upper(x)), f"array_to_string(list_filter(string_split({UPPER}, ' '), lambda t: length(t) >= 2), ' ')")
_each("safe_id", "pages", "page_id", "url", fm.safe_id, "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')")


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}'))) AS tokens FROM documents")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(tx.token_set("text")).alias("tokens"))


NEXT_SQL = "pr AS (SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the one after it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tb"))
    return c.withColumnRenamed("text", "ta").join(after, ["conv_id", "turn"])


@query(f"""WITH {NEXT_SQL}, t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(ta, '')), '[a-z0-9]{{2,}}')) AS a, list_distinct(regexp_extract_all(lower(coalesce(tb, '')), '[a-z0-9]{{2,}}')) AS b FROM pr)
  SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN {d(0)} ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS jaccard FROM t""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next(spark, sf_dir).select("conv_id", "turn", F.round(tx.jaccard(tx.token_set("ta"), tx.token_set("tb")), 6).alias("jaccard"))


def _similar(a: str, b: str) -> str:
    """Token and bigram similarity of two normalised texts in SQL."""
    w = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
    g = lambda x: f"list_distinct(list_transform(range(1, len({w(x)})), lambda i: {w(x)}[i] || ' ' || {w(x)}[i + 1]))"
    j = lambda p, q: f"(CASE WHEN len({p}) = 0 OR len({q}) = 0 THEN {d(0)} ELSE len(list_intersect({p}, {q})) / CAST(len(list_distinct(list_concat({p}, {q}))) AS DOUBLE) END)"
    one = lambda x: f"list_distinct({w(x)})"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN {d(0)} WHEN {a} = {b} THEN {d(1)} ELSE {d(0.7)} * {j(one(a), one(b))} + {d(0.3)} * {j(g(a), g(b))} END"


@query(f"WITH {NEXT_SQL}, n AS (SELECT conv_id, turn, {LOWER.format(x='ta')} AS a, {LOWER.format(x='tb')} AS b FROM pr) SELECT conv_id, turn, round({_similar('a', 'b')}, 6) AS similarity FROM n")
def token_bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.with_features(_next(spark, sf_dir), a=tx.normalize_lower("ta"), b=tx.normalize_lower("tb"))
    return tx.with_similarity(rows, "a", "b", "similarity").select("conv_id", "turn", six("similarity"))


@query()
def hybrid_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _next(spark, sf_dir).select("conv_id", "turn", tx.normalize_lower("ta").alias("a"), tx.normalize_lower("tb").alias("b"))
    return rows.select("conv_id", "turn", F.round(tx.hybrid_similarity("a", "b"), 6).alias("similarity"))


def credits(x: str) -> str:
    return " + ".join(f"CAST(contains({x}, '{k}') AS INTEGER)" for k in tx.CREDIT_WORDS)


#: Titles of pages and documents hold few credit words, so some are put in by the row's number, on both sides.
CREDIT_TEXT_SQL = "SELECT doc_id, " + UPPER.format(x="replace(text, 'ß', 's')") + " || CASE doc_id % 5 WHEN 0 THEN ' MAIN CAST' WHEN 1 THEN ' WRITTEN BY DIRECTOR' WHEN 2 THEN ' MUSIC' WHEN 3 THEN ' VISUAL EFFECTS AND VOICES OF PRODUCTION' ELSE '' END AS x FROM documents"


def credit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 5 == 0, " MAIN CAST").when(F.col("doc_id") % 5 == 1, " WRITTEN BY DIRECTOR").when(F.col("doc_id") % 5 == 2, " MUSIC").when(F.col("doc_id") % 5 == 3, " VISUAL EFFECTS AND VOICES OF PRODUCTION").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(tx.normalize_upper(F.replace(F.col("text"), F.lit("ß"), F.lit("s"))), more).alias("x"))


def _credit(name: str, spark_function, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: credit_text(spark, sf_dir).select("doc_id", F.round(spark_function("x"), 6).alias("score"))
    ORACLE_SQL[name] = f"WITH c AS ({CREDIT_TEXT_SQL}), h AS (SELECT doc_id, x, {credits('x')} AS h, {credits('x')} + {' + '.join(f'''CAST(contains(x, '{k}') AS INTEGER)''' for k in tx.MORE_CREDIT_WORDS)} AS h27 FROM c) SELECT doc_id, round({sql}, 6) AS score FROM h"


CREDIT_A_SQL = f"{d(0.7)} * least(h / {d(3)}, {d(1)}) + CASE WHEN len(list_filter(string_split(x, ' '), lambda t: length(t) >= 4)) >= 10 THEN {d(0.3)} ELSE {d(0)} END"
_credit("credit_score_a", tx.credit_score_words, CREDIT_A_SQL)
_credit("credit_score_b", tx.credit_score_steps, f"CASE WHEN h27 = 0 THEN {d(0)} ELSE least({d(1)}, {d(0.3)} + {d(0.7)} * least(h27 / {d(3)}, {d(1)})) END")
_credit("credit_score_c", tx.credit_score_thirds, f"least({d(1)}, h / {d(3)})")
_credit("credit_score_d", tx.credit_score_tenths, f"least({d(1)}, {d(0.1)} * h)")


@query(f"WITH c AS ({CREDIT_TEXT_SQL}) SELECT doc_id, ({credits('x')}) > 0 AS credit FROM c")
def keyword_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit_text(spark, sf_dir).select("doc_id", tx.has_keyword("x").alias("credit"))


WINDOW_SQL = ENTRIES_SQL + """,
wt AS (SELECT p.media_id, p.entry_no, string_agg(q.text, ' ' ORDER BY q.s, q.entry_no, q.text) AS text FROM en p JOIN en q ON q.media_id = p.media_id AND q.e >= p.s - 6 AND q.s <= p.s + 6 GROUP BY p.media_id, p.entry_no)"""


@query(f"WITH {WINDOW_SQL} SELECT media_id, entry_no, text FROM wt")
def subtitle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = entries(spark, sf_dir)
    points = en.select("media_id", F.col("entry_no").alias("point"), F.col("start").alias("t"))
    return temporal.window_text(points, en, 6.0, ["media_id", "point"], longest=3.0).withColumnRenamed("point", "entry_no")


#: Every entry of every hundredth conversation is a query; its number follows the conversation's.
LINES_SQL = ENTRIES_SQL + f""",
nm AS (SELECT media_id, entry_no, s, e, text, {LOWER.format(x='text')} AS n FROM en),
qs AS (SELECT media_id * 1000 + entry_no AS query_id, media_id AS qm, min(s) AS qt, min(n) AS qn FROM nm WHERE media_id % 100 = 0 AND length(n) >= 8 GROUP BY media_id, entry_no),
ls AS (SELECT q.query_id, q.qn, m.media_id, m.entry_no, m.s, {_similar('q.qn', 'm.n')} AS sim FROM qs q CROSS JOIN nm m),
bl AS (SELECT query_id, any_value(qn) AS qn, media_id, arg_max(sim, (sim, -s, -entry_no)) AS line_score, arg_max(s, (sim, -s, -entry_no)) AS s0 FROM ls GROUP BY query_id, media_id),
bs AS (SELECT query_id, qn, media_id, line_score, CASE WHEN line_score > 0 THEN s0 END AS line_start FROM bl)"""


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and entries."""
    en = entries(spark, sf_dir).withColumn("norm", tx.normalize_lower("text"))
    asked = en.filter((F.col("media_id") % QUERY == 0) & (F.length("norm") >= 8)).groupBy("media_id", (F.col("media_id") * 1000 + F.col("entry_no")).alias("query_id")).agg(F.min("norm").alias("norm"), F.min("start").alias("start"))
    return asked, en


@query(f"WITH {LINES_SQL} SELECT query_id, media_id, round(line_score, 6) AS line_score, line_start FROM bs")
def subtitle_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.best_lines(*_lines(spark, sf_dir)).select("query_id", "media_id", six("line_score"), "line_start")


@query(f"""WITH {LINES_SQL.replace('CROSS JOIN nm m', 'JOIN nm m ON NOT (m.media_id = q.qm AND abs(m.s - q.qt) <= 15)')}, r AS (SELECT query_id, media_id, line_score FROM bs) SELECT query_id, media_id, round(line_score, 6) AS line_score FROM r""")
def subtitle_best_line_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without entries of the query's own item within fifteen seconds of it."""
    return sub.best_lines(*_lines(spark, sf_dir), apart=15.0).select("query_id", "media_id", six("line_score"))


LINE_WINDOW_SQL = LINES_SQL + f""",
lw AS (SELECT b.query_id, b.media_id, any_value(b.qn) AS qn, {LOWER.format(x="string_agg(m.text, ' ' ORDER BY m.s, m.entry_no, m.text)")} AS w FROM bs b JOIN en m ON m.media_id = b.media_id AND m.e >= b.line_start - 15 AND m.s <= b.line_start + 15 GROUP BY b.query_id, b.media_id),
lr AS (SELECT b.query_id, b.media_id, {d(0.4)} * line_score + {d(0.6)} * CASE WHEN line_start IS NULL THEN {d(0)} ELSE {_similar('l.qn', 'l.w')} END AS score FROM bs b LEFT JOIN lw l ON b.query_id = l.query_id AND b.media_id = l.media_id)"""


def _line_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and entries with the text around each."""
    asked, en = _lines(spark, sf_dir)
    points = en.select("media_id", F.round("start", 3).alias("t")).distinct()
    texts = temporal.window_text(points, en, 15.0, ["media_id", "t"], longest=3.0).select(F.col("media_id").alias("_m"), F.col("t").alias("_t"), tx.normalize_lower("text").alias("around"))
    return asked, en.join(texts, (F.col("media_id") == F.col("_m")) & (F.round("start", 3) == F.col("_t")), "left").drop("_m", "_t")


@query(f"WITH {LINE_WINDOW_SQL} SELECT query_id, media_id, round(score, 6) AS score FROM lr")
def line_window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.line_window_scores(*_line_windows(spark, sf_dir)).select("query_id", "media_id", six("score"))


@query(f"WITH {LINE_WINDOW_SQL}, p AS (SELECT query_id, media_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, media_id) AS r FROM lr), t AS (SELECT query_id, min(r) FILTER (media_id = query_id // 1000) AS tr FROM p GROUP BY query_id) SELECT count(*) AS queries, round(avg(CASE WHEN tr <= 1 THEN {d(1)} ELSE {d(0)} END), 6) AS top1, round(avg(CASE WHEN tr <= 3 THEN {d(1)} ELSE {d(0)} END), 6) AS top3, round(avg(CASE WHEN tr <= 5 THEN {d(1)} ELSE {d(0)} END), 6) AS top5, round(avg(coalesce({d(1)} / tr, 0)), 6) AS mrr FROM t")
def subtitle_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = sub.line_window_ranks(*_line_windows(spark, sf_dir), F.floor(F.col("query_id") / 1000))
    return metrics.accuracy(ranks).select("queries", *(six(c) for c in ("top1", "top3", "top5", "mrr")))


#: Candidates of a query frame meet the conversation of their number as their subtitles.
EVIDENCE_SQL = FRAMES_SQL.replace("qu AS", "qu0 AS") + """,
qu AS (SELECT * FROM fr WHERE vec_id % 100 = 0),
si AS (SELECT q.vec_id AS query_id, f.* EXCLUDE (v), list_dot_product(q.v, f.v) AS sim FROM qu q JOIN fr f ON q.vec_id <> f.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM si),
hi AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, vec_id) AS r FROM rk WHERE rank <= 50)""" + f""",
cv AS (SELECT conv_id, {MARKUP.format(x="replace(string_agg(text, ' ' ORDER BY turn, text), 'ß', 's')")} AS n FROM conversations GROUP BY conv_id),
ev AS (SELECT h.query_id, h.media_id, h.season, h.episode, h.vec_id, coalesce({_similar('a.n', 'b.n')}, 0) AS sim FROM hi h LEFT JOIN cv a ON a.conv_id = h.query_id LEFT JOIN cv b ON b.conv_id = h.vec_id),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, season, episode ORDER BY sim DESC, vec_id) AS r FROM ev),
se AS (SELECT query_id, media_id, season, episode, {d(0.6)} * max(sim) + {d(0.25)} * avg(sim) FILTER (r <= 3) + {d(0.15)} * least({d(1)}, count(*) FILTER (sim >= {d(0.3)}) / {d(3)}) AS score FROM er GROUP BY query_id, media_id, season, episode),
vi AS (SELECT query_id, media_id, season, episode, {d(0.6)} * max(sim) + {d(0.25)} * avg(sim) FILTER (r <= 3) + {d(0.15)} * avg(sim) FILTER (r <= 5) AS visual FROM hi GROUP BY query_id, media_id, season, episode),
vs AS (SELECT v.*, s.score AS subtitle, a.n AS query_text, CASE WHEN a.n <> '' THEN {d(0.8)} * visual + {d(0.2)} * coalesce(s.score, 0) ELSE visual END AS fused
       FROM vi v LEFT JOIN se s ON v.query_id = s.query_id AND v.media_id = s.media_id AND v.season IS NOT DISTINCT FROM s.season AND v.episode IS NOT DISTINCT FROM s.episode LEFT JOIN cv a ON a.conv_id = v.query_id)"""


def _spoken(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """conv_id, n: the normalised text of each conversation that ``asked`` (conv_id) names."""
    c = table(spark, sf_dir, "conversations").join(asked, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias("t"))
    return c.select("conv_id", tx.normalize_markup(F.replace(F.col("t"), F.lit("ß"), F.lit("s"))).alias("n"))


def _evidence(spark: SparkSession, sf_dir: str, hybrid: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hits, and the same with the similarity of spoken texts as sim."""
    h = hits(frames(spark, sf_dir))
    n = _spoken(spark, sf_dir, h.select(F.explode(F.array("query_id", "vec_id")).alias("conv_id")).distinct())
    if not hybrid:  # sets are made once a text
        n = tx.with_features(n, f=F.col("n")).select("conv_id", F.col("f").alias("n"))
    rows = h.drop("sim").join(n.select(F.col("conv_id").alias("query_id"), F.col("n").alias("_a")), "query_id", "left").join(n.select(F.col("conv_id").alias("vec_id"), F.col("n").alias("_b")), "vec_id", "left")
    if not hybrid:
        return h, tx.with_similarity(rows, "_a", "_b", "sim").drop("_a", "_b")
    return h, rows.withColumn("sim", F.coalesce(tx.hybrid_similarity("_a", "_b"), F.lit(0.0))).drop("_a", "_b")


@query(f"WITH {EVIDENCE_SQL} SELECT query_id, media_id, season, episode, round(score, 6) AS score FROM se")
def subtitle_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.evidence_scores(_evidence(spark, sf_dir)[1]).select(*KEY, six("score"))


@query()
def subtitle_evidence_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.evidence_scores(_evidence(spark, sf_dir, hybrid=True)[1]).select(*KEY, six("score"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, rows = _evidence(spark, sf_dir)
    said = sub.evidence_scores(rows).withColumnRenamed("score", "subtitle")
    seen = scoring.image_scores(h)
    on = F.expr("v.query_id = s.query_id AND v.media_id <=> s.media_id AND v.season <=> s.season AND v.episode <=> s.episode")
    both = seen.alias("v").join(said.alias("s"), on, "left").select(*(f"v.{c}" for c in KEY), F.col("v.score").alias("visual"), "s.subtitle")
    n = _spoken(spark, sf_dir, h.select(F.col("query_id").alias("conv_id")).distinct()).select(F.col("conv_id").alias("query_id"), F.col("n").alias("query_text"))
    both = both.join(n, "query_id", "left").withColumn("has_text", F.coalesce(F.col("query_text"), F.lit("")) != "")
    return both.withColumn("fused", sub.fused_with_visual(both))


@query(f"WITH {EVIDENCE_SQL} SELECT query_id, media_id, season, episode, round(fused, 6) AS fused FROM vs")
def visual_subtitle_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select(*KEY, six("fused"))


@query(f"""WITH {EVIDENCE_SQL}, x AS (SELECT * REPLACE (CASE WHEN query_id % 200 = 0 THEN 'MAIN CAST' ELSE query_text END AS query_text, CASE WHEN query_id % 400 = 0 AND media_id = 'media_05' THEN {d(0.95)} ELSE subtitle END AS subtitle) FROM vs),
  c AS (SELECT *, ({credits("upper(coalesce(query_text, ''))")}) > 0 AS credit, coalesce(subtitle, 0) AS st FROM x),
  f AS (SELECT *, CASE WHEN NOT credit THEN fused WHEN st >= {d(0.9)} THEN {d(0.1)} * visual + {d(0.9)} * st ELSE {d(0.7)} * visual + {d(0.3)} * st END AS final, max(CAST(st >= {d(0.9)} AS INTEGER)) OVER (PARTITION BY query_id) AS strong FROM c)
  SELECT query_id, media_id, season, episode, credit, round(final, 6) AS final, round(CASE WHEN credit AND strong = 0 THEN visual ELSE final END, 6) AS sort_key FROM f""")
def credit_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fused(spark, sf_dir).withColumn("query_text", F.when(F.col("query_id") % 200 == 0, "MAIN CAST").otherwise(F.col("query_text")))
    rows = rows.withColumn("subtitle", F.when((F.col("query_id") % 400 == 0) & (F.col("media_id") == "media_05"), 0.95).otherwise(F.col("subtitle")))
    return sub.credit_override(rows).select(*KEY, "credit", six("final"), six("sort_key"))


@query("SELECT CAST(conv_id AS VARCHAR) AS media_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS entry_no, CAST(turn * 4 AS DOUBLE) AS start, CAST(turn * 4 + 3 AS DOUBLE) AS \"end\", text FROM conversations")
def nested_subtitle_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as subtitle indexes of three forms, a JSON text each, read back as entries by item."""
    c = table(spark, sf_dir, "conversations")
    t = F.to_json(F.array(F.struct((F.col("turn") * 4).alias("start"), (F.col("turn") * 4 + 3).alias("end_seconds"), F.col("text").alias("content"))))
    own = F.format_string('"%d"', "conv_id")
    flat, deep = F.concat(F.lit("{"), own, F.lit(": "), t, F.lit("}")), F.concat(F.lit("{"), own, F.lit(': {"items": [], "data": {"part": {"lines": '), t, F.lit("}}}}"))
    listed = F.concat(F.lit('[{"id": '), own, F.lit(', "x": {"y": '), t, F.lit("}}]"))
    return subtitles_src.subtitle_index(c.select(F.when(F.col("turn") % 3 == 0, flat).when(F.col("turn") % 3 == 1, deep).otherwise(listed).alias("text")))


@query(f"WITH {FRAMES_SQL} SELECT vec_id, media_id, format('{{:06d}}', frame_no) AS frame_id, CAST(2 * (frame_no - 1) AS INTEGER) AS timestamp_seconds FROM fr")
def frame_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = frames(spark, sf_dir).select("vec_id", "media_id", F.format_string("%012d", "vec_id").alias("image_path"))
    return temporal.frame_times(spark, fr).select("vec_id", "media_id", F.format_string("%06d", "frame_no").alias("frame_id"), F.col("timestamp_seconds").cast("int").alias("timestamp_seconds"))


@query("WITH n AS (SELECT event_id, 'Show.S' || (event_id % 30) || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END || 'e' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || '.mkv' AS x FROM events) SELECT event_id, TRY_CAST(nullif(regexp_extract(x, '[Ss](\\d{1,2})\\s*[Ee](\\d{1,2})', 1), '') AS INTEGER) AS season, TRY_CAST(nullif(regexp_extract(x, '[Ss](\\d{1,2})\\s*[Ee](\\d{1,2})', 2), '') AS INTEGER) AS episode, TRY_CAST(nullif(regexp_extract(lower(x), 's(\\d{2})e(\\d{2})', 1), '') AS INTEGER) AS strict_season FROM n")
def episode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.concat(F.lit("Show.S"), (e % 30).cast("string"), F.when(e % 3 == 0, " ").otherwise(""), F.lit("e"), F.lpad((e % 100).cast("string"), 2, "0"), F.lit(".mkv"))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("x"))
    season, episode = fm.episode_numbers("x")
    return rows.select("event_id", season.alias("season"), episode.alias("episode"), fm.episode_numbers_strict("x")[0].alias("strict_season"))


#: An event's time of day in microseconds.
DAY_SQL = "epoch_us(ts) % 86400000000"


def _time_of_day() -> Column:
    """By its fields, which don't hang on the session's time zone."""
    clock = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    return clock * 1_000_000 + F.date_format("ts", "SSSSSS").cast("long")


@query(f"SELECT event_id, {DAY_SQL} // 1000 / {d(1000)} AS seconds FROM events")
def srt_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(_time_of_day() / 1000)
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return table(spark, sf_dir, "events").select("event_id", fm.srt_seconds(text).alias("seconds"))


CLOCK = "lpad(CAST(t // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0')"


@query(f"WITH v AS (SELECT event_id, {DAY_SQL} // 250000 // 4 AS t, {DAY_SQL} // 250000 % 4 * 25 AS h FROM events) SELECT event_id, {CLOCK} AS plain, {CLOCK} || '.' || lpad(CAST(h * 10 AS VARCHAR), 3, '0') AS millis, {CLOCK} || '.' || lpad(CAST(h AS VARCHAR), 2, '0') AS hundredths FROM v")
def format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day, to a quarter of a second."""
    t = F.floor(_time_of_day() / 250_000) / 4.0
    return table(spark, sf_dir, "events").select("event_id", fm.clock(t).alias("plain"), fm.clock_millis(t).alias("millis"), fm.clock_hundredths(t).alias("hundredths"))


@query(f"SELECT event_id, CASE WHEN value - floor(value) >= {d(0.9)} THEN 'Very High' WHEN value - floor(value) >= {d(0.8)} THEN 'High' WHEN value - floor(value) >= {d(0.7)} THEN 'Moderate' ELSE 'Low' END AS band, CASE WHEN event_id % 4 = 0 THEN coalesce(event_type, 'none') ELSE coalesce(event_type, 'none') || ' S' || lpad(CAST(event_id % 9 AS VARCHAR), 2, '0') || ' E' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') END AS label FROM events")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    season = F.when(e % 4 != 0, e % 9)
    return table(spark, sf_dir, "events").select("event_id", fm.confidence(F.col("value") - F.floor("value")).alias("band"), fm.display_name("event_type", season, e % 24, F.lit("none")).alias("label"))


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN {d(0)} WHEN 1 THEN {d(0)} ELSE (event_id % 97) / CAST(event_id % 5 AS DOUBLE) END AS fps, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), {d(-1)}) AS number FROM events")
def rational_and_safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rate = F.when(e % 5 == 1, "?").otherwise(F.concat((e % 97).cast("string"), F.lit("/"), (e % 5).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", fm.rational(rate).alias("fps"), fm.safe_number(F.when(e % 3 == 0, "x").otherwise(e.cast("string")), -1.0).alias("number"))


@query(f"SELECT event_id, list_transform(range(0, 5), lambda i: round(greatest(least(abs(CAST(value AS DOUBLE)), {d(3)}) - {d(0.05)}, {d(0)}) * i / 4, 6)) AS times FROM events")
def clip_sampling_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stand for the lengths of clips."""
    times = temporal.clip_times(F.abs(F.col("value").cast("double")), 5)
    return table(spark, sf_dir, "events").select("event_id", F.transform(times, lambda t: F.round(t, 6)).alias("times"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT 'document' AS kind, doc_id AS id, lang AS season FROM documents UNION ALL SELECT 'page', page_id, NULL FROM pages UNION ALL SELECT 'item', item_id, NULL FROM benchmark ORDER BY kind, coalesce(season, ''), id")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string").alias("season")
    a = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("season"))
    b = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), none)
    c = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), none)
    return a.unionByName(b).unionByName(c).orderBy("kind", F.coalesce("season", F.lit("")), "id")


@query(f"""WITH {FRAMES_SQL}, m AS (SELECT 'media_' || lpad(CAST(i AS VARCHAR), 2, '0') AS media_id FROM range(0, 12) t(i)), f AS (SELECT media_id, count(*) AS frames FROM fr GROUP BY media_id),
  v AS (SELECT media_id, count(*) AS vectors, count(*) FILTER (len(v) <> 64 OR abs(sqrt(list_dot_product(v, v)) - 1) > {d(0.001)}) AS odd FROM fr WHERE NOT (media_id = 'media_04' AND frame_no = 1) GROUP BY media_id)
  SELECT m.media_id, coalesce(frames, 0) AS frames, coalesce(vectors, 0) AS vectors, coalesce(odd, 0) AS odd_vectors, CASE WHEN coalesce(frames, 0) = 0 THEN 'no frames' WHEN coalesce(vectors, 0) = 0 THEN 'no vectors' WHEN frames <> vectors THEN 'counts differ' WHEN odd > 0 THEN 'odd vectors' END AS problem
  FROM m LEFT JOIN f USING (media_id) LEFT JOIN v USING (media_id)""")
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items have no frames, and one lacks a vector."""
    fr = frames(spark, sf_dir)
    media = spark.range(12).select(F.concat(F.lit("media_"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("media_id"))
    return src.audit(media, fr, fr.filter("NOT (media_id = 'media_04' AND frame_no = 1)"), 64)


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, count(*) FILTER (n_chars >= 2000) AS long FROM documents GROUP BY source, lang")
def counts_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") >= 2000).alias("long"))
