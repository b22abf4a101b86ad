"""Subtitle evidence: best lines, windows of text, fusing with what is seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelquery import weights as W
from reelquery.functions.text import has_keyword, hashed_pairs, hashed_words, words
from reelquery.operators.blocks import against
from reelquery.operators.scoring import KEY, ranked, top_mean
from reelquery.staging import hinted, staged


def _hashed(texts: DataFrame, *keep: Column | str, names: tuple[str, str] = ("w", "b")) -> DataFrame:
    """``keep``, w and b: 64-bit hashes of the distinct words, and pairs of words, of each text (norm)."""
    each = texts.select(*keep, words(F.coalesce("norm", F.lit(""))).alias("_ws"))
    kept = [c for c in each.columns if c != "_ws"]
    return each.select(*kept, hashed_words("_ws").alias(names[0]), hashed_pairs("_ws").alias(names[1]))


def _line_search(apart: float | None, line: float | None, around: float | None, cells: int = 1 << 20):
    """Queries and batches of entries in order of item -> for each query and item its best entry. Terms that
    many of the queries have are multiplied as matrices of zeros and ones, the others are looked up one by one.
    It is sent to the workers whole, so that they needn't have this library."""

    def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype("i8")
        return column.flatten().to_numpy(zero_copy_only=False).astype("i8"), sizes

    class Terms:
        """The terms of the queries: which of them have each."""

        def __init__(self, column: pa.ChunkedArray):
            values, self.sizes = lists(column)
            q, n = np.repeat(np.arange(len(self.sizes)), self.sizes), len(self.sizes)
            self.names, at = np.unique(values, return_inverse=True)
            order = np.argsort(at, kind="stable")
            self.queries, self.degree = q[order], np.bincount(at, minlength=len(self.names))
            self.first = np.cumsum(self.degree) - self.degree
            self.often = np.cumsum(self.degree > n / 16) * (self.degree > n / 16) - 1  # -1: looked up
            self.matrix = np.zeros((int((self.degree > n / 16).sum()), n), "f4")
            hot = self.often[at] >= 0
            self.matrix[self.often[at[hot]], q[hot]] = 1

        def shared(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            """How many terms each entry shares with each query."""
            e, n = np.repeat(np.arange(len(sizes)), sizes), len(self.sizes)
            at = np.minimum(np.searchsorted(self.names, values), max(len(self.names) - 1, 0))
            met = self.names[at] == values if len(self.names) else np.zeros(len(values), bool)
            e, at = e[met], at[met]
            rare = self.often[at] < 0
            count = self.degree[at[rare]]
            q = self.queries[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[at[rare]], count)]
            found = np.bincount(np.repeat(e[rare], count) * n + q, minlength=len(sizes) * n).reshape(len(sizes), n).astype("f8")
            e, column = e[~rare], self.often[at[~rare]]
            for lo in range(0, len(self.matrix), 2048):
                here = (column >= lo) & (column < lo + 2048)
                own = np.zeros((len(sizes), min(2048, len(self.matrix) - lo)), "f4")
                own[e[here], column[here] - lo] = 1
                found += own @ self.matrix[lo : lo + 2048]
            return found

    def alike(asked: Terms, pairs: Terms, words_of: pa.Array, pairs_of: pa.Array) -> np.ndarray:
        """The similarity of each entry and each query."""
        (wv, wn), (bv, bn) = lists(words_of), lists(pairs_of)
        both_w, both_b = asked.shared(wv, wn), pairs.shared(bv, bn)
        share = lambda both, a, b: np.divide(both, a[:, None] + b[None] - both, out=np.zeros_like(both), where=both > 0)
        score = 0.70 * share(both_w, wn, asked.sizes) + 0.30 * share(both_b, bn, pairs.sizes)
        # texts of one word are equal if they share it; longer equal texts share all words and pairs
        score[(both_w > 0) & (bn == 0)[:, None] & (pairs.sizes == 0)[None]] = 1.0
        return score

    def ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = batch["media_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start, number = (batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("start", "entry_no"))
        order = np.lexsort((number, start, code))
        return batch if (np.diff(order) == 1).all() else batch.take(pa.array(order))

    def search(asked: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, ids = Terms(asked["w"]), Terms(asked["b"]), asked["query_id"].combine_chunks()
        least = asked["least"].to_numpy() if "least" in asked.column_names else np.zeros(len(ids))
        if apart is not None:
            items = asked["_qm"].combine_chunks().unique()
            mine = pc.index_in(asked["_qm"].combine_chunks(), items).to_numpy(zero_copy_only=False)
        step = max(1, cells // len(ids))

        def rows(part: pa.RecordBatch, media: pa.Array, best: np.ndarray, start: np.ndarray, number: np.ndarray, near: np.ndarray | None) -> pa.RecordBatch:
            item, query = np.nonzero((best >= 0) & ((best if near is None else line * best + around * near) >= least[None]))
            typed = lambda x, c: pa.array(x[item, query], from_pandas=True).cast(part.schema.field(c).type)
            columns = {"query_id": ids.take(pa.array(query)), "media_id": media.take(pa.array(item)), "line_score": pa.array(best[item, query]), "line_start": typed(start, "start"), "line_no": typed(number, "entry_no")}
            return pa.RecordBatch.from_pydict(columns | ({} if near is None else {"window_score": pa.array(near[item, query])}))

        held = part = None  # the item that the last slice ended in, which may go on in the next
        for part in (x.slice(at, step) for x in map(ordered, batches) for at in range(0, x.num_rows, step)):
            code = part["media_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            start, number = (part[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("start", "entry_no"))
            score = alike(w, b, part["w"], part["b"])
            near = alike(w, b, part["ww"], part["wb"]) if line is not None else None
            if apart is not None:
                same = pc.index_in(part["media_id"], items).fill_null(-1).to_numpy(zero_copy_only=False)
                score[(same[:, None] == mine[None]) & (np.abs(start[:, None] - asked["_qs"].to_numpy()[None]) <= apart)] = -1.0
            first = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            best = np.maximum.reduceat(score, first)
            at = np.where(score == np.repeat(best, np.diff(first, append=len(code)), 0), np.arange(len(code))[:, None], len(code))
            at = np.minimum.reduceat(at, first)
            found = [best, start[at], number[at]]
            if near is not None:  # no text is around a line that isn't alike
                found.append(np.where(best > 0, np.take_along_axis(near, at, 0), 0.0))
            media = part["media_id"].take(pa.array(first))
            if held and held[0][0].as_py() == media[0].as_py():
                earlier = held[1][0] >= found[0][:1]
                for mine_, x in zip(held[1], found, strict=True):
                    x[0] = np.where(earlier, mine_, x[:1])[0]
            elif held:
                yield rows(part, held[0], *held[1], *[None][: 4 - len(found)])
            yield rows(part, media[:-1], *(x[:-1] for x in found), *[None][: 4 - len(found)])
            held = media[-1:], [x[-1:].copy() for x in found]
        if held:
            yield rows(part, held[0], *held[1], *[None][: 4 - len(held[1])])

    return search


#: Entries of an item that one task looks through.
LARGE = 20_000
#: Queries of lines up to so many go to every task: they are narrow, and each further block of them deals all entries again.
MOST_LINES = 32_768


def best_lines(queries: DataFrame, entries: DataFrame, apart: float | None = None, w: W.Subtitle | None = None, large: int = LARGE) -> DataFrame:
    """query_id, media_id, line_score, line_start, line_no: each media item's entry that is most like the query's
    text, the earliest among equals; no time where nothing is alike. ``queries``: query_id, norm and, for
    ``apart``, media_id and start: entries of the same item at most that many seconds away are left out
    before the maximum is taken. ``entries``: media_id, entry_no, start, norm. With ``w``, entries have around, the text around
    each, and window_score is the query's similarity with the text around the best line; queries that have ``least``
    then needn't list items whose ``w.line * line_score + w.around * window_score`` doesn't reach it.

    Similarity is that of tokens and bigrams. The result has a row for each query and item. Entries are dealt by item and
    each task scores its entries against a block of queries, so a row is final where it is found and none is
    shuffled. Only an item of more than ``large`` entries is dealt over all tasks, and its rows of each are put
    together. No term, however common, is joined.
    """
    own = [F.col("media_id").alias("_qm"), F.col("start").alias("_qs")] if apart is not None else []
    least = [F.coalesce(F.col("least"), F.lit(float("inf"))).alias("least")] if "least" in queries.columns else []
    q = _hashed(queries, "query_id", *own, *least)
    kind = lambda c: entries.schema[c].dataType.simpleString()
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, media_id {kind('media_id')}, line_score double, line_start {kind('start')}, line_no {kind('entry_no')}" + (", window_score double" if w else "")
    search = _line_search(apart, w and w.line, w and w.around)
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(e: DataFrame, q: DataFrame, *by: str) -> DataFrame:
        e = e.repartition(parts, *by).sortWithinPartitions("media_id", F.asc_nulls_last("start"), F.asc_nulls_last("entry_no"))
        e = _hashed(e, "media_id", "entry_no", "start", *([F.col("around")] if w else []))
        if w:
            e = _hashed(e.withColumnRenamed("around", "norm"), "media_id", "entry_no", "start", "w", "b", names=("ww", "wb"))
        return against(e, q, search, schema, 8 * (F.size("w") + F.size("b")), (F.struct(*by), F.col("query_id")), MOST_LINES)

    long = staged(entries.groupBy("media_id").count().filter(F.col("count") > large).select(F.col("media_id").alias("_long")), "lines-long")
    twice = not q.groupBy("query_id").count().filter("count > 1").isEmpty()
    if twice or not long.isEmpty():
        of = F.col("media_id").eqNullSafe(F.col("_long"))
        long = hinted(long, 500_000)
        # a part of an item may have its score without its best line, so the least score is not asked of parts
        rest = found(entries.join(long, of, "left_anti"), q.drop("least") if twice else q, "media_id")
        split = found(entries.join(long, of, "left_semi"), q.drop("least"), "media_id", "start")
        order = F.struct("line_score", -F.col("line_start"), -F.col("line_no"))
        first = lambda df: df.groupBy("query_id", "media_id").agg(F.max_by(F.struct(*df.columns[2:]), order).alias("b")).select("query_id", "media_id", "b.*")
        best = first(rest.union(split)) if twice else rest.union(first(split))
    else:
        best = found(entries, q, "media_id")
    alike = F.col("line_score") > 0
    return best.withColumns({"line_start": F.when(alike, F.col("line_start")), "line_no": F.when(alike, F.col("line_no"))})


def line_window_scores(queries: DataFrame, entries: DataFrame, w: W.Subtitle = W.Subtitle(), large: int = LARGE) -> DataFrame:
    """``best_lines`` with window_score and score, the weighted sum of both: a media item's best line and the text around it.
    ``entries`` have around. If ``queries`` have ``least``, rows of less score may be left out."""
    found = best_lines(queries, entries, w=w, large=large)
    return found.withColumn("score", w.line * F.col("line_score") + w.around * F.col("window_score"))


def line_window_ranks(queries: DataFrame, entries: DataFrame, truth: Column, w: W.Subtitle = W.Subtitle()) -> DataFrame:
    """query_id, truth_rank: the place of the item ``truth`` (of query_id) among all items by score, ties to the smaller
    media_id; null if there is no such item. The truth's score is found first, so that tasks pass on only rows that reach it."""
    named = queries.select("query_id", truth.alias("_truth"))
    own = entries.join(named.select(F.col("_truth").alias("media_id")).distinct(), "media_id", "left_semi")
    mine = line_window_scores(queries, own, w).join(named.distinct(), "query_id").filter("media_id = _truth").select("query_id", "_truth", F.col("score").alias("least"))
    mine = staged(mine, "lines-truth")
    ahead = line_window_scores(queries.join(mine.drop("_truth"), "query_id"), entries, w).select("query_id", "media_id", "score").join(hinted(mine, 500_000), "query_id")
    ranks = ahead.filter((F.col("score") > F.col("least")) | ((F.col("score") == F.col("least")) & (F.col("media_id") <= F.col("_truth")))).groupBy("query_id").agg(F.count("*").alias("truth_rank"))
    return named.select("query_id").distinct().join(ranks, "query_id", "left")


def evidence_scores(rows: DataFrame, w: W.Subtitle = W.Subtitle()) -> DataFrame:
    """Episodes by their candidates' text similarity ``sim``: best, best three, and how many are strong."""
    parts = ranked(rows).groupBy(*KEY).agg(F.max("sim").alias("best"), top_mean(3).alias("top3"), F.count_if(F.col("sim") >= w.strong).alias("strong"), F.count("*").alias("evidence"))
    return parts.withColumn("score", w.best * F.col("best") + w.top3 * F.col("top3") + w.support * F.least(F.lit(1.0), F.col("strong") / w.support_full))


def fused_with_visual(rows: DataFrame, weight: float = 0.80) -> Column:
    """``weight`` of visual and the rest of subtitle if the query has subtitles, else visual alone."""
    mixed = F.lit(weight) * F.col("visual") + F.lit(round(1 - weight, 10)) * F.coalesce(F.col("subtitle"), F.lit(0.0))
    return F.when(F.col("has_text"), mixed).otherwise(F.col("visual"))


def credit_override(rows: DataFrame, strong: float = 0.90) -> DataFrame:
    """``rows`` (query_id, visual, subtitle, fused, query_text) with final and sort_key.

    If the query's text has a credit keyword, final weighs subtitles: nearly alone where they agree strongly.
    Such a query's episodes are ordered by final if any agrees strongly, otherwise by visual; other
    queries keep fused.
    """
    credit = has_keyword(F.upper(F.coalesce(F.col("query_text"), F.lit(""))))
    subtitle = F.coalesce(F.col("subtitle"), F.lit(0.0))
    is_strong = subtitle >= strong
    final = F.when(~credit, F.col("fused")).when(is_strong, F.lit(0.10) * F.col("visual") + F.lit(0.90) * subtitle).otherwise(F.lit(0.70) * F.col("visual") + F.lit(0.30) * subtitle)
    any_strong = F.max(is_strong).over(Window.partitionBy("query_id"))
    return rows.withColumns({"credit": credit, "final": final, "sort_key": F.when(credit & ~any_strong, F.col("visual")).otherwise(final)})
