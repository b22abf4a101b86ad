"""From documents to packed training windows, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

All stages read whole texts, of any length, take null texts as empty and an empty table for an empty result; columns beside
those of documents, whatever they are called, pass with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquery.llm import classifier, linededup, mixing, packing, simhash
from reelquery.llm.common import field, staged, table, unsealed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are. Null sources and languages are sites of their own; repeated rows
    stay or go together."""
    return classifier.kept(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those of which only blank lines are left go, if they
    lost any. n_chars follows the text."""
    words = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    untouched = F.col("n_exact") + F.col("n_near") == 0
    left = linededup.marked(docs).filter(untouched | words)
    return unsealed(left, docs.columns, text=F.col("text"), n_chars=F.when(untouched, field("n_chars")).otherwise(F.length("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: alike in fingerprints, or in 0.8 of their five-word shingles. Of a group the
    one of least doc_id stays, null ids last, ties by a hash of the text; of repeated rows one stays. Empty texts are a group."""
    return simhash.representatives(docs, similar=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Those without words are never taken; a null source is one of its own; rows equal in
    id and text are taken alike."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows. An empty text is its end alone; repeated rows are packed each, null ids stay null."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: The tokenizer of the last stage can't be stated in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
