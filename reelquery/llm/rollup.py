"""Token counts as rollups that signed changes maintain.

A batch of changes holds signed rows: an insert counts +1, a delete -1, a revised count is the old row with
-1 and the new one with +1. Totals are additive, so a batch is summed by source, language and tokenizer
version and its sums are stored; the totals are the sums of all committed batches.

A batch is committed by creating one file that bears its name, after its sums are stored. Of several writers
one creates it, whatever their order and number; the others' sums are never read, and neither are
those of a failed attempt. ``compact`` folds the commits so far into one: its file bears the number of the
fold, so of two folds at a time one wins, and names the commits that it replaces. Their files are then deleted, so that a
listing has the batches since the last fold and that fold; names of batches folded earlier stand in a table beside it.
A batch whose name a fold knows never counts again, even if a late writer creates its file anew.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import hinted, shared_dir, staged, table

KEYS = ("source", "lang", "tokenizer_version")
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "wasb", "wasbs")
#: Tokenizer versions of the query: all documents first, then those not in English anew.
FIRST, SECOND = "byte_bpe_50k", "byte_bpe_multi_50k"


class Commits:
    """Files in a folder that all writers see; each is created once and never changed. The store must refuse to rename to a
    taken name, as HDFS does; a local folder is served by hard links. Object stores don't, and are an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(self.conf)
        if self.fs.getScheme() in OBJECT_STORES:
            raise ValueError(f"{self.fs.getScheme()} doesn't refuse to rename to a taken name, so batches can't be committed there")
        self.fs.mkdirs(self.at)

    def _child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def __contains__(self, name: str) -> bool:
        return self.fs.exists(self._child(name))

    def create(self, name: str, content: dict) -> bool:
        """Creates the file with its whole content; False if it is there already. The content is written under
        another name first, which is then moved: moving there fails if the name is taken."""
        attempt, target = self._child(f"_{uuid.uuid4().hex}"), self._child(name)
        out = self.fs.create(attempt, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.fs.getScheme() == "file":  # where a move would overwrite; a link doesn't
            try:
                os.link(attempt.toUri().getPath(), target.toUri().getPath())
                made = True
            except FileExistsError:
                made = False
            self.fs.delete(attempt, False)
            return made
        made = self.fs.rename(attempt, target)
        if not made:
            self.fs.delete(attempt, False)
        return made

    def all(self) -> dict[str, dict]:
        """Name -> content of each file: of the batches since the last fold whose files were deleted, and of that fold."""
        while True:
            found = {}
            for status in self.fs.listStatus(self.at):
                name = status.getPath().getName()
                if name.startswith(("_", ".")):
                    continue
                try:
                    stream = self.fs.open(status.getPath())
                except Py4JJavaError:
                    if self.fs.exists(status.getPath()):
                        raise
                    break  # folded meanwhile: the fold is listed now
                try:
                    found[name] = json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
                finally:
                    stream.close()
            else:
                return found

    def delete(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete(self._child(name), False)


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.commits = Commits(spark, f"{path}/commits")

    @staticmethod
    def _name(batch: str) -> str:
        return f"batch-{hashlib.sha256(batch.encode()).hexdigest()}"

    @staticmethod
    def _last(found: dict[str, dict]) -> str | None:
        return max((name for name in found if name.startswith("fold-")), default=None)

    def _known(self, found: dict[str, dict], names: list[str]) -> set[str]:
        """Those of ``names`` that the last fold or an earlier one replaced."""
        last = self._last(found)
        if last is None or not names:
            return set()
        content = found[last]
        known = {name for c in found.values() for name in c["folds"]} & set(names)
        if content.get("known"):
            rows = self.spark.read.schema("name string").parquet(f"{self.path}/known/{content['known']}")
            known |= {r["name"] for r in rows.filter(F.col("name").isin(names)).distinct().collect()}
        return known

    def _live(self, found: dict[str, dict]) -> dict[str, str]:
        """Name of each commit that counts -> where its sums are."""
        folded = self._known(found, list(found))
        return {name: content["at"] for name, content in found.items() if name not in folded}

    def _put(self, name: str, sums: DataFrame, folds: list[str], batch: str = "", known: str = "") -> bool:
        at = f"{name}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/sums/{at}")
        return self.commits.create(name, {"batch": batch, "at": at, "folds": folds, "known": known})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies ``changes`` (source, lang, tokenizer_version, n_tokens, sign) once; False if the batch was
        there, or if another writer was faster. Null counts are 0, rows with a null sign are ignored,
        null keys are groups of their own, repeated rows count each, other columns are ignored. An empty batch is committed
        like others and changes no total."""
        name = self._name(batch)
        if name in self.commits or name in self._known(self.commits.all(), [name]):
            return False
        sign = F.col("sign").cast("long")
        sums = changes.filter("sign IS NOT NULL").groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens"), F.lit(0))).alias("n_tokens"))
        return self._put(name, sums, [], batch)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups that no document is left in are left out."""
        sums = self._summed(self._live(self.commits.all()))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def _summed(self, live: dict[str, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*(f"{self.path}/sums/{at}" for at in live.values()))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> bool:
        """Folds the commits that count into one and deletes their files; their names stay known. False if there is nothing
        to fold or another fold was faster. Batches that are committed meanwhile go on to count by themselves."""
        found = self.commits.all()
        live, last = self._live(found), self._last(found)
        if len(live) < 2:
            return False
        known = ""
        if last is not None:  # what the last fold replaced and knew
            known = uuid.uuid4().hex
            names = self.spark.createDataFrame([(n,) for n in found[last]["folds"]], "name string")
            if found[last].get("known"):
                names = names.union(self.spark.read.schema("name string").parquet(f"{self.path}/known/{found[last]['known']}"))
            names.filter("name LIKE 'batch-%'").distinct().sortWithinPartitions("name").write.parquet(f"{self.path}/known/{known}")
        number = 1 + (int(last.removeprefix("fold-")) if last else 0)
        made = self._put(f"fold-{number:09d}", self._summed(live), sorted(live), known=known)
        if made:
            self.commits.delete(list(found))
        return made

    def vacuum(self) -> None:
        """Deletes sums and names that no commit file refers to, those of folded batches and failed attempts. For times
        without writers, and without readers of totals from before the last fold."""
        found = self.commits.all()
        used = {c["at"] for c in found.values()} | {c.get("known") for c in found.values()}
        fs, child = self.commits.fs, self.spark._jvm.org.apache.hadoop.fs.Path
        for folder in ("sums", "known"):
            at = child(f"{self.path}/{folder}")
            for status in fs.listStatus(at) if fs.exists(at) else []:
                if status.getPath().getName() not in used:
                    fs.delete(status.getPath(), True)


@functools.cache
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokens(text: str | None, known) -> int:
    """Number of tokens of a whole text."""
    return len(known.encode_ordinary(text)) if text else 0


def counted(docs: DataFrame, name: str, *keep: str, where: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens, by the public vocabulary ``name``, of each row (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        known = encoding(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
        for batch in batches:
            n = np.array([tokens(x.as_py(), known) for x in batch.column("text")], "i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n)], [*keep, "n_tokens"])

    rows = docs.filter(where) if where else docs
    return rows.select(*keep, "text").mapInArrow(run, rows.select(*keep).schema.add("n_tokens", "long"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: every document is inserted under the first tokenizer version; toxic
    documents by their labels are deleted; the rest that isn't English is revised to the second version.
    The first batch is sent twice and counts once."""
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, f"{shared_dir(spark)}/reelquery/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}")
    other = "lang IS NULL OR lang <> 'en'"
    first = staged(counted(docs, FIRST, "doc_id", "source", "lang"), "tokens-first").withColumn("tokenizer_version", F.lit(FIRST))
    second = counted(docs, SECOND, "doc_id", "source", "lang", where=other).withColumn("tokenizer_version", F.lit(SECOND))
    toxic = staged(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct(), "tokens-toxic")
    toxic = hinted(toxic, 500_000)
    plus = first.withColumn("sign", F.lit(1))
    rollup.commit("insert", plus)
    rollup.commit("delete", first.join(toxic, "doc_id", "left_semi").withColumn("sign", F.lit(-1)))
    old = first.filter(other).withColumn("sign", F.lit(-1))
    rollup.commit("revise", old.unionByName(second.withColumn("sign", F.lit(1))).join(toxic, "doc_id", "left_anti"))
    rollup.commit("insert", plus)
    return rollup.totals()
