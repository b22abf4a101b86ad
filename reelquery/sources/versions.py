"""Tables published in versions: a reader sees one version whole, whatever writers do meanwhile.

A table is a folder. ``data/part=<name>`` holds what one write brought, ``state/<name>`` a row for each item (``key``) with the
part that holds it, and ``versions/<number>`` names the state of that version. Parts and states are written
first; a version comes to be by one atomic step, the creation of its file, and what no version names is never
read. Writers that lose the race for a number start again from the winner's state, so no item is lost.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquery.staging import hinted

BROADCAST_ITEMS = 1_000_000


class Published:
    """``path`` must be in a store that refuses to rename to a taken name (HDFS and the like do; a local folder is
    served by hard links). Plain object stores don't, and are refused unless the session's file system says otherwise."""

    def __init__(self, spark: SparkSession, path: str, key: str = "media_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getScheme() in ("s3", "s3a", "s3n", "gs", "wasb", "wasbs"):
            raise ValueError(f"{self._fs.getScheme()} doesn't refuse to rename to a taken name, so versions can't be committed there")

    def versions(self) -> list[int]:
        """The numbers of the versions, ascending."""
        if not self._fs.exists(self._at("versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._at("versions")) if s.getPath().getName().isdigit())

    def _state(self, version: int) -> str:
        stream = self._fs.open(self._at(f"versions/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["state"]
        finally:
            stream.close()

    def items(self, version: int | None = None) -> DataFrame:
        """key, part, n (rows): where each item of a version is; of the last version by default."""
        known = self.versions()
        if version is None and not known or version is not None and version not in known:
            raise LookupError(f"{self.path} has no version{'' if version is None else f' {version}'}")
        return self.spark.read.parquet(f"{self.path}/state/{self._state(known[-1] if version is None else version)}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the last by default."""
        items = self.items(version)
        parts = [r["part"] for r in items.select("part").distinct().collect()]  # one for each write
        if not parts:
            raise LookupError(f"version {version} of {self.path} holds no items")
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/part={p}" for p in sorted(parts)))
        here = items.select(F.col(self.key).alias("_key"), F.col("part").alias("_part"))
        return rows.join(hinted(here, BROADCAST_ITEMS), F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left_semi").drop("part")

    def publish(self, rows: DataFrame) -> int:
        """A new version in which the items of ``rows`` are as given and all others as they were; its number."""
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/part={part}")
        written = self.spark.read.parquet(f"{self.path}/data/part={part}")
        return self._commit(written.groupBy(self.key).agg(F.lit(part).alias("part"), F.count("*").alias("n")))

    def remove(self, items: DataFrame) -> int:
        """A new version without some items (``key``)."""
        return self._commit(items.select(self.key, F.lit(None).cast("string").alias("part"), F.lit(0).cast("long").alias("n")).distinct())

    def _commit(self, changed: DataFrame) -> int:
        changed = changed.alias("c")
        while True:
            known = self.versions()
            number, state = (known[-1] + 1 if known else 1), uuid.uuid4().hex
            now = changed.select("c.*")
            if known:
                same = F.col(f"o.{self.key}").eqNullSafe(F.col(f"c.{self.key}"))
                now = now.unionByName(self.items(known[-1]).alias("o").join(changed, same, "left_anti"))
            now.filter("part IS NOT NULL").write.parquet(f"{self.path}/state/{state}")
            if self._claimed(f"versions/{number:012d}", json.dumps({"state": state, "before": known[-1] if known else None})):
                return number

    def _claimed(self, name: str, text: str) -> bool:
        """Makes a file with this text, whole and only if there is none of its name."""
        temp = f"versions/.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(temp), False)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":
                folder = urlparse(self.path).path
                os.link(f"{folder}/{temp}", f"{folder}/{name}")
                return True
            return not self._fs.exists(self._at(name)) and self._fs.rename(self._at(temp), self._at(name))
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._at(temp), False)

    def retire(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions, and the parts and states that these don't name. Only for times
        without writers: a part that is being written isn't named yet; readers of older versions fail."""
        known = self.versions()
        last = known[-keep:]
        states = {self._state(v) for v in last}
        parts = {r["part"] for v in last for r in self.items(v).select("part").distinct().collect()}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"versions/{v:012d}"), False)
        for folder, named in (("state", states), ("data", {f"part={p}" for p in parts})):
            for s in self._fs.listStatus(self._at(folder)) if self._fs.exists(self._at(folder)) else []:
                if s.getPath().getName() not in named:
                    self._fs.delete(s.getPath(), True)
