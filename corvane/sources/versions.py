"""Tables whose configurations are replaced one by one: an upsert that is stored, whole or not at all.

Every managed configuration (a model, a mode, an input) is a folder of Parquet files. A version is one small
file that lists the configurations in order of their first appearance, and their folders. An upsert writes
new folders only, then moves the next version's list into place under a name that nobody has: readers see
the old version or the new one, a crash between leaves the old one, and of two writers of the same version
one fails. Configurations that the new rows do not have are not rewritten.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer stored this version first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, managed: list[str]):
        self.spark, self.path, self.managed = spark, path.rstrip("/"), managed
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._store = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The latest version; 0 if there is none."""
        if not self._store.exists(self._file(self.path)):
            return 0
        names = (s.getPath().getName() for s in self._store.listStatus(self._file(self.path)))
        return max((int(m[1]) for m in (re.fullmatch(r"version-(\d+)\.json", n) for n in names) if m), default=0)

    def listed(self, version: int | None = None) -> list[dict]:
        """The configurations of a version in order: ``{"key": [...], "folder": ...}``."""
        version = self.number() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/version-{version}.json", wholetext=True).first()[0]
        return json.loads(text)["configurations"]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with ``ordinal``: the place of their configuration by first appearance."""
        listed = self.listed(version)
        if not listed:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{c['folder']}" for c in listed))
        places = self.spark.createDataFrame([(c["folder"], k) for k, c in enumerate(listed)], "_folder string, ordinal int")
        rows = rows.withColumn("_folder", F.concat(F.lit("_write="), F.col("_write"), F.lit("/_config="), F.col("_config").cast("string")))
        return rows.join(F.broadcast(places), "_folder").drop("_folder", "_write", "_config")  # a row for each configuration

    def upsert(self, new: DataFrame) -> int:
        """Replaces the configurations that ``new`` has and keeps all others; gives the new version's number."""
        version, before = self.number(), self.listed()
        write = f"_write=w{uuid.uuid4().hex}"
        keys = [tuple(r) for r in new.select(*self.managed).distinct().orderBy(*self.managed).collect()]  # configurations, of which there are few
        numbers = self.spark.createDataFrame([(*k, n) for n, k in enumerate(keys)], new.select(*self.managed).schema.add("_config", "integer"))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in self.managed]
        rows = new.alias("n").join(F.broadcast(numbers.alias("k")), same).select("n.*", "k._config")
        rows.write.partitionBy("_config").parquet(f"{self.path}/data/{write}")
        key = lambda c: json.dumps(c, default=str)
        fresh = {key(list(k)): {"key": list(k), "folder": f"{write}/_config={n}"} for n, k in enumerate(keys)}
        listed = [c for c in before if key(c["key"]) not in fresh] + list(fresh.values())
        self._list(version + 1, listed)
        return version + 1

    def _list(self, version: int, listed: list[dict]) -> None:
        draft = self._file(f"{self.path}/_draft-{uuid.uuid4().hex}.json")
        out = self._store.create(draft)
        try:
            out.write(bytearray(json.dumps({"configurations": listed}, default=str).encode()))
        finally:
            out.close()
        target = self._file(f"{self.path}/version-{version}.json")
        if self._store.exists(target) or not self._store.rename(draft, target):
            self._store.delete(draft, False)
            raise Conflict(f"version {version} is there already")

    def forget(self, keep: int = 1) -> None:
        """Deletes all but the last ``keep`` versions, and the folders that none of these lists."""
        last = self.number()
        kept = {c["folder"] for v in range(max(1, last - keep + 1), last + 1) for c in self.listed(v)}
        for v in range(1, last - keep + 1):
            self._store.delete(self._file(f"{self.path}/version-{v}.json"), False)
        for write in self._store.listStatus(self._file(f"{self.path}/data")):
            for folder in self._store.listStatus(write.getPath()):
                name = f"{write.getPath().getName()}/{folder.getPath().getName()}"
                if "/_config=" in name and name not in kept:
                    self._store.delete(folder.getPath(), True)
