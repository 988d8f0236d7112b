"""Written intermediate tables in the folder that all executors share, and their removal."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
#: Shuffle files of a finished query go at its end, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_tables: dict[str, str] = {}  # by path: the catalog's names of bucketed tables
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


class _Open(threading.local):
    """The open scopes of a thread, innermost last."""

    def __init__(self):
        self.scopes: list[list[str]] = []


_open = _Open()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-corvane-")
        sc.setCheckpointDir(configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    if _open.scopes:
        _open.scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``narrow``: a small table of a few numbers per row. What makes it runs at full width; its rows are
    then dealt to an eighth of the shuffle partitions (8 at least), as so many files of a few rows
    cost more than they save.

    Cuts the lineage durably: a lost executor costs a re-read, never a recomputation of
    everything before it, and values that depend on the run (row ids) stay fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(min(n, max(8, n // 8)))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dealt(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like :func:`written`, in as many buckets by ``keys`` as there are shuffle partitions.

    The rows are shuffled once, here; later joins and groupings on all the keys leave them where they are.
    """
    spark = df.sparkSession
    path, table, n = new_path(spark, name), f"corvane_{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    _paths[out], _tables[path] = path, table
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table through the file system that holds it."""
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Hands tables out of a scope, see :func:`workspace`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` (a written table) outlives the scope, and then belongs to the one around it."""
        self.kept.add(_paths[df])
        return df

    def release(self) -> list[str]:
        """Paths of the tables that are left in the scope so far; they are now the caller's to remove."""
        left, _open.scopes[-1][:] = list(_open.scopes[-1]), []
        return left


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """Tables written inside are deleted at the end, but for those kept: an operator leaves only what its result reads."""
    held = Workspace(spark)
    _open.scopes.append([])
    try:
        yield held
    finally:
        for path in _open.scopes.pop():
            if path not in held.kept:
                remove(spark, path)
            elif _open.scopes:
                _open.scopes[-1].append(path)


def few(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``df`` (a written table) with a broadcast hint only if a count of its rows stays within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
