"""Session helpers: the shared folder, lineage cuts by written tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_scope = threading.local()


def use_checkpoint_dir(spark: SparkSession, path: str) -> None:
    """Name the shared folder where the cluster names none."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        spark.conf.set("spark.checkpoint.dir", path)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset (tests, local mode)
    a temporary folder is made and set for the rest of the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed like the tables of ``cut``."""
    path = f"{shared_dir(spark)}/spanforge/{uuid.uuid4().hex}-{name}"
    (getattr(_scope, "tables", None) or [_written])[-1].append((spark, path))
    return path


def cut(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later stages neither
    recompute it nor depend on an executor that may be lost. Removed at the end of the ``freed``
    block it is written in, or when the driver exits."""
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended first
            continue


@contextmanager
def freed() -> Iterator[None]:
    """Tables that ``cut`` writes in this thread within the block are deleted at its end; for
    work whose result has been collected or saved by then."""
    _scope.tables = [*(getattr(_scope, "tables", None) or []), []]
    try:
        yield
    finally:
        _delete(_scope.tables.pop())


@atexit.register
def _clean() -> None:
    _delete(_written)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Path, size and time of change of each file of a table; equal as long as it is unchanged."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def tasks_for(df: DataFrame, partition_bytes: int = 16 << 20) -> int:
    """Tasks for work that is heavy for its input: one for each ``partition_bytes`` of the files
    that ``df`` is read from, at least spark.sql.shuffle.partitions. Named explicitly, since
    adaptive execution would join small partitions by their bytes and never cuts large ones."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in leaves if x.nodeName().startswith("LogicalRelation"))  # of other leaves it is unknown
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // partition_bytes), 1 << 17))


def still_there(df: DataFrame) -> bool:
    """Whether the files that a written table is read from are still there; the shared folder may
    have been emptied meanwhile."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return False
    return True


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``limit``; otherwise
    unchanged, so that the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def join_totals(rows: DataFrame, totals: DataFrame, key: str, count: str, limit: int = 200_000) -> DataFrame:
    """``rows`` with the row of ``totals`` that has their ``key``; ``totals`` has one row a key and in
    ``count`` how many rows have it. Keys of more than ``limit`` rows, of which there are at
    most rows / limit, are broadcast, so their rows stay where they lie; the others are joined
    by a shuffle, in which no key is large."""
    heavy = totals.where(F.col(count) > limit)
    if heavy.isEmpty():
        return rows.join(totals, key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(light.join(totals.where(F.col(count) <= limit), key))


class Pointer:
    """Names the version in force under ``root``. Each switch is a new file ``CURRENT-<n>``, moved
    into place whole; the highest number counts, so there is no moment without a version."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._fs = self._hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path("CURRENT-*")) or []
        return sorted(int(n) for f in found if (n := f.getPath().getName().partition("-")[2]).isdigit())

    def read(self) -> str | None:
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self._fs.open(self._path(f"CURRENT-{numbers[-1]}"))
        try:
            return self._io.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def write(self, version: str) -> None:
        numbers = self._numbers()
        new, final = self._path(f"_pointer-{version}"), self._path(f"CURRENT-{numbers[-1] + 1 if numbers else 1}")
        out = self._fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            raise RuntimeError(f"another run published under {self.root} meanwhile")
        for n in numbers[:-1]:  # the one before stays for readers that have just listed it
            self._fs.delete(self._path(f"CURRENT-{n}"), False)
