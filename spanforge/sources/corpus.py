"""Reading a directory of source files as a table."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanforge.runtime import cut

SUFFIXES = (".py", ".md", ".txt")  # CMakeLists.txt ends in .txt
SCHEMA = "file_path string, text string, mtime double, hash string"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the corpus source needs a path")
        self.root = options["path"]
        self.size = max(1, int(options.get("partitionBytes", 32 << 20)))
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))

    def partitions(self) -> list[InputPartition]:
        """Files of the wanted suffixes in the order of their paths, in runs of about
        ``partitionBytes``. All names count, those with a leading _ or . too."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        found = sorted(
            os.path.join(at, name) for at, _, names in os.walk(self.root) for name in names if os.path.splitext(name)[1] in self.suffixes
        )
        runs, size = [[]], 0
        for path in filter(os.path.isfile, found):
            n = os.path.getsize(path)
            if runs[-1] and size + n > self.size:
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [_Files(r) for r in runs]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(partition.paths), 256):
            yield _batch([_read(p) for p in partition.paths[i : i + 256]])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["file_path", "text", "mtime", "hash"])


def _read(path: str) -> tuple[str, str, float, str]:
    """A file's text as UTF-8, bad bytes replaced and newlines normalised, and its digest."""
    with open(path, "rb") as f:
        raw = f.read()
    text = raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    return path, text, os.path.getmtime(path), hashlib.sha256(raw).hexdigest()


class CorpusSource(DataSource):
    """``spark.read.format("corpus").load(dir)``: file_path, text, mtime, hash of each file."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _CorpusReader(self.options)


def _frontier(root: str, enough: int) -> tuple[list[str], list[str]]:
    """Directories and files below ``root``, breadth first, until there are ``enough``
    directories to be walked by tasks."""
    todo, files = [root], []
    while todo and len(todo) < enough:
        below: list[str] = []
        for at in todo:
            for entry in os.scandir(at):
                (below if entry.is_dir(follow_symlinks=False) else files).append(entry.path)
        todo = below
    return todo, files


def list_corpus(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, walkers: int = 256) -> DataFrame:
    """file_path, size of each file of the wanted suffixes. The driver looks at the upper levels
    only; the directories below are walked by tasks, so listing is spread like reading. All
    executors must see ``path``."""
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    folders, files = _frontier(path, walkers)
    rows = spark.createDataFrame([(x, True) for x in folders] + [(x, False) for x in files], "file_path string, folder boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, folder in zip(b.column("file_path").to_pylist(), b.column("folder").to_pylist()):
                found = [os.path.join(d, n) for d, _, names in os.walk(at) for n in names] if folder else [at]
                found = [f for f in found if os.path.splitext(f)[1] in suffixes and os.path.isfile(f)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(map(os.path.getsize, found), pa.int64())], ["file_path", "size"])

    spread = rows.repartition(max(1, min(walkers, len(folders) + len(files) // 1000)))
    return spread.mapInArrow(run, "file_path string, size long")


def read_corpus(spark: SparkSession, path: str, partition_bytes: int = 32 << 20, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """file_path, text, mtime, hash of each file: listed by tasks, then dealt by a hash of the
    path to tasks of about ``partition_bytes`` of files."""
    listed = cut(list_corpus(spark, path, suffixes), "file-list")
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("file_path").to_pylist()
            for i in range(0, len(paths), 256):
                yield _batch([_read(p) for p in paths[i : i + 256]])

    return listed.repartition(max(1, -(-total // partition_bytes)), "file_path").mapInArrow(run, SCHEMA)
