"""Versioned index tables: each version in its own folder, a pointer file naming the one in
force. Readers keep the version they opened; a failed write leaves the pointer as it was."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.index import LexicalIndex
from spanforge.runtime import Pointer


@dataclass
class IndexStore:
    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.pointer = Pointer(self.spark, self.root)

    def version(self) -> str | None:
        return self.pointer.read()

    def write(self, tables: dict[str, DataFrame], partitions: int | None = None) -> str:
        """Publish tables as a new version. Postings are laid out by ranges of term and chunk, so
        a search touches only the row groups of its terms, and a term that very many chunks have
        is spread over several tasks and files."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            if name == "postings":
                order = ("term", "chunk_id")
                df = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
            df.write.parquet(f"{self.root}/v={version}/{name}")
        self.pointer.write(version)
        return version

    def write_index(self, index: LexicalIndex, **more: DataFrame) -> str:
        return self.write({t: getattr(index, t) for t in LexicalIndex.TABLES} | more)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.version()
        if version is None:
            raise FileNotFoundError(f"no index at {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={version}/{name}")

    def has(self, name: str) -> bool:
        version = self.version()
        return version is not None and self.pointer.exists(f"v={version}/{name}")

    def index(self, version: str | None = None) -> LexicalIndex:
        return LexicalIndex(**{t: self.table(t, version) for t in LexicalIndex.TABLES})

    def registry(self) -> DataFrame:
        from spanforge import schemas

        if not self.has("registry"):
            return self.spark.createDataFrame([], schemas.REGISTRY)
        return self.table("registry").select("file_path", "mtime", "hash", F.col("chunks").cast("int").alias("chunks"))
