"""Incremental processing by comparing Merkle trees over key-range hashes.

Keys are placed on a ring by a 64-bit hash and the ring is cut into ``fanout ** depth`` equal
ranges, the leaves; the depth follows from the number of rows. A leaf's digest combines the
digests of its rows independent of their order; an inner node's digest combines those of its
children. Two states are compared from the root down: only ranges whose digests differ are
opened, and rows are compared in changed leaves only. Output and tree are published together
under one version, so a failed run leaves the last version in force and the next run finds
the same changes again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.runtime import Pointer, cut

FANOUT = 16
DEPTH = 3
MOST_DEPTH = 5  # 1,048,576 leaves: the proven bound of what is broadcast or compared in one task
LEAF_ROWS = 256  # rows a leaf is meant to hold


def depth_for(rows: int, fanout: int = FANOUT) -> int:
    """Least depth with at most LEAF_ROWS rows a leaf, within MOST_DEPTH."""
    return next((d for d in range(1, MOST_DEPTH) if fanout**d * LEAF_ROWS >= rows), MOST_DEPTH)


def normal_hash(c: Column | str) -> Column:
    """Hexadecimal digest in lower case without outer blanks; null where it is null or empty."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lower(F.trim(c))
    return F.when(out != "", out)


def leaf_of(key: Column, fanout: int = FANOUT, depth: int = DEPTH) -> Column:
    """Number of the key range, 0 <= leaf < fanout ** depth."""
    return F.pmod(F.xxhash64(key), F.lit(fanout**depth)).cast("int")


def leaf_digests(rows: DataFrame, key: str, digest: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Leaf, digest, rows of each key range that holds a row.

    The digest is the XOR and the wrapped sum of the row hashes, so partial results of any
    partitions combine map-side and a hot range never gathers its rows in one task.
    """
    h = F.xxhash64(F.col(key), F.coalesce(F.col(digest), F.lit("\0")))
    return (
        rows.select(leaf_of(F.col(key), fanout, depth).alias("leaf"), h.alias("h"))
        .groupBy("leaf")
        .agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
        .select("leaf", F.xxhash64("x", F.col("s").cast("string"), "n").alias("digest"), "n")
    )


_MIX = np.uint64(0x9E3779B97F4A7C15)


def levels(digests: np.ndarray, fanout: int, depth: int) -> list[np.ndarray]:
    """Digests of all nodes, the root's level first; a leaf without rows has digest 0."""
    out = [digests]
    place = np.arange(1, fanout + 1, dtype=np.uint64) * _MIX
    with np.errstate(over="ignore"):
        for _ in range(depth):
            x = (out[-1].reshape(-1, fanout) ^ place) * _MIX
            x ^= x >> np.uint64(31)
            out.append((x * _MIX).sum(axis=1, dtype=np.uint64))
    return out[::-1]


def descend(old: np.ndarray, new: np.ndarray, fanout: int, depth: int) -> np.ndarray:
    """Leaves whose digests differ: a node is looked at only if its parent differs."""
    at = np.zeros(1, int)
    for d, (a, b) in enumerate(zip(levels(old, fanout, depth), levels(new, fanout, depth))):
        at = at[a[at] != b[at]]
        if d < depth:
            at = (at[:, None] * fanout + np.arange(fanout)).ravel()
    return at


def changed_leaves(old: DataFrame, new: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Leaves whose digests differ, found from the root down. The two trees, of at most
    ``fanout ** depth`` leaves each, meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.zeros((2, fanout**depth), np.uint64)
        for b in batches:
            trees[b.column("side").to_numpy(), b.column("leaf").to_numpy()] = b.column("digest").to_numpy().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(descend(*trees, fanout, depth), pa.int32())], ["leaf"])

    side = lambda x, n: x.select("leaf", "digest", F.lit(n).alias("side"))
    return side(old, 0).unionByName(side(new, 1)).repartition(1).mapInArrow(run, "leaf int")


def _marked(rows: DataFrame, key: str, digest: str, mark: str) -> DataFrame:
    """A null digest differs between the two sides: what cannot be shown to be unchanged changed."""
    return rows.select(key, F.coalesce(F.col(digest), F.lit(mark)).alias(digest))


def saved_tree(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """leaf, digest, n, depth as they are published with a state for the next run."""
    depth = depth_for(rows.count())
    return leaf_digests(_marked(rows, key, digest, "\0old"), key, digest, depth=depth).withColumn("depth", F.lit(depth)).repartition(1)


def narrowed(old: DataFrame, new: DataFrame, key: str, digest: str, fanout: int = FANOUT, depth: int | None = None, old_tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both states that lie in changed leaves. ``old_tree``, a saved_tree of ``old``,
    saves hashing ``old`` anew and gives the depth."""
    if old_tree is not None:
        depth = old_tree.agg(F.max("depth")).head()[0]
    if depth is None:
        depth = depth_for(new.count(), fanout)
    if old_tree is None:
        old_tree = leaf_digests(_marked(old, key, digest, "\0old"), key, digest, fanout, depth)
    new_tree = leaf_digests(_marked(new, key, digest, "\0new"), key, digest, fanout, depth)
    leaves = F.broadcast(cut(changed_leaves(old_tree, new_tree, fanout, depth), "changed-leaves"))  # at most fanout ** depth numbers
    return tuple(x.join(leaves, leaf_of(F.col(key), fanout, depth) == leaves["leaf"], "left_semi") for x in (old, new))


def changed_rows(old: DataFrame, new: DataFrame, key: str, digest: str, fanout: int = FANOUT, depth: int | None = None, old_tree: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` that are added or changed against ``old``.

    ``old`` and ``new`` have at most one row a key. A null digest on either side never counts
    as equal: what cannot be shown to be unchanged is processed. Rows with a null key are
    dropped. Columns of ``old`` other than key and digest are ignored, so clashing names do
    no harm. ``old_tree``, the saved tree of ``old``, saves hashing it anew. Empty tables: with
    an empty ``old`` all rows come out, with an empty ``new`` none.
    """
    old = old.select(F.col(key), F.col(digest)).where(F.col(key).isNotNull())
    new = new.where(F.col(key).isNotNull())
    old, current = narrowed(old, new, key, digest, fanout, depth, old_tree)
    saved = old.select(F.col(key).alias("_saved_key"), F.col(digest).alias("_saved"))
    same = (current[key] == saved["_saved_key"]) & (current[digest] == saved["_saved"])
    return current.join(saved, same, "left_anti")


def latest_scans(scans: DataFrame) -> DataFrame:
    """The latest scan of each file by seen_at, then scan_id; one row a file."""
    cols = ["scan_id", "hash", "present"]
    last = F.max(F.struct(F.col("seen_at"), F.col("scan_id"), F.coalesce(F.col("present"), F.lit(False)).alias("present"), F.col("hash").alias("hash")))
    return (
        scans.where(F.col("file_path").isNotNull())
        .groupBy("file_path")
        .agg(last.alias("last"))
        .select("file_path", *[F.col(f"last.{c}").alias(c) for c in cols])
        .withColumn("hash", normal_hash("hash"))
    )


def last_processed(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """What the latest successful run (by its started_at) wrote for each file; one row a file."""
    good = (
        runs.where(F.lower(F.trim("status")) == "success")
        .groupBy("run_id")
        .agg(F.max("started_at").alias("_started"))
    )
    rows = registry.select("file_path", "hash", "run_id", "written_at").where(F.col("file_path").isNotNull())
    last = F.max(F.struct("_started", "run_id", "written_at", normal_hash("hash").alias("hash")))
    return rows.join(good, "run_id").groupBy("file_path").agg(last.alias("last")).select("file_path", F.col("last.hash").alias("hash"))


def pending_files(scans: DataFrame, registry: DataFrame, runs: DataFrame, fanout: int = FANOUT, depth: int | None = None) -> DataFrame:
    """file_path, scan_id of the present files added or changed since their last success."""
    new = cut(latest_scans(scans).where("present"), "scanned")
    old = cut(last_processed(registry, runs), "processed")
    return changed_rows(old, new, "file_path", "hash", fanout, depth).select("file_path", "scan_id")


@dataclass
class MerkleStore:
    """Versions of a published state: ``v=<id>/{output,state,tree}`` and a pointer, which is
    written last and in one step. A run that fails before that changes nothing."""

    spark: SparkSession
    root: str
    key: str = "file_path"
    digest: str = "hash"

    def __post_init__(self) -> None:
        self.pointer = Pointer(self.spark, self.root)

    def current(self) -> str | None:
        return self.pointer.read()

    def state(self, schema) -> DataFrame:
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/v={version}/state")

    def changes(self, new: DataFrame) -> DataFrame:
        """Rows of ``new`` to be processed. The saved tree of the last version is compared with
        that of ``new``, and saved rows of changed leaves only with theirs."""
        version = self.current()
        if version is None:
            return new.where(F.col(self.key).isNotNull())
        old = self.spark.read.parquet(f"{self.root}/v={version}/state")
        tree = self.spark.read.parquet(f"{self.root}/v={version}/tree")
        return changed_rows(old, new, self.key, self.digest, old_tree=tree)

    def publish(self, new: DataFrame, output: DataFrame) -> str:
        """Write output, state and tree of this run, then switch the pointer."""
        version = uuid.uuid4().hex
        at = f"{self.root}/v={version}"
        output.write.parquet(f"{at}/output")
        state = new.select(self.key, self.digest).where(F.col(self.key).isNotNull())
        state.write.parquet(f"{at}/state")
        saved_tree(self.spark.read.parquet(f"{at}/state"), self.key, self.digest).write.parquet(f"{at}/tree")
        self.pointer.write(version)
        return version
