"""Changes between a registered snapshot and the files now there, and the update of an index
by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.index import LexicalIndex, build_index, chunk_corpus, term_counts
from spanforge.operators.merkle import narrowed, normal_hash, saved_tree


@dataclass
class Changes:
    added: DataFrame
    modified: DataFrame
    deleted: DataFrame
    touched: DataFrame  # new mtime, same content


def scan_changes(files: DataFrame, registry: DataFrame) -> Changes:
    """Compare ``files`` (file_path, mtime, hash) with ``registry`` (the same and chunks).

    Added: not registered. Deleted: registered, not there. Modified: mtime and content hash
    differ; hashes compare as hexadecimal digits, and a null or empty one is never equal. Null
    paths are dropped; both sides have one row a path.
    """
    files = files.where("file_path is not null")
    saved = registry.where("file_path is not null").select("file_path", F.col("mtime").alias("_mtime"), normal_hash("hash").alias("_hash"))
    both = files.join(saved, "file_path").where(~F.col("mtime").eqNullSafe(F.col("_mtime")))
    same = F.coalesce(normal_hash("hash") == F.col("_hash"), F.lit(False))
    return Changes(
        added=files.join(saved, "file_path", "left_anti"),
        modified=both.where(~same).drop("_mtime", "_hash"),
        deleted=saved.join(files, "file_path", "left_anti").select("file_path"),
        touched=both.where(same).drop("_mtime", "_hash"),
    )


def _stamped(rows: DataFrame) -> DataFrame:
    """With ``stamp``, what of a file decides whether it is looked at: its mtime and content.
    Null where the content is unknown."""
    return rows.where("file_path is not null").withColumn("stamp", F.concat(F.coalesce(F.col("mtime").cast("string"), F.lit("")), F.lit(":"), normal_hash("hash")))


def registry_tree(registry: DataFrame) -> DataFrame:
    """The Merkle tree of a registry, saved with it."""
    return saved_tree(_stamped(registry), "file_path", "stamp")


def scan_changes_below(files: DataFrame, registry: DataFrame, tree: DataFrame) -> Changes:
    """scan_changes, looking only at key ranges whose digests differ from the registry's saved
    ``tree``: files with equal mtime and content are in no change. An empty tree says nothing."""
    if tree.isEmpty():
        return scan_changes(files, registry)
    old, new = narrowed(_stamped(registry), _stamped(files), "file_path", "stamp", old_tree=tree)
    return scan_changes(new.drop("stamp"), old.drop("stamp"))


def change_counts(changes: Changes) -> DataFrame:
    """change, files: how many files were added, modified and deleted."""
    parts = [df.select(F.lit(name).alias("change")) for name, df in (("added", changes.added), ("modified", changes.modified), ("deleted", changes.deleted))]
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("change").agg(F.count("*").alias("files"))
    names = changes.added.sparkSession.createDataFrame([("added",), ("modified",), ("deleted",)], "change string")
    return names.join(seen, "change", "left").select("change", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


def next_registry(files: DataFrame, registry: DataFrame, chunks: DataFrame, changes: Changes) -> DataFrame:
    """The registry after an update: changed files with their new hash and number of chunks,
    touched ones with their new mtime, deleted ones gone."""
    redone = changes.added.select("file_path").unionByName(changes.modified.select("file_path"))
    counts = chunks.groupBy("file_path").agg(F.count("*").cast("int").alias("_n"))
    fresh = files.join(redone, "file_path", "left_semi").join(counts, "file_path", "left").select("file_path", "mtime", "hash", F.coalesce("_n", F.lit(0)).alias("chunks"))
    kept = registry.join(redone.unionByName(changes.deleted.select("file_path")), "file_path", "left_anti").join(
        changes.touched.select("file_path", F.col("mtime").alias("_m")), "file_path", "left"
    )
    return kept.select("file_path", F.coalesce("_m", "mtime").alias("mtime"), "hash", "chunks").unionByName(fresh)


def update_index(files: DataFrame, registry: DataFrame, chunks: DataFrame, counts: DataFrame, max_chunk: int = 2000, changes: Changes | None = None) -> tuple[LexicalIndex, DataFrame, DataFrame]:
    """Index, term counts and registry after an update.

    ``files`` has file_path, text, mtime, hash; ``chunks`` and ``counts`` are those of the
    index before. Only added and modified files are chunked and tokenised; the counts of all
    others are taken over, and only the statistics over the whole corpus are computed anew.
    """
    changes = changes or scan_changes(files, registry)
    redone = changes.added.select("file_path").unionByName(changes.modified.select("file_path"))
    gone = redone.unionByName(changes.deleted.select("file_path")).distinct()
    new = chunk_corpus(files.join(redone, "file_path", "left_semi").withColumn("doc_id", F.xxhash64("file_path")), max_chunk)
    stay = chunks.join(gone, "file_path", "left_anti").select("chunk_id", "file_path", "first", "last")
    all_counts = counts.join(stay.select("chunk_id"), "chunk_id", "left_semi").unionByName(term_counts(new))
    all_chunks = stay.unionByName(new.select("chunk_id", "file_path", "first", "last"))
    return build_index(all_chunks, all_counts), all_counts, next_registry(files, registry, all_chunks, changes)
