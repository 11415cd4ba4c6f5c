"""Append-only ingestion of documents as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.operators.index import term_counts


def windowed_counts(documents: DataFrame, time: str = "ingested_at", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Documents and characters per source and time window of a stream; rows that arrive later
    than ``delay`` behind the watermark are dropped, as the stream's contract says."""
    return (
        documents.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), "source")
        .agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", "documents", "chars")
    )


def stream_postings(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the term counts of new chunks (chunk_id, file_path, text) to a Parquet table, one
    folder a batch. A repeated batch after a failure overwrites its own folder, so each chunk
    is counted once."""

    def write(batch: DataFrame, number: int) -> None:
        term_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
