"""Recall of ranked spans against the sources of answered questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.spans import iou

CUTS = (1, 3, 5, 10)
LEAST_IOU = 0.05


def truth(questions: DataFrame) -> DataFrame:
    """question_id, file_path, first, last for every source of every answered question that
    has one."""
    rows = questions.where(F.col("answer").isNotNull() & (F.size("sources") > 0))
    return rows.select("question_id", F.explode("sources").alias("s")).select(
        "question_id", F.col("s.file_path").alias("file_path"), F.col("s.first_character_index").alias("first"), F.col("s.last_character_index").alias("last")
    )


def hit_ranks(results: DataFrame, sources: DataFrame, max_length: int = 2000, least: float = LEAST_IOU) -> DataFrame:
    """question_id, hit_rank of every question with a source: the rank of its first result
    that overlaps a source of the same file by at least ``least``, null if none does. Results
    longer than ``max_length`` are taken out first and the others move up."""
    w = Window.partitionBy("question_id").orderBy("rank")
    valid = results.where(F.col("last") - F.col("first") <= max_length).withColumn("rank", F.row_number().over(w))
    s = sources.select("question_id", "file_path", F.col("first").alias("s0"), F.col("last").alias("s1"))
    near = valid.join(s, ["question_id", "file_path"]).where(iou(F.col("s0"), F.col("s1"), F.col("first"), F.col("last")) >= least)
    first = near.groupBy("question_id").agg(F.min("rank").alias("hit_rank"))
    return sources.select("question_id").distinct().join(first, "question_id", "left")


def recall(hits: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """cut, hits, total, recall (rounded to 4 places, exact halves to even) for each cut. With
    no questions there are no rows."""
    counts = [F.struct(F.lit(c).alias("cut"), F.sum((F.coalesce("hit_rank", F.lit(1 << 30)) <= c).cast("long")).alias("hits")) for c in cuts]
    rows = hits.agg(F.count("*").alias("total"), F.array(*counts).alias("_c")).where("total > 0").select("total", F.explode("_c").alias("c"))
    return rows.select(F.col("c.cut").alias("cut"), F.col("c.hits").alias("hits"), "total", F.bround(F.col("c.hits") / F.col("total"), 4).alias("recall"))
