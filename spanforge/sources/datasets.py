"""Question sets and results as JSON files: envelopes on disk, flat tables in Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge import schemas


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, sources, answer of a data set. Unanswered questions have null
    sources and answer; a missing question_id gets one made of the question's place and text."""
    rows = spark.read.schema(schemas.DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)
    flat = rows.select(F.posexplode("rag_questions").alias("_p", "q")).select("_p", "q.*")
    made = F.sha2(F.concat_ws(":", "_p", "question"), 256)
    return flat.withColumn("question_id", F.coalesce("question_id", made)).drop("_p")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, rank, file_path, first, last of a results file; of a repeated
    question_id the last entry counts."""
    rows = spark.read.schema(schemas.RESULTS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    flat = rows.select(F.posexplode("search_results").alias("_p", "r")).select("_p", "r.*")
    last = Window.partitionBy("question_id").orderBy(F.desc("_p"))
    flat = flat.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    out = flat.select("question_id", "question", F.posexplode("retrieved_sources").alias("_r", "s"))
    return out.select(
        "question_id", "question", (F.col("_r") + 1).alias("rank"), F.col("s.file_path").alias("file_path"),
        F.col("s.first_character_index").alias("first"), F.col("s.last_character_index").alias("last"),
    )


def _write_envelope(rows: DataFrame, path: str, name: str, more: str = "") -> None:
    """One JSON document {name: [row, ...], more} in the order of question_id. Such a file is one
    document by definition, so the driver writes it, row by row as partitions arrive, to any
    file system that Spark knows, under another name until it is whole. For large sets write
    the table itself as Parquet."""
    spark = rows.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    final, new = fs.Path(path), fs.Path(f"{path}.new")
    system = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(new, True)
    buffer = ['{\n  "%s": [' % name]
    for i, row in enumerate(rows.orderBy("question_id").toLocalIterator()):
        buffer.append(("," if i else "") + "\n    " + json.dumps(row.asDict(True), ensure_ascii=False))
        if len(buffer) >= 1000:
            out.write(bytearray("".join(buffer).encode()))
            buffer = []
    out.write(bytearray("".join([*buffer, f"\n  ]{more}\n}}\n"]).encode()))
    out.close()
    system.delete(final, False)
    if not system.rename(new, final):
        raise OSError(f"cannot write {path}")


def write_results(results: DataFrame, path: str, k: int) -> None:
    """One JSON envelope {search_results, k} of nested results."""
    _write_envelope(results, path, "search_results", f',\n  "k": {int(k)}')


def write_questions(questions: DataFrame, path: str) -> None:
    """One JSON envelope {rag_questions} of question_id, question, sources and answer."""
    _write_envelope(questions.select("question_id", "question", "sources", "answer"), path, "rag_questions")
