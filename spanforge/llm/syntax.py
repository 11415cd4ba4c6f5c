"""Source files that do not parse in the language of their suffix."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.grammar import SUFFIX, judge

VERDICT = "doc_id long, language string, source string, parses boolean, ranked array<string>, accepted array<string>, cause string"


def language_of(path: Column) -> Column:
    """Language by suffix, null where none of the supported grammars is declared."""
    out = F.lit(None).cast("string")
    for suffix, lang in SUFFIX.items():
        out = F.when(F.lower(path).endswith(suffix), lang).otherwise(out)
    return out


def verdicts(documents: DataFrame) -> DataFrame:
    """One row per file of a supported language whose text is neither null nor blank: whether
    it parses, the languages ranked by their tokens, those whose grammar accepts it, and the
    cause of failure. Whole texts are parsed, each by itself in its batch, without a shuffle.
    Rows with a null path or text, and blank texts, have no verdict; a null source is kept."""
    lang = language_of(F.col("file_path"))
    rows = documents.select("doc_id", lang.alias("language"), "source", "text")
    rows = rows.where(F.col("language").isNotNull() & F.col("text").rlike(r"(?U)\S"))

    def run(batches):
        for b in batches:
            langs = b.column("language").to_pylist()
            found = [judge(t, lang) for t, lang in zip(b.column("text").to_pylist(), langs)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], [], []), (pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("language"), b.column("source"), *columns], ["doc_id", "language", "source", "parses", "ranked", "accepted", "cause"])

    return rows.mapInArrow(run, VERDICT)


def rates(judged: DataFrame) -> DataFrame:
    """Files, failures and their rate per source and language. Spellings of a source that
    differ in case, blanks or underscores are one; a null source is its own group."""
    source = F.regexp_replace(F.lower(F.trim("source")), "_", "-")
    bad = (~F.col("parses")).cast("long")
    wrong = F.coalesce(F.col("cause").startswith("wrong"), F.lit(False)).cast("long")
    return (
        judged.groupBy(source.alias("source"), "language")
        .agg(F.count("*").alias("files"), F.sum(bad).alias("failed"), F.sum(wrong).alias("wrong_extension"))
        .withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))
    )
