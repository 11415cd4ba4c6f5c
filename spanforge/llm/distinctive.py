"""How distinctive a term is for its record: residuals of correspondence analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import cut, join_totals


def clean_postings(postings: DataFrame) -> DataFrame:
    """chunk_id, term, tf: one row per chunk and term, the term in lower case without outer
    blanks. Rows with null or blank term, null chunk_id or without positive tf do not count;
    of several rows the latest by indexed_at counts, of equally late ones the largest tf."""
    term = F.lower(F.regexp_replace("term", r"(?U)^\s+|\s+$", ""))
    rows = postings.select("chunk_id", term.alias("term"), "tf", "indexed_at").where("chunk_id is not null and term is not null and term <> '' and tf > 0")
    return rows.groupBy("chunk_id", "term").agg(F.max(F.struct("indexed_at", "tf")).alias("last")).select("chunk_id", "term", F.col("last.tf").alias("tf"))


def residuals(postings: DataFrame) -> DataFrame:
    """chunk_id, term, tf, df, weight for each posting of a term that several chunks share.

    The weight is the adjusted residual of the chunk-term table, (o - e) / sqrt(e (1 - r)
    (1 - c)), with o the count, e = N r c its expectation and r, c the shares of the chunk and
    of the term in all counts. Terms of one chunk only are left out, but fill the margins.
    Totals cover all rows. Sums combine map-side; totals of terms or chunks with very many
    rows are broadcast to these, so no task gets all rows of one. Empty tables give no rows.
    """
    rows = cut(clean_postings(postings), "clean-postings")
    terms = cut(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_of_term")), "term-totals")
    chunks = cut(rows.groupBy("chunk_id").agg(F.count("*").alias("_terms"), F.sum("tf").alias("_of_chunk")), "chunk-totals")
    total = chunks.agg(F.sum("_of_chunk").alias("_n"))  # one row
    joined = join_totals(join_totals(rows, terms.where("df > 1"), "term", "df"), chunks, "chunk_id", "_terms").crossJoin(F.broadcast(total))
    e = F.col("_of_chunk") * F.col("_of_term") / F.col("_n")
    spare = (1 - F.col("_of_chunk") / F.col("_n")) * (1 - F.col("_of_term") / F.col("_n"))
    weight = (F.col("tf") - e) / F.sqrt(F.greatest(e * spare, F.lit(1e-12)))
    return joined.select("chunk_id", "term", "tf", "df", weight.alias("weight"))


def top_term(weights: DataFrame) -> DataFrame:
    """The heaviest term of each chunk; of equal ones the first in order. No sort, no window."""
    best = F.min(F.struct((-F.round("weight", 9)).alias("w"), F.col("term")))
    return weights.groupBy("chunk_id").agg(best.alias("best")).select("chunk_id", F.col("best.term").alias("term"))
