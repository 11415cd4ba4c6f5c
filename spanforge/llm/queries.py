"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.runtime import read_table


def p1_found(spark, sf_dir):
    from spanforge.llm.neighbours import most_similar, pairs

    return pairs(most_similar(read_table(spark, sf_dir, "chunk_vectors")))


def p2_found(spark, sf_dir):
    from spanforge.llm.borda import borda, leading

    ranked = borda(read_table(spark, sf_dir, "retrieval_scores"), read_table(spark, sf_dir, "scorers"))
    return leading(ranked, 3).select("question_id", "chunk_id")


def p3_found(spark, sf_dir):
    from spanforge.llm.docpairs import pair_functions

    return pair_functions(read_table(spark, sf_dir, "documents"), code=False).select("doc_id", "def_line", "qual_name")


def p3_pairs(spark, sf_dir):
    """The pairs themselves: signature, documentation and code of each such function."""
    from spanforge.llm.docpairs import pair_functions

    return pair_functions(read_table(spark, sf_dir, "documents"))


def p4_found(spark, sf_dir):
    from spanforge.llm.distinctive import residuals, top_term

    return top_term(residuals(read_table(spark, sf_dir, "postings")))


def p6_found(spark, sf_dir):
    from spanforge.llm.syntax import verdicts

    return verdicts(read_table(spark, sf_dir, "documents")).where("not parses").select("doc_id")


def p6_rates(spark, sf_dir):
    from spanforge.llm.syntax import rates, verdicts

    return rates(verdicts(read_table(spark, sf_dir, "documents")))


def p7_invariants(spark, sf_dir):
    """Of each document that is cut: its length, whether its pieces are within the limit and
    overlap by no more than is allowed, and the digest of its text put together from them."""
    from spanforge.llm.pieces import LIMIT, OVERLAP, split_documents

    pieces = split_documents(read_table(spark, sf_dir, "documents")).withColumn("flat", F.regexp_replace("piece", "\r\n", "\n"))
    core = F.substring("flat", (F.col("core_first") - F.col("first") + 1).cast("int"), (F.col("last") - F.col("core_first")).cast("int"))
    bounded = (F.length("flat") == F.col("last") - F.col("first")) & (F.length("flat") <= LIMIT)
    overlaps = (F.col("core_first") - F.col("first")).between(0, OVERLAP)
    one = pieces.groupBy("doc_id").agg(
        F.max("last").alias("chars"), F.min(bounded).alias("bounded"), F.min(overlaps).alias("overlaps"), F.count("*").alias("_n"),
        F.array_sort(F.collect_list(F.struct("piece_no", core.alias("core")))).alias("_cores"),
    )
    text = F.concat_ws("", F.transform("_cores", lambda c: c["core"]))
    return one.where("_n > 1").select("doc_id", "chars", "bounded", "overlaps", F.sha2(text, 256).alias("hash"))


def p8_decoded(spark, sf_dir):
    """The digest of each text decoded from its ids."""
    from spanforge.llm.encoding import decode_documents, encode_documents

    decoded = decode_documents(encode_documents(read_table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.sha2("text", 256).alias("hash"))


def p7_found(spark, sf_dir):
    from spanforge.llm.pieces import split_documents

    return split_documents(read_table(spark, sf_dir, "documents")).where("piece_no = 2").select("doc_id")


def p7_pieces(spark, sf_dir):
    from spanforge.llm.pieces import split_documents

    return split_documents(read_table(spark, sf_dir, "documents")).drop("piece")


def p8_ids(spark, sf_dir):
    from spanforge.llm.encoding import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir):
    from spanforge.llm.leakage import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def p10_found(spark, sf_dir):
    from spanforge.llm.spam import find_spam

    return find_spam(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_pairs, p4_found, p6_found, p6_rates, p7_found, p7_invariants, p7_pieces, p8_ids, p8_decoded, p9_found, p10_found)}


_P1 = """
    WITH v AS MATERIALIZED (
      SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM (
        SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY encoded_at DESC) AS rn FROM (SELECT DISTINCT vec_id, embedding, encoded_at FROM chunk_vectors)
          WHERE embedding IS NOT NULL AND len(embedding) = 384 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
            AND len([x FOR x IN embedding IF x <> 0]) > 0) WHERE rn = 1)),
    n AS (SELECT a, b FROM (
      SELECT q.vec_id AS a, v.vec_id AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e), 6) DESC, v.vec_id) AS r
      FROM v q, v WHERE q.vec_id <> v.vec_id) WHERE r <= 5)
    SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM n
"""

_P2 = """
    WITH c AS (SELECT DISTINCT question_id, chunk_id FROM retrieval_scores WHERE question_id IS NOT NULL AND chunk_id IS NOT NULL),
    s AS (SELECT question_id, scorer, chunk_id, CASE WHEN coalesce(up, true) THEN score ELSE -score END AS g FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id, scorer, chunk_id ORDER BY scored_at DESC, score DESC) AS rn FROM retrieval_scores
        WHERE score IS NOT NULL AND NOT isnan(score) AND scorer IS NOT NULL AND question_id IS NOT NULL AND chunk_id IS NOT NULL)
      LEFT JOIN (SELECT scorer, bool_or(higher_is_better) AS up FROM scorers GROUP BY scorer) USING (scorer) WHERE rn = 1),
    grid AS (SELECT c.question_id, k.scorer, c.chunk_id FROM c JOIN (SELECT DISTINCT question_id, scorer FROM s) k USING (question_id)),
    p AS (SELECT question_id, chunk_id, rank() OVER w + (count(*) OVER (PARTITION BY question_id, scorer, g) - 1) / 2.0 AS place
      FROM grid LEFT JOIN s USING (question_id, scorer, chunk_id) WINDOW w AS (PARTITION BY question_id, scorer ORDER BY g DESC NULLS LAST))
    SELECT question_id, chunk_id FROM (
      SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY pts, chunk_id) AS r FROM (
        SELECT question_id, chunk_id, coalesce(round(sum(place), 6), 0) AS pts FROM c LEFT JOIN p USING (question_id, chunk_id) GROUP BY ALL)) WHERE r <= 3
"""

_P4 = """
    WITH r AS (SELECT chunk_id, term, tf FROM (
        SELECT *, row_number() OVER (PARTITION BY chunk_id, term ORDER BY indexed_at DESC, tf DESC) AS rn
        FROM (SELECT chunk_id, lower(trim(term)) AS term, tf, indexed_at FROM postings WHERE chunk_id IS NOT NULL AND trim(term) <> '' AND tf > 0)) WHERE rn = 1),
    t AS (SELECT term, count(*) AS df, sum(tf) AS ct FROM r GROUP BY term), k AS (SELECT chunk_id, sum(tf) AS cc FROM r GROUP BY chunk_id), n AS (SELECT sum(tf) AS n FROM r)
    SELECT chunk_id, term FROM (
      SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY round((tf - e) / sqrt(greatest(e * (1 - cc / n) * (1 - ct / n), 1e-12)), 9) DESC, term) AS p
      FROM (SELECT *, cc::DOUBLE * ct / n AS e FROM r JOIN t USING (term) JOIN k USING (chunk_id), n WHERE df > 1)) WHERE p = 1
"""

_P7 = r"SELECT doc_id FROM documents WHERE length(replace(text, chr(13) || chr(10), chr(10))) > 2000"

_P7_INVARIANTS = """
    SELECT doc_id, length(flat) AS chars, true AS bounded, true AS overlaps, sha256(flat) AS hash
    FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS flat FROM documents) WHERE length(flat) > 2000
"""

_P8_DECODED = "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents"

SQL = {"p1_found": _P1, "p2_found": _P2, "p4_found": _P4, "p7_found": _P7, "p7_invariants": _P7_INVARIANTS, "p8_decoded": _P8_DECODED}
