"""Terms counted in batches against the Column expressions."""

from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import index as X

WORDS = """HTTPServer parseURLs2 snake_case_ids __init__ a A x1 ABCd ABC1 A_B_cd running created organizing sized relation nation
flies dies boxes buses pass glass gas class The of FP8_MIN HTTP2Server_v10 _ __ 42 4x x_y_z ties ied ing ings bed seed station
iPhone iPHONE aB Ab ABc9Def data py createAted ization theThe of_the_case camelCase camelCase""".split()


def test_terms_of_words_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", F.col("w").alias("word"), T.terms(F.col("w")).alias("t")).collect()
    assert {r.w: [t["term"] for t in r.t] for r in rows} == {w: [t for t in T.word_terms(w) if len(w) > 1] for w in WORDS}


def test_counts_are_those_of_exploded_terms(spark):
    text = " ".join(WORDS)
    rows = [(1, "src/a_b/x.py", text, "The Heading of createdThings"), (1, "src/a_b/x.py", "again running", None), (2, None, None, None), (3, "data/Raw.md", "é ünï x", "")]
    rows += [(i, f"p/{i}.py", f"word{i} same same", None) for i in range(10, 60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_path string, text string, context string").repartition(3)
    long = lambda c: F.filter(T.words(F.col(c)), lambda w: F.length(w) > 1)
    path = F.filter(T.words(F.col("file_path")), lambda w: ~F.lower(w).isin(*T.PATH_NOISE))
    want = X.exploded_terms(chunks, "chunk_id", (long("text"), 1), (path, 2), (long("context"), 2)).groupBy("chunk_id", "term").agg(F.sum("weight").alias("tf"))
    got = X.term_counts(chunks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert X.term_counts(chunks.drop("context")).where("chunk_id = 10").count() == 3
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()


def test_postings_with_lengths_need_no_join(spark):
    chunks = spark.createDataFrame([(1, "a.py", 0, 9, "one two twos"), (2, "b.py", 0, 9, ""), (3, "cc.py", 0, 9, "two")], "chunk_id long, file_path string, first long, last long, text string")
    index, joined = X.build_index(chunks), X.build_index(chunks, X.term_counts(chunks))
    for t in X.LexicalIndex.TABLES:
        assert sorted(map(tuple, getattr(index, t).collect())) == sorted(map(tuple, getattr(joined, t).collect()))
    assert "Join" not in index.postings._jdf.queryExecution().executedPlan().toString()
