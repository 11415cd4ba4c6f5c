"""Golden vectors of the tokeniser."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.index import term_counts

SPLITS = {
    "FP8_MIN": "fp8_min fp8 min fp min",
    "fused_batched_moe": "fused_batched_moe fused batched moe fused batched moe",
    "ModelRunner": "modelrunner model runner",
    "FOO_BAR": "foo_bar foo bar",
    "__init__": "__init__ init",
    "HTTPServer2Go": "httpserver2go http server go",
}
STEMS = {
    "vectors": "vector", "classes": "class", "caches": "cach", "cache": "cache", "queries": "query", "ties": "tie",
    "process": "process", "processes": "process", "bus": "bus", "string": "str", "using": "using", "quantizing": "quantize",
    "creating": "create", "quantization": "quantizate", "station": "state", "need": "need", "speed": "spe", "fused": "fus",
}


def test_split_identifier(spark):
    df = spark.createDataFrame([(w,) for w in SPLITS], "w string")
    assert {r.w: " ".join(r.p) for r in df.select("w", T.split_identifier(F.col("w")).alias("p")).collect()} == SPLITS


def test_stem(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    assert {r.w: r.s for r in df.select("w", T.stem(F.col("w")).alias("s")).collect()} == STEMS


@pytest.mark.parametrize(
    "body,path,want",
    [
        ("FP8_MIN", None, {"fp8_min": 1, "fp8": 1, "min": 2, "fp": 1}),
        ("fused_batched_moe", None, {"fused_batched_moe": 1, "fused": 2, "fus": 2, "batched": 2, "batch": 2, "moe": 2}),
        ("The vectors a", None, {"vectors": 1, "vector": 1}),
        ("", "data/raw/vllm-0.10.1/vllm/config/__init__.py", {"10": 2, "config": 2, "__init__": 2, "init": 2}),
    ],
)
def test_terms_nested_and_exploded_agree(spark, body, path, want):
    df = spark.createDataFrame([(1, body, path or "")], "chunk_id long, text string, file_path string")
    rows = df.select(F.explode(T.terms(F.col("text"), F.col("file_path"))).alias("t")).select("t.*").collect()
    nested = Counter()
    for r in rows:
        nested[r.term] += r.weight
    assert nested == want
    assert {r.term: r.tf for r in term_counts(df).collect()} == want


def test_null_text_has_no_terms(spark):
    df = spark.createDataFrame([(1, None, None, None)], "chunk_id long, text string, file_path string, context string")
    assert term_counts(df).count() == 0


def test_cache_key_keeps_case_and_version(spark):
    key = lambda v, q: spark.range(1).select(T.cache_key(F.lit(v), F.lit(q), F.lit(5))).head()[0]
    assert key("a", " q ") == key("a", "q") and key("a", "Q") != key("a", "q") and key("b", "q") != key("a", "q")
