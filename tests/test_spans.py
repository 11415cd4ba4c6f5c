import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import spans as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize("a,b,want", [((0, 100), (50, 150), 1 / 3), ((0, 2000), (0, 100), 0.05), ((5, 5), (7, 7), 0.0), ((0, 10), (20, 30), 0.0)])
def test_iou(spark, a, b, want):
    lit = [F.lit(x) for x in (*a, *b)]
    assert one(spark, S.iou(*lit)) == pytest.approx(want)
    assert one(spark, S.iou(*lit[2:], *lit[:2])) == pytest.approx(want)


def test_formulas(spark):
    assert one(spark, S.okapi_idf(F.lit(3), F.lit(1))) == pytest.approx(math.log(1 + 2.5 / 1.5))
    assert one(spark, S.rrf_term(F.lit(1), 1.0) + S.rrf_term(F.lit(3), 0.8)) == pytest.approx(1 / 61 + 0.8 / 63)
    assert one(spark, S.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) is None


@pytest.mark.parametrize(
    "lengths,want",
    [((1000, 900, 50), (1000, 800)), ((1750, 900, 40), (1750,)), ((500, 0, 600, 700), (500, 600)), ((), ()), ((0, 0), ())],
)
def test_context(spark, lengths, want):
    snippets = F.array(*[F.lit("x" * n) for n in lengths]).cast("array<string>")
    assert one(spark, S.assemble_context(snippets)) == "\n\n".join("x" * n for n in want)
    assert one(spark, S.assemble_context(F.lit(None).cast("array<string>"))) == ""


def test_boost(spark):
    rows = [("a.md", "docs", 1.3), ("x/docs/a.py", "docs", 1.3), ("a.py", "docs", 1.0), ("a.py", "code", 1.3), ("a.py", None, 1.0), ("a.txt", "code", 1.0)]
    df = spark.createDataFrame(rows, "p string, t string, want double")
    assert df.where(S.type_boost(F.col("p"), F.col("t")) != F.col("want")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab \t\r\n", max_size=20))
def test_trimmed_span_matches_strip(spark, text):
    r = one(spark, S.trimmed_span(F.lit(text), F.lit(0), F.lit(len(text))))
    assert text[r.first : r.last] == text.strip(" \t\r\n")
