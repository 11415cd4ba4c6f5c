"""Character spans, ranking formulas and text assembly as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two half-open intervals; 0.0 where the union is empty."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def cut_span(text: Column, first: Column, last: Column) -> Column:
    """The characters first <= i < last."""
    return F.substring(text, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def trimmed_span(text: Column, first: Column, last: Column) -> Column:
    """STRUCT<first, last> of the span without blanks at its ends."""
    t = cut_span(text, first, last)
    head = F.length(t) - F.length(F.ltrim(t, F.lit(BLANK)))
    body = F.length(F.trim(t, F.lit(BLANK)))
    start = F.when(body > 0, first + head).otherwise(first)
    return F.struct(start.cast("long").alias("first"), (start + body).cast("long").alias("last"))


def okapi_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, idf: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * (length / average)))


def type_boost(path: Column, doc_type: Column, factor: float = 1.3) -> Column:
    """Factor for chunks of the wanted type: docs are .md and .txt files and all below /docs/,
    code is .py; 1.0 otherwise, and where no type is wanted."""
    docs = path.endswith(".md") | path.endswith(".txt") | path.contains("/docs/")
    wanted = ((doc_type == "docs") & docs) | ((doc_type == "code") & path.endswith(".py"))
    return F.when(F.coalesce(wanted, F.lit(False)), F.lit(factor)).otherwise(F.lit(1.0))


def rrf_term(rank: Column, weight: float, k: int = 60) -> Column:
    """Share of a 1-based rank in a fused score."""
    return F.lit(float(weight)) / (k + rank)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def embedding_text(path: Column, chunk: Column, chars: int = 400) -> Column:
    """What is embedded of a chunk: its path, then the first characters of its trimmed text."""
    return F.concat(path, F.lit("\n"), F.substring(F.trim(chunk, F.lit(BLANK)), 1, chars))


def doc_type_of(name: Column) -> Column:
    """Document type that a data set's name asks for: docs, else code, else null."""
    return F.when(name.contains("doc"), "docs").when(name.contains("code"), "code")


def assemble_context(snippets: Column, max_chars: int = 1800, max_snippets: int = 3, least: int = 100) -> Column:
    """Context of the first ranked snippets, joined by blank lines.

    Snippets are trimmed and empty ones skipped. The first that would exceed ``max_chars`` is
    cut to what remains if that is more than ``least``, and nothing follows it. Separators do
    not count. A null array gives an empty context.
    """
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        t = F.trim(x, F.lit(BLANK))
        left = F.lit(max_chars) - s["used"]
        fits = F.length(t) <= left
        cut = F.when(left > least, F.concat(s["kept"], F.array(F.substring(t, F.lit(1), left)))).otherwise(s["kept"])
        taken = F.struct(
            F.when(fits, s["used"] + F.length(t)).otherwise(s["used"]).alias("used"),
            (~fits).alias("full"),
            F.when(fits, F.concat(s["kept"], F.array(t))).otherwise(cut).alias("kept"),
        )
        return F.when(s["full"] | t.isNull() | (F.length(t) == 0), s).otherwise(taken)

    first = F.slice(F.coalesce(snippets, F.array().cast("array<string>")), 1, max_snippets)
    return F.concat_ws("\n\n", F.aggregate(first, zero, step)["kept"])


SYSTEM_PROMPT = "Answer the question in one or two sentences, from the given context alone. Say so if the context does not hold the answer."


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)
