"""Identifier-aware tokenisation as Column expressions, and for counting in batches as functions."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that are no terms
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
could did do does doing down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same should so some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while who whom why with would you your yours
yourself yourselves
""".split()
#: fixed values: path words that say nothing
PATH_NOISE = ["data", "raw", "vllm", "py", "md", "src"]
#: fixed values: words, and the runs of capitals, small letters and digits inside one
WORD = "[a-zA-Z0-9_]+"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\W|$)|[0-9]+"

BODY_WEIGHT, CONTEXT_WEIGHT = 1, 2


def is_term(c: Column) -> Column:
    return (F.length(c) > 1) & ~c.isin(*STOPWORDS)


def normal_newlines(text: Column | str) -> Column:
    """CRLF and lone CR as LF: the text that all character positions refer to."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


#: what ends a line beside CR and CRLF, and what counts as blank: characters of Unicode, as Python's strings know them
LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANK_CHAR = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stem(word: Column) -> Column:
    """Lower case without a common English suffix; the first rule that fits is applied."""
    w = F.lower(word)
    n = F.length(w)
    drop = lambda k: F.substring(w, F.lit(1), n - k)

    def restored(base: Column) -> Column:
        return F.when(base.endswith("at") | base.endswith("iz"), F.concat(base, F.lit("e"))).otherwise(base)

    last = F.substring(w, -1, 1)
    return (
        F.when((n <= 3) | ~last.isin("s", "g", "d", "n"), w)
        .when(w.endswith("ies") & (n > 4), F.concat(drop(3), F.lit("y")))
        .when(w.endswith("es") & F.substring(w, -3, 1).isin("s", "h", "x", "z"), drop(2))
        .when((last == "s") & ~w.endswith("ss"), drop(1))
        .when(w.endswith("ing") & (n > 5), restored(drop(3)))
        .when(w.endswith("ed") & (n > 4), restored(drop(2)))
        .when(w.endswith("tion") & (n > 5), F.concat(drop(4), F.lit("te")))
        .otherwise(w)
    )


def split_identifier(word: Column) -> Column:
    """The lowered word, then its snake-case parts if it has an underscore, then its camel-case
    parts if there are several. Parts of one letter and stopwords are left out, repeats kept."""
    none = F.array().cast("array<string>")
    kept = lambda parts: F.filter(F.transform(parts, F.lower), is_term)
    camel = F.regexp_extract_all(word, F.lit(CAMEL), F.lit(0))
    split = F.concat(
        F.array(F.lower(word)),
        F.when(word.contains("_"), kept(F.split(word, "_"))).otherwise(none),
        F.when(F.size(camel) > 1, kept(camel)).otherwise(none),
    )
    return F.when(word.rlike("^[A-Z]?[a-z]+$"), F.array(F.lower(word))).otherwise(split)  # most words are plain


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


find_words = re.compile(WORD).findall
_PLAIN, _CAMEL, _STOP = re.compile("[A-Z]?[a-z]+"), re.compile(CAMEL, re.ASCII), frozenset(STOPWORDS)


def stem_of(w: str) -> str:
    """``stem`` of a word in lower case."""
    restored = lambda base: base + "e" if base.endswith(("at", "iz")) else base
    n, last = len(w), w[-1:]
    if n <= 3 or last not in "sgdn":
        return w
    if w.endswith("ies") and n > 4:
        return w[:-3] + "y"
    if w.endswith("es") and w[-3] in "shxz":
        return w[:-2]
    if last == "s" and not w.endswith("ss"):
        return w[:-1]
    if w.endswith("ing") and n > 5:
        return restored(w[:-3])
    if w.endswith("ed") and n > 4:
        return restored(w[:-2])
    return w[:-4] + "te" if w.endswith("tion") and n > 5 else w


def word_terms(word: str) -> tuple[str, ...]:
    """The terms of a word that ``find_words`` found, as ``terms`` has them: of each part of
    ``split_identifier`` that is a term itself and its stem, repeats kept."""
    low = word.lower()
    if _PLAIN.fullmatch(word) or word.isdigit():
        return _part_terms(low)
    parts = low.split("_") if "_" in word else []
    camel = _CAMEL.findall(word)
    parts += [p.lower() for p in camel] if len(camel) > 1 else []
    return (*_part_terms(low), *chain.from_iterable(map(_known_part, parts)))


def _part_terms(p: str) -> tuple[str, ...]:
    if len(p) < 2 or p in _STOP:
        return ()
    stem = stem_of(p)
    return (p,) if stem == p else (p, stem)


_known_part = lru_cache(1 << 16)(_part_terms)  # parts recur in many words


def _terms(found: Column, weight: int) -> Column:
    """Weighted terms of an array of words: each term, and its stem where that differs."""

    def of_word(word: Column) -> Column:
        parts = F.filter(split_identifier(word), is_term)
        return F.flatten(F.transform(parts, lambda p: F.array_distinct(F.array(p, stem(p)))))

    terms = F.flatten(F.transform(found, of_word))
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).cast("long").alias("weight")))


def body_terms(text: Column) -> Column:
    """ARRAY<STRUCT<term, weight>> of a text, each occurrence with weight 1."""
    return _terms(F.filter(words(text), lambda w: F.length(w) > 1), BODY_WEIGHT)


def header_terms(context: Column) -> Column:
    """Terms of a chunk's header context, with weight 2."""
    return _terms(F.filter(words(context), lambda w: F.length(w) > 1), CONTEXT_WEIGHT)


def path_terms(path: Column) -> Column:
    """Terms of a file path, with weight 2; words of PATH_NOISE are skipped as a whole."""
    return _terms(F.filter(words(path), lambda w: ~F.lower(w).isin(*PATH_NOISE)), CONTEXT_WEIGHT)


def terms(text: Column, path: Column | None = None, context: Column | None = None) -> Column:
    """All weighted terms of a chunk: of its path, its header context and its body."""
    parts = [path_terms(path)] if path is not None else []
    parts += [header_terms(context)] if context is not None else []
    return F.concat(*parts, body_terms(text))


def cache_key(version: Column, query: Column, *params: Column) -> Column:
    """Key of a cached result: index version, trimmed query as written, and all parameters."""
    return F.sha2(F.concat_ws(":", version, F.trim(query), *[F.coalesce(p.cast("string"), F.lit("")) for p in params]), 256)
