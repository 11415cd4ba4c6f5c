"""The lexical index as tables: postings, chunk lengths, term and corpus statistics."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions.spans import cut_span, okapi_idf
from spanforge.functions.text import normal_newlines
from spanforge.operators.chunking import chunk_files, headers
from spanforge.runtime import cut, tasks_for


@dataclass
class LexicalIndex:
    """postings(term, chunk_id, tf, doc_len), doc_stats(chunk_id, doc_len),
    term_stats(term, df, idf), corpus_stats(n, avgdl), chunks(chunk_id, file_path, first, last)."""

    chunks: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame

    def written(self, *there: str) -> LexicalIndex:
        """The same index with every table written to the shared folder once, but for those that
        are ``there`` already."""
        return LexicalIndex(**{t: getattr(self, t) if t in there else cut(getattr(self, t), t) for t in self.TABLES})

    TABLES = ("chunks", "postings", "doc_stats", "term_stats", "corpus_stats")


def current_chunks(chunks: DataFrame, documents: DataFrame, line_first: bool = False) -> DataFrame:
    """chunk_id, doc_id, file_path, first, last, text of the chunks in force: the latest row of
    each chunk_id by chunked_at whose span is not empty and lies within its document's text.
    Spans count the characters of the text as it is stored; newlines are normalised after the
    cut. With ``line_first``, also where the span begins in the normalised text, as headers
    count."""
    docs = documents.select("doc_id", F.col("text").alias("_text"))
    first, last = F.col("first_character_index"), F.col("last_character_index")
    rows = chunks.select("chunk_id", "doc_id", "file_path", first.alias("first"), last.alias("last"), "chunked_at").where("last > first and first >= 0")
    newest = rows.groupBy("chunk_id").agg(F.max(F.struct("chunked_at", "doc_id", "file_path", "first", "last")).alias("c")).select("chunk_id", "c.*")
    text = cut_span(F.col("_text"), F.col("first"), F.col("last"))
    before = cut_span(F.col("_text"), F.lit(0), F.col("first") + 1)  # a span between CR and LF begins at the LF
    shift = F.length(before) - F.length(F.replace(before, F.lit("\r\n"), F.lit("\n")))
    more = [(F.col("first") - shift).alias("line_first")] if line_first else []
    return (
        newest.join(docs, "doc_id")
        .where(F.col("last") <= F.length("_text"))
        .select("chunk_id", "doc_id", "file_path", "first", "last", normal_newlines(text).alias("text"), *more)
    )


def header_context(spans: DataFrame, heads: DataFrame, key: str = "doc_id", first: str = "first") -> DataFrame:
    """``spans`` with ``context``: the titles of the last two headers at or before its first
    character (column ``first``), in document order; null where there is none. Headers of one file are gathered
    per file, and each span looks back into that array, so pairs are never built."""
    per_file = heads.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("offset", "title"))).alias("_heads"))
    seen = F.filter("_heads", lambda h: h["offset"] <= F.col(first))
    last_two = F.slice(seen, F.greatest(F.size(seen) - 1, F.lit(1)), F.lit(2))
    titles = F.transform(last_two, lambda h: h["title"])
    return spans.join(per_file, key, "left").withColumn("context", F.when(F.size(seen) > 0, F.concat_ws(" ", titles))).drop("_heads")


def chunk_corpus(files: DataFrame, max_chunk: int = 2000, key: str = "doc_id") -> DataFrame:
    """chunk_id, key, file_path, first, last, text, context for every chunk of ``files``. The
    chunk_id is a hash of path and span, so that unchanged chunks keep theirs."""
    spans = chunk_files(files, max_chunk, key=key).select(
        key, "file_path", F.col("first_character_index").alias("first"), F.col("last_character_index").alias("last")
    )
    text = files.select(F.col(key), normal_newlines("text").alias("_text"))
    marked = F.col("file_path").endswith(".md") | F.col("file_path").endswith(".txt")
    heads = headers(files.where(marked), key)
    rows = header_context(spans, heads, key).join(text, key)
    return rows.select(
        F.xxhash64("file_path", "first", "last").alias("chunk_id"), key, "file_path", "first", "last", cut_span(F.col("_text"), F.col("first"), F.col("last")).alias("text"), "context"
    )


def exploded_terms(rows: DataFrame, key: str, *found: tuple[Column, int]) -> DataFrame:
    """key, term, weight for arrays of words with their weights: the same terms as
    functions.text.terms, but one row each, so that splitting and stemming are compiled instead
    of interpreted per element. The rows are read once for all arrays. None of the arrays is
    ever empty, and explode_outer keeps Catalyst from computing each once more in an inferred
    filter on its size."""
    groups = F.array(*[F.struct(words.alias("words"), F.lit(weight).cast("long").alias("weight")) for words, weight in found])
    one = rows.select(key, F.explode_outer(groups).alias("g")).select(key, "g.weight", F.explode("g.words").alias("word"))
    part = one.select(key, "weight", F.explode_outer(T.split_identifier(F.col("word"))).alias("part")).where(T.is_term(F.col("part")))
    both = F.array_distinct(F.array(F.col("part"), T.stem(F.col("part"))))
    return part.select(key, F.explode_outer(both).alias("term"), "weight")


def term_counts(chunks: DataFrame, lengths: bool = False) -> DataFrame:
    """chunk_id, term, tf: weighted occurrences of each term of each chunk (text, file_path and,
    if there, context). The texts are spread by chunk_id once and counted in batches, each
    distinct word of a chunk once: exploded, every occurrence of a word was a row. Rows of one
    chunk_id are counted together. With ``lengths``, also doc_len, the chunk's sum of tf. The number of tasks follows from the size of the files that
    the texts are read from."""
    found = [("text", T.BODY_WEIGHT), ("file_path", T.CONTEXT_WEIGHT)]
    if "context" in chunks.columns:
        found.append(("context", T.CONTEXT_WEIGHT))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    names = ["chunk_id", "term", "tf", *["doc_len"] * lengths]
    rows = chunks.select("chunk_id", *[c for c, _ in found]).repartition(tasks_for(chunks), "chunk_id").sortWithinPartitions("chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of: dict[str, tuple[str, ...]] = {}
        ids, sizes, sums, terms, counts = [], [], [], [], []
        last, tf = None, {}

        def close() -> None:
            ids.append(last)
            sizes.append(len(tf))
            sums.append(sum(tf.values()))
            terms.extend(tf)
            counts.extend(tf.values())

        def batch(like: pa.RecordBatch) -> pa.RecordBatch:
            key = pa.array(ids, like.schema.field(0).type).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
            more = [pa.array(np.repeat(np.array(sums, np.int64), sizes))] if lengths else []
            return pa.RecordBatch.from_arrays([key, pa.array(terms, pa.string()), pa.array(counts, pa.int64()), *more], names)

        b = None
        for b in batches:
            for key, *texts in zip(*(c.to_pylist() for c in b.columns)):
                if tf and key != last:
                    close()
                    tf = {}
                    if len(terms) > 100_000:
                        yield batch(b)
                        for x in (ids, sizes, sums, terms, counts):
                            x.clear()
                last = key
                for (column, weight), text in zip(found, texts):
                    for word, n in Counter(T.find_words(text or "")).items():
                        if column == "file_path" and word.lower() in T.PATH_NOISE:
                            continue
                        got = terms_of.get(word)
                        if got is None:
                            if len(terms_of) >= 200_000:
                                terms_of.clear()
                            got = terms_of[word] = T.word_terms(word)
                        for t in got:
                            tf[t] = tf.get(t, 0) + n * weight
        if tf:
            close()
        if terms:
            yield batch(b)

    return rows.mapInArrow(run, f"chunk_id {kind}, term string, tf long" + ", doc_len long" * lengths)


ASKED_ROWS = 2_048  # chunks whose words are counted at a time


def asked_counts(chunks: DataFrame, asked: list[str]) -> DataFrame:
    """chunk_id, file_path, doc_len, codes, tfs: of each row of ``chunks`` the length of its chunk_id as
    ``term_counts`` has it, over all terms, and of the terms that are in ``asked`` their places there and their tf,
    as two strings of 32-bit numbers in order of places. Rows of one chunk_id are counted together; the
    first of them has their terms. What is not asked for is counted and left, and a chunk's terms are one row."""
    found = [("text", T.BODY_WEIGHT), ("file_path", T.CONTEXT_WEIGHT)]
    if "context" in chunks.columns:
        found.append(("context", T.CONTEXT_WEIGHT))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", *[c for c, _ in found]).repartition(tasks_for(chunks), "chunk_id").sortWithinPartitions("chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(asked)}
        known = defaultdict(count().__next__)  # the words met so far are numbered
        none = np.zeros(0, np.int64)
        n_terms, n_codes, code, first_code = none, none, none, none  # of each of them how many terms, how many of these asked for, and which

        def counted(table: pa.Table) -> pa.RecordBatch:
            nonlocal known, n_terms, n_codes, code, first_code
            if len(known) > 200_000:
                known, n_terms, n_codes, code = defaultdict(count().__next__), none, none, none
            ids = table.column("chunk_id").to_pylist()
            begins = np.array([i == 0 or x != ids[i - 1] for i, x in enumerate(ids)])
            chunk = np.cumsum(begins) - 1
            size = int(chunk[-1]) + 1
            length, keys = np.zeros(size, np.int64), []
            for column, weight in found:
                words = [T.find_words(t or "") for t in table.column(column).to_pylist()]
                if column == "file_path":
                    words = [[w for w in ws if w.lower() not in T.PATH_NOISE] for ws in words]
                at = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64)
                if len(n_terms) < len(known):
                    new = [T.word_terms(w) for w in islice(known, len(n_terms), None)]
                    own = [[place[t] for t in got if t in place] for got in new]
                    n_terms = np.concatenate([n_terms, [len(got) for got in new]])
                    n_codes = np.concatenate([n_codes, [len(x) for x in own]])
                    code = np.concatenate([code, np.fromiter(chain.from_iterable(own), np.int64)])
                    first_code = np.cumsum(n_codes) - n_codes
                if not len(at):
                    continue
                row = np.repeat(chunk, [len(ws) for ws in words])
                length += weight * np.bincount(row, n_terms[at], size).astype(np.int64)
                many = n_codes[at]
                ends = np.cumsum(many)
                each = np.repeat(first_code[at] - ends + many, many) + np.arange(ends[-1])
                keys += [np.repeat(row, many) * len(asked) + code[each]] * weight
            key = np.sort(np.concatenate(keys or [none]))
            runs = np.flatnonzero(np.diff(key, prepend=-1))
            row, term = np.divmod(key[runs], len(asked))
            per_row = np.where(begins, np.bincount(row, minlength=size)[chunk], 0)
            offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32) * 4

            def strings(x: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype(np.int32))])

            out = [table.column("chunk_id").combine_chunks(), table.column("file_path").combine_chunks(), pa.array(length[chunk]), strings(term), strings(np.diff(runs, append=len(key)))]
            return pa.RecordBatch.from_arrays(out, ["chunk_id", "file_path", "doc_len", "codes", "tfs"])

        left = None
        for b in batches:
            for i in range(0, b.num_rows, ASKED_ROWS):
                table = pa.Table.from_batches([b.slice(i, ASKED_ROWS)])
                left = table if left is None else pa.concat_tables([left, table])
                ids = left.column("chunk_id").to_pylist()
                done = len(ids) - 1
                while done and ids[done - 1] == ids[-1]:  # more rows of the last chunk_id may follow
                    done -= 1
                if done:
                    yield counted(left.slice(0, done))
                    left = left.slice(done)
        if left is not None:
            yield counted(left)

    return rows.mapInArrow(run, f"chunk_id {kind}, file_path string, doc_len long, codes binary, tfs binary")


def build_index(chunks: DataFrame, counts: DataFrame | None = None) -> LexicalIndex:
    """All tables of the index. ``chunks`` has chunk_id, file_path, first, last, text and
    optionally context; ``counts`` may hold ready-made term counts, which need no join if they have doc_len. Chunks without terms count
    with length 0. An empty corpus gives empty tables and avgdl 0."""
    counts = term_counts(chunks, lengths=True) if counts is None else counts
    known = "doc_len" in counts.columns
    lengths = counts.groupBy("chunk_id").agg((F.max("doc_len") if known else F.sum("tf")).alias("doc_len"))
    doc_stats = chunks.select("chunk_id").join(lengths, "chunk_id", "left").select("chunk_id", F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"))
    corpus = doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    term_stats = df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", okapi_idf(F.col("n"), F.col("df")).alias("idf"))
    postings = (counts if known else counts.join(lengths, "chunk_id")).select("term", "chunk_id", "tf", "doc_len")
    return LexicalIndex(chunks.select("chunk_id", "file_path", "first", "last"), postings, doc_stats, term_stats, corpus)


def question_words(questions: DataFrame) -> DataFrame:
    """question_id, term, pos of every term of each question, repeated ones too; pos grows with
    its place (word, part, form)."""
    found = F.filter(T.words(F.col("question")), lambda w: F.length(w) > 1)
    one = questions.select("question_id", F.posexplode_outer(found).alias("_w", "word")).where("word is not null")
    part = one.select("question_id", "_w", F.posexplode_outer(T.split_identifier(F.col("word"))).alias("_p", "part")).where(T.is_term(F.col("part")))
    both = F.array_distinct(F.array(F.col("part"), T.stem(F.col("part"))))
    rows = part.select("question_id", "_w", "_p", F.posexplode_outer(both).alias("_f", "term"))
    place = F.col("_w").cast("long") * (1 << 31) + F.col("_p") * 2 + F.col("_f")  # one number: structs would be sorted, not hashed
    return rows.select("question_id", "term", place.alias("pos"))


def query_terms(questions: DataFrame) -> DataFrame:
    """question_id, term, pos: the distinct terms of each question with the place of their
    first occurrence. Blank and null questions have none."""
    return question_words(questions).groupBy("question_id", "term").agg(F.min("pos").alias("pos"))


def latest_questions(questions: DataFrame) -> DataFrame:
    """One row per question_id, the latest by asked_at."""
    w = Window.partitionBy("question_id").orderBy(F.desc("asked_at"), "question")
    return questions.where("question_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
