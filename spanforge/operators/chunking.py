"""Splitting files into bounded spans: windows and headers as DataFrame expressions, the
syntax-aware and paragraph-aware chunkers as Arrow batch functions."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.spans import trimmed_span
from spanforge.functions.text import BLANK_CHAR, LINE_END, normal_newlines

MAX_CHUNK = 2000
LEAST_SECTION = 40
BLOCK_OVERLAP = 300
HEADER = r"^(#{1,6})\s+([\s\S]*)$"


# ---------------------------------------------------------------- windows and lines, native


def window_step(max_chunk: int, ratio: float = 0.15) -> int:
    """How far windows advance: the size less the overlap, which is at least 50."""
    return max(1, max_chunk - max(50, int(max_chunk * ratio)))


def slice_windows(spans: DataFrame, first: str = "first", last: str = "last", max_chunk: int = MAX_CHUNK, ratio: float = 0.15) -> DataFrame:
    """Each span cut into overlapping windows of at most ``max_chunk``; replaces first and last
    and adds window_no from 0. Empty and null spans give no rows. The number of windows has a
    closed form, so nothing is looped over."""
    step = window_step(max_chunk, ratio)
    length = F.col(last) - F.col(first)
    extra = F.greatest(F.lit(0), F.ceil((length - max_chunk) / step)).cast("int")
    start = (F.col(first) + F.col("window_no") * step).cast("long")
    return (
        spans.where(length > 0)
        .withColumn("window_no", F.explode(F.sequence(F.lit(0), extra)))
        .withColumns({first: start, last: F.least(start + max_chunk, F.col(last)).cast("long")})
    )


def lines(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no from 0, line, line_start: the lines of each text with their number and
    character offsets after newline normalisation. Lines end as Python's ``splitlines`` ends
    them; what follows the last end is a line too, even if it is empty. A null text has no
    lines. Nothing but the key is kept beside a line, so no text is repeated for each."""
    cut = F.split(normal_newlines("text"), f"(?<={LINE_END})")
    split = files.where(F.col("text").isNotNull()).select(key, F.posexplode_outer(cut).alias("line_no", "_line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_line")).over(w), F.lit(0)).cast("long")
    return split.select(key, "line_no", F.regexp_replace("_line", f"{LINE_END}$", "").alias("line"), start.alias("line_start"))


def headers(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, offset, level, title of each Markdown header line, fences regardless. Texts are cut
    where a header line begins and nowhere else, and of each part only its length and first
    line are kept."""
    parts = F.split(normal_newlines("text"), f"(?<={LINE_END})(?=#{{1,6}}{BLANK_CHAR})")
    one = files.where(F.col("text").contains("#")).select(key, F.posexplode(parts).alias("_no", "_part"))
    first = F.regexp_extract("_part", f"^#{{1,6}}(?={BLANK_CHAR})", 0)
    line = F.regexp_extract("_part", f"^#{{1,6}}([^{LINE_END[1:]}*)", 1)
    head = one.select(key, "_no", F.length("_part").alias("_size"), F.length(first).alias("level"), F.regexp_replace(line, f"^{BLANK_CHAR}+|{BLANK_CHAR}+$", "").alias("title"))
    w = Window.partitionBy(key).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_size").over(w), F.lit(0)).cast("long")
    return head.select(key, offset.alias("offset"), "level", "title").where("level > 0")


def leaf_sections(heads: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, last: from each header to the next, or to the end of the text (``sizes`` has
    key and size)."""
    w = Window.partitionBy(key).orderBy("offset")
    return (
        heads.join(sizes.select(key, "size"), key)
        .select(key, F.col("offset").alias("first"), F.coalesce(F.lead("offset").over(w), F.col("size")).cast("long").alias("last"))
    )


def parent_sections(heads: DataFrame, sizes: DataFrame, key: str = "doc_id", max_chunk: int = MAX_CHUNK) -> DataFrame:
    """key, first, last: from each header to the next of its level or above; only sections of
    at most ``max_chunk``. The nearest such header is found by one window per level bound, so
    headers are never paired with each other."""
    w = Window.partitionBy(key).orderBy("offset").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= lv, F.col("offset"))).over(w) for lv in range(1, 7)]
    end = F.element_at(F.array(*ends), F.col("level"))
    out = heads.join(sizes.select(key, "size"), key).select(key, F.col("offset").alias("first"), F.coalesce(end, F.col("size")).cast("long").alias("last"))
    return out.where(F.col("last") - F.col("first") <= max_chunk)


def trim_and_filter(spans: DataFrame, text: Column, least: int = LEAST_SECTION, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Spans first, last without blanks at their ends, kept if least <= length <= max_chunk."""
    t = spans.withColumn("_t", trimmed_span(text, F.col("first"), F.col("last")))
    size = F.col("_t.last") - F.col("_t.first")
    return t.where(size.between(least, max_chunk)).withColumns({"first": F.col("_t.first"), "last": F.col("_t.last")}).drop("_t")


def sections(files: DataFrame, key: str = "doc_id", least: int = LEAST_SECTION, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """key, first, last: what of a Markdown or plain text can be taken whole, trimmed and
    distinct: the part before its first header, sections and sections with their subsections,
    of ``least`` to ``max_chunk`` characters. Texts without headers have none."""
    texts = files.where(F.col("text").isNotNull()).select(key, normal_newlines("text").alias("_text"))
    heads = headers(files, key)
    sizes = texts.select(key, F.length("_text").cast("long").alias("size"))
    zero = F.lit(0).cast("long")
    before = heads.groupBy(key).agg(F.min("offset").alias("last")).where("last > 0").select(key, zero.alias("first"), "last")
    leaves = leaf_sections(heads, sizes, key).where(F.col("last") - F.col("first") <= max_chunk)
    found = before.unionByName(leaves).unionByName(parent_sections(heads, sizes, key, max_chunk)).distinct()
    return trim_and_filter(found.join(texts, key), F.col("_text"), least, max_chunk).select(key, "first", "last").distinct()


# ---------------------------------------------------------------- chunkers of whole files


def windows(first: int, last: int, max_chunk: int = MAX_CHUNK, ratio: float = 0.15) -> Iterator[tuple[int, int]]:
    """slice_windows for one span."""
    step = window_step(max_chunk, ratio)
    count = 1 + max(0, -(-(last - first - max_chunk) // step)) if last > first else 0
    for i in range(count):
        yield first + i * step, min(first + i * step + max_chunk, last)


def _line_windows(text: str, first: int, last: int, max_chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows over text[first:last] that end after a newline where they hold one. They advance
    from their start, so one that ends early leaves a gap to the next."""
    step = max(200, max_chunk - overlap)
    for start in range(first, max(last, first + 1), step):
        end = min(last, start + max_chunk)
        if end < last:
            newline = text.rfind("\n", start, end)
            end = newline + 1 if newline > start else end
        if end > start:
            yield start, end
        if end >= last:
            return


def block_spans(text: str, first: int, last: int, max_chunk: int = MAX_CHUNK, overlap: int = BLOCK_OVERLAP) -> list[tuple[int, int]]:
    """Paragraphs of text[first:last] packed into spans of at most ``max_chunk``. A span begins
    with those paragraphs before it that lie within ``overlap`` of the last span's end; an
    oversized paragraph, or a text without blank lines, is cut into line windows."""
    gaps = [m.span() for m in re.compile(GAP).finditer(text, first, last)]
    if not gaps:
        return list(_line_windows(text, first, last, max_chunk, overlap))
    bounds = zip([first, *(end for _, end in gaps)], [*(start for start, _ in gaps), last])
    blocks = [x for x in bounds if x[0] < x[1]]
    starts, ends = [a for a, _ in blocks], [b for _, b in blocks]
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(starts):
        reach = bisect_right(ends, starts[at] + max_chunk)  # the first block that does not fit
        if reach <= at:
            out += _line_windows(text, starts[at], ends[at], max_chunk, overlap)
            at += 1
            continue
        out.append((starts[at], ends[reach - 1]))
        if reach == len(starts):
            break
        at = max(at + 1, min(reach, bisect_right(starts, ends[reach - 1] - overlap)))
    return out


GAP = r"\n\s*\n"


def block_files(files: DataFrame, max_chunk: int = MAX_CHUNK, overlap: int = BLOCK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """key, blocks, longest, first, last: the spans that block_spans packs each whole text into,
    and of its paragraphs the number and the greatest length. Null texts give no rows."""
    kind = files.schema[key].dataType.simpleString()
    rows = files.where(F.col("text").isNotNull()).select(key, normal_newlines("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, out = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                sizes = [len(x) for x in re.split(GAP, text) if x]
                for span in block_spans(text, 0, len(text), max_chunk, overlap):
                    take.append(i)
                    out.append((len(sizes), max(sizes, default=0), *span))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(take, pa.int32())), *columns], [key, "blocks", "longest", "first", "last"])

    return rows.mapInArrow(run, f"{key} {kind}, blocks long, longest long, first long, last long")


def markdown_spans(text: str, max_chunk: int = MAX_CHUNK) -> list[tuple[int, int]]:
    """Spans of a Markdown or plain text: its sections, the sections with their subsections and
    admonitions, trimmed, of 40 to ``max_chunk`` characters, sorted and distinct. A text that
    yields none is cut into windows; a blank one has no spans."""
    if not text.strip():
        return []
    size = len(text)
    heads = []
    offset = 0
    for line in text.splitlines(keepends=True):
        if m := re.match(HEADER, line):
            heads.append((offset, len(m[1])))
        offset += len(line)
    raw: list[tuple[int, int]] = []
    if not heads:
        raw = block_spans(text, 0, size, max_chunk)
    else:
        starts = [h[0] for h in heads] + [size]
        if starts[0]:
            raw.append((0, starts[0]))
        for i, (start, level) in enumerate(heads):
            end = starts[i + 1]
            raw += [(start, end)] if end - start <= max_chunk else block_spans(text, start, end, max_chunk)
            whole = next((o for o, lv in heads[i + 1 :] if lv <= level), size)
            if whole - start <= max_chunk:
                raw.append((start, whole))
        raw += [m.span() for m in re.finditer(r"^\s*(?:!{3}|\?{3})\s+.*?(?=\n\n|\Z)", text, re.S | re.M)]
    kept = set()
    for a, b in raw:
        body = text[a:b].strip(" \t\r\n")
        if LEAST_SECTION <= len(body) <= max_chunk:
            head = a + len(text[a:b]) - len(text[a:b].lstrip(" \t\r\n"))
            kept.add((head, head + len(body)))
    return sorted(kept) or list(windows(0, size, max_chunk))


def _line_offsets(text: str) -> list[int]:
    """Start of each line as Python's parser counts lines."""
    return [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]


def _span(node: ast.AST, starts: list[int], rows: list[str], byte_columns: bool) -> tuple[int, int]:
    """Character span of a node. Columns of the parser are UTF-8 bytes; they are turned into
    characters unless ``byte_columns`` asks for the uncorrected ones."""

    def position(line: int, column: int) -> int:
        row = rows[line - 1]
        return starts[line - 1] + (column if byte_columns or row.isascii() else len(row.encode()[:column].decode(errors="ignore")))

    return position(node.lineno, node.col_offset), position(node.end_lineno, node.end_col_offset)


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_spans(text: str, max_chunk: int = MAX_CHUNK, byte_columns: bool = False) -> list[tuple[int, int]]:
    """Spans of a Python file in statement order, distinct: functions, classes, and the runs of
    other statements between them, cut into windows where they exceed ``max_chunk``. A large
    class gives its first 1,000 characters, its methods and its other members of over 100. A
    file that does not parse is taken as Markdown."""
    if not text.strip():
        return []
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return markdown_spans(text, max_chunk)
    starts = _line_offsets(text)
    rows = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    place = lambda node: _span(node, starts, rows, byte_columns)
    found: list[tuple[int, int]] = []

    def kind(node: ast.AST) -> str:
        return "def" if isinstance(node, _DEFS) else "class" if isinstance(node, ast.ClassDef) else "other"

    for what, run in groupby(body, kind):
        nodes = list(run)
        if what == "other":
            found += windows(place(nodes[0])[0], place(nodes[-1])[1], max_chunk)
            continue
        for node in nodes:
            a, b = place(node)
            if what == "def" or b - a <= max_chunk:
                found += windows(a, b, max_chunk)
                continue
            found.append((a, min(b, a + min(max_chunk, 1000))))
            for member in node.body:
                c, d = place(member)
                if isinstance(member, _DEFS) or d - c > 100:
                    found += windows(c, d, max_chunk)
    size = len(text)
    clipped = ((max(0, min(a, size)), max(0, min(b, size))) for a, b in found)
    return list(dict.fromkeys(s for s in clipped if s[0] < s[1])) or list(windows(0, size, max_chunk))


def file_spans(path: str, text: str, max_chunk: int = MAX_CHUNK, byte_columns: bool = False) -> list[tuple[int, int]]:
    return python_spans(text, max_chunk, byte_columns) if path.endswith(".py") else markdown_spans(text, max_chunk)


INDEXED = r"\.(py|md|txt)$"  # CMakeLists.txt ends in .txt


def chunk_files(files: DataFrame, max_chunk: int = MAX_CHUNK, byte_columns: bool = False, key: str = "doc_id") -> DataFrame:
    """key, file_path, chunk_no from 0, first_character_index, last_character_index: the chunks
    of every indexed file, by suffix (case-sensitive). Each file is chunked whole in its Arrow
    batch, without a shuffle. Null paths and null or blank texts give no chunks."""
    kind = files.schema[key].dataType.simpleString()
    rows = files.where(F.col("file_path").rlike(INDEXED) & F.col("text").isNotNull()).select(key, "file_path", normal_newlines("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, numbers, first, last = [], [], [], []
            for i, (path, text) in enumerate(zip(b.column("file_path").to_pylist(), b.column("text").to_pylist())):
                for no, (a, z) in enumerate(file_spans(path, text, max_chunk, byte_columns)):
                    take.append(i), numbers.append(no), first.append(a), last.append(z)
            at = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(at), b.column("file_path").take(at), pa.array(numbers, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                [key, "file_path", "chunk_no", "first_character_index", "last_character_index"],
            )

    return rows.mapInArrow(run, f"{key} {kind}, file_path string, chunk_no int, first_character_index long, last_character_index long")
