"""Splitting oversized texts at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2_000
OVERLAP = 300

#: kinds of boundaries, strongest first; a cut falls at the end of the match
BOUNDARIES = [
    re.compile(r"\n(?=#{1,6}[ \t]|(?:async[ \t]+def|def|class)[ \t]|@\w)"),
    re.compile(r"\n[ \t]*\n(?:[ \t]*\n)*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"')\]]*\s+|[。！？]+"),
    re.compile(r"[,;:]\s+|[、，；：]"),
    re.compile(r"\s+"),
]


def _nearest(text: str, low: int, high: int, want: int, boundary: re.Pattern) -> int | None:
    """The boundary end in (low, high) nearest to ``want``; of two the earlier."""
    best = None
    for m in boundary.finditer(text, low, high):
        at = m.end()
        if low < at < high:
            if best is None or abs(at - want) < abs(best - want):
                best = at
            elif at > want:
                break
    return best


def _anywhere(text: str, low: int, high: int, want: int) -> int:
    """``want``, moved back where it would part a base character from its marks or joiners."""
    at = want
    while at > low + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at if at > low + 1 else want


def _cut(text: str, low: int, high: int) -> int:
    """Where to halve text[low:high]: the strongest boundary in its middle half."""
    quarter, middle = (high - low) // 4, (low + high) // 2
    for boundary in BOUNDARIES:
        at = _nearest(text, low + quarter, high - quarter, middle, boundary)
        if at is not None:
            return at
    return _anywhere(text, low, high, middle)


def _overlap_start(text: str, low: int, cut: int, overlap: int) -> int:
    """Where the overlap before ``cut`` begins: the first of the strongest boundaries that
    leave it at least half of its allowed length."""
    reach = max(low, cut - overlap)
    if reach >= cut:
        return cut
    latest = cut - (cut - reach) // 2
    for boundary in BOUNDARIES:
        for m in boundary.finditer(text, max(low, reach - 1), latest):
            if reach <= m.end() < latest:
                return m.end()
    return min(cut, _anywhere(text, low, cut, reach)) if reach > low else reach


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """First, core first and last position of each piece of a text without CRLF.

    The cores (core first, last) tile the text; ``first`` reaches back into the piece before by
    at most ``overlap``. No piece is longer than ``limit``. An empty text gives one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    core = max(1, limit - overlap)
    cuts, todo = [], [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low <= core:
            cuts.append((low, high))
            continue
        at = _cut(text, low, high)
        todo += [(at, high), (low, at)]
    out = []
    for low, high in cuts:
        start = low if low == 0 else _overlap_start(text, max(0, out[-1][1]), low, overlap)
        start = max(start, high - limit)
        out.append((start, low, high))
    return out


PIECES = "doc_id long, piece_no int, first long, core_first long, last long, piece string"


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: doc_id, piece_no from 1, first, core_first, last, piece.

    Lengths and positions count characters with CRLF as one; the piece itself keeps its CRLFs,
    so the cores of a document joined in order give back its text. A text within the limit is
    one piece, an empty text one empty piece; a null text gives no row. Only longer texts leave
    the JVM, whole. Other columns are left behind. No shuffle.
    """
    size = F.length(F.regexp_replace("text", "\r\n", "\n"))
    rows = documents.select("doc_id", "text", size.alias("size")).where(F.col("text").isNotNull())
    zero = F.lit(0).cast("long")
    whole = rows.where(F.col("size") <= limit).select("doc_id", F.lit(1).alias("piece_no"), zero.alias("first"), zero.alias("core_first"), F.col("size").cast("long").alias("last"), F.col("text").alias("piece"))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                flat = text.replace("\r\n", "\n")
                breaks = []
                if len(flat) != len(text):
                    breaks = [m.start() - k for k, m in enumerate(re.finditer("\r\n", text))]
                for no, (first, core, last) in enumerate(spans(flat, limit, overlap), 1):
                    piece = text[first + bisect_left(breaks, first) : last + bisect_left(breaks, last)] if breaks else flat[first:last]
                    out.append((i, no, first, core, last, piece))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece_no", "first", "core_first", "last", "piece"])

    return whole.unionByName(rows.where(F.col("size") > limit).select("doc_id", "text").mapInArrow(run, PIECES))
