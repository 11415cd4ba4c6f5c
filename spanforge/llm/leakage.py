"""Evaluation passages that leak into a corpus, by a prefix-filtered set join.

Items and documents become sequences of words (letters and digits, case folded; everything
else separates). An item's shingles of five words are ordered by how rare they are in the
corpus, over all documents. Within a piece shingles start at most WORDS + GAP words apart, so a
document that holds ``c`` words of an item shares at least ``c / (WORDS + GAP)`` of its
shingles, and one of these is in the item's prefix, which is all but so many less one of the
rarest first: nothing is lost by looking at such pairs only. Length and positional bounds drop
those that cannot hold enough, and the rest are verified exactly: every alignment that shares
shingles is a window of the document of the item's size, in which the pieces are measured.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
SHARE = 0.5  # of an item's words that make a leak
SLACK = 0.05  # of the share, for words that differ
PIECE = 8  # words of a piece, at least
GAP = 2  # differing words that a piece goes on over
DRIVER_WORDS = 4_000_000  # of all items together; beyond, items are compared in parts

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class Hasher(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h
        return h

    def hashes(self, text: str) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of each n words in a row, at the position of the first."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
    return out


@dataclass
class Items:
    """Items of one part: word hashes, and a sorted table of their shingles."""

    ids: list[int]
    word: list[np.ndarray]
    keys: np.ndarray = field(default=None)  # sorted distinct shingle hashes
    start: np.ndarray = field(default=None)  # of each key's entries
    item: np.ndarray = field(default=None)  # item number, position of each entry
    pos: np.ndarray = field(default=None)

    def index(self) -> Items:
        s = [shingles(w) for w in self.word]
        key = np.concatenate([*s, np.zeros(0, np.uint64)])
        item = np.concatenate([*(np.full(len(x), i) for i, x in enumerate(s)), np.zeros(0, int)]).astype(np.int32)
        pos = np.concatenate([*(np.arange(len(x)) for x in s), np.zeros(0, int)]).astype(np.int32)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.start = np.append(first, len(key))
        self.item, self.pos = item[order], pos[order]
        return self

    def find(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document and key numbers of its shingles that some item has."""
        if not len(self.keys) or not len(sh):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.searchsorted(self.keys, sh)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == sh)
        return hit, at[hit]


def held(item: np.ndarray, doc: np.ndarray, ipos: np.ndarray, dpos: np.ndarray, enough: float = np.inf) -> int:
    """How many words of the item the document holds in order, in long pieces.

    ``ipos`` and ``dpos`` are positions of shingles that both have. Matches on one diagonal,
    the window that the item fills at this alignment, are joined over up to GAP differing
    words; a piece needs PIECE words, or the whole of a shorter item. Counted is the longest
    sequence of words in pieces that goes forward in both; the pieces may lie any distance
    apart. Counting stops at a piece that has ``enough``.
    """
    n = len(item)
    order = np.lexsort((dpos, dpos - ipos))
    ip, dp = ipos[order], dpos[order]
    diag = dp - ip
    new = np.flatnonzero(np.r_[True, (diag[1:] != diag[:-1]) | (dp[1:] - dp[:-1] > WORDS + GAP)])
    ends = np.append(new[1:], len(ip)) - 1
    first, last = ip[new], ip[ends] + WORDS
    long = last - first >= min(PIECE, n)
    first, last, shift = first[long], last[long], diag[new][long]
    if not len(first):
        return 0
    most = int((last - first).max())
    if len(first) == 1 or most >= enough:
        return most
    size = last - first
    i = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    d = i + np.repeat(shift, size)
    tails: list[int] = []
    for at in i[np.lexsort((-i, d))].tolist():  # the longest forward sequence
        k = bisect_left(tails, at)
        tails[k : k + 1] = [at]
    return len(tails)


def needed(words: int, share: float) -> int:
    """Shingles of an item of so many words that a leak shares, at least."""
    return max(1, int(np.ceil(share * words / (WORDS + GAP) - 1e-9)))


@dataclass
class Matcher:
    """The items of one part, ready to be looked up: the prefix table and each item's own
    sorted shingles."""

    items: Items
    frequency: np.ndarray  # documents of each key
    share: float = SHARE - SLACK

    def __post_init__(self) -> None:
        it = self.items
        self.own, prefix_key, prefix_item, whole = [], [], [], {}
        for i, w in enumerate(it.word):
            s = shingles(w)
            order = np.argsort(s, kind="stable")
            self.own.append((s[order], order))
            if len(w) < WORDS:
                whole.setdefault(len(w), []).append((shingles(w, len(w))[0], i))
                continue
            rare = s[np.lexsort((s, self.frequency[np.searchsorted(it.keys, s)]))]
            rare = np.unique(rare[: max(0, len(s) - needed(len(w), self.share) + 1)])
            prefix_key.append(rare)
            prefix_item.append(np.full(len(rare), i))
        key = np.concatenate([*prefix_key, np.zeros(0, np.uint64)])
        key = np.searchsorted(it.keys, key)
        order = np.argsort(key, kind="stable")
        self.entry = np.concatenate([*prefix_item, np.zeros(0, int)])[order]
        self.start = np.searchsorted(key[order], np.arange(len(it.keys) + 1))  # of each key's items that have it in their prefix
        self.whole = {n: (np.array([h for h, _ in x], np.uint64), np.array([i for _, i in x])) for n, x in whole.items()}

    def _short(self, doc: np.ndarray) -> list[int]:
        """Items of fewer than WORDS words that stand in the document as a whole."""
        return [int(i) for n, (h, items) in self.whole.items() for i in items[np.isin(h, shingles(doc, n))]]

    def leaked(self, doc: np.ndarray) -> list[int]:
        """Numbers of the items that a document of these word hashes holds."""
        out = self._short(doc)
        sh = shingles(doc)
        hit, keys = self.items.find(sh)
        if not len(hit):
            return out
        sh = sh[hit]
        candidates = np.unique(np.concatenate([self.entry[self.start[k] : self.start[k + 1]] for k in np.unique(keys)]))
        for i in candidates:
            word = self.items.word[i]
            enough = self.share * len(word)
            if len(doc) < enough:  # length bound
                continue
            own, order = self.own[i]
            low = np.searchsorted(own, sh, "left")
            many = np.searchsorted(own, sh, "right") - low
            some = np.flatnonzero(many)
            dpos, m = hit[some], many[some]
            entry = order[np.repeat(low[some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            shared = np.unique(entry)
            # positional bound: a shared shingle accounts for the words up to the next one, WORDS + GAP at most
            if np.minimum(np.diff(shared), WORDS + GAP).sum() + WORDS < enough:
                continue
            if held(word, doc, entry, np.repeat(dpos, m), enough) >= enough:
                out.append(int(i))
        return sorted(out)


def _text_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null")


def _frequencies(documents: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each item shingle, counted over all documents."""

    def run(batches):
        h, total = Hasher(), np.zeros(len(items.keys), np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total[np.unique(items.find(shingles(h.hashes(t)))[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["key", "n"])

    counted = _text_rows(documents).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.keys), np.int64)
    out[counted.column("key").to_numpy()] = counted.column("n").to_numpy()
    return out


def _leaks(documents: DataFrame, matcher: Matcher) -> DataFrame:
    ids = np.array(matcher.items.ids, np.int64)
    shared = documents.sparkSession.sparkContext.broadcast(matcher)  # within DRIVER_WORDS

    def run(batches):
        h = Hasher()
        for b in batches:
            docs, found = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                items = shared.value.leaked(h.hashes(t))
                docs += [i] * len(items)
                found += items
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids[found] if found else [], pa.int64())], ["doc_id", "item_id"])

    return _text_rows(documents).mapInArrow(run, "doc_id long, item_id long")


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, slack: float = SLACK, part_words: int = DRIVER_WORDS) -> DataFrame:
    """doc_id, item_id of each document that holds at least ``share`` of an item's words, in
    their order, in one piece or a few long ones; ``slack`` of it allows for words that differ.

    Whole texts of all documents are read twice: once for how many documents each item
    shingle is in, once for the join. Items are collected in parts of at most ``part_words``
    words, a bound on what is broadcast; with more items there are more parts, each a pass of
    its own. Null and blank items leak nowhere; an item of fewer than PIECE words leaks where
    all of it stands in one piece, since a few common words are in any text. Null texts hold
    nothing. Of rows with one item_id the first text in order counts; repeated documents
    count once. Empty tables give no rows.
    """
    spark = documents.sparkSession
    size = F.size(F.split("text", r"[^\p{L}\p{N}]+"))
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).head()["n"]
    parts = max(1, -(-int(total) // part_words))
    found = spark.createDataFrame([], "doc_id long, item_id long")
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").toArrow()
        h = Hasher()
        hashed = [(i, w) for i, t in zip(mine.column("item_id").to_pylist(), mine.column("text").to_pylist()) if len(w := h.hashes(t))]
        if not hashed:
            continue
        table = Items([i for i, _ in hashed], [w for _, w in hashed]).index()
        matcher = Matcher(table, _frequencies(documents, table), share - slack)
        found = found.unionByName(_leaks(documents, matcher))
    return found.distinct()
