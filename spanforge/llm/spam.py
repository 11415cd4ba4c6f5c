"""Pages of repeated keywords, link lists or product tags instead of sentences.

Bagged decision trees over content and link features, trained here from weak labels on a
bounded sample; page scores are then smoothed with the spam rate of the page's host, the
repository it is from.

What is classified are blocks of lines, since a page is spam if most of its text is. Several
weak rules, each of which abstains where it is not sure, vote on a block by one set of
measures; only blocks on which they do not contradict each other are labelled. The trees see
another set of measures, of which only the share of function words is also used by rules, so
they learn what labelled blocks have in common and decide on all blocks, those without a label
too. A page's score is the mean of its
blocks' scores by their length, with code and figures as no spam.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # weakly labelled blocks the trees are fitted on, at most
TREES, DEPTH, LEAF = 31, 8, 10
SMOOTHING = 0.1  # weight of the host's rate
THRESHOLD = 0.5

#: fixed values: common function words of some languages; they make sentences
FUNCTION_WORDS = frozenset(
    """a an the and or but if then than that this these those is are was were be been being has have had do does did not no nor of in on at by for with from to into
    over under after before while when where which who what why how as so because since until each every any some all its it they we you he she there here can could
    may might should would will one another nothing never always only also more most less
    der die das den dem des ein eine einer und oder nicht ist sind wird werden von mit zu im für auf wenn dass sich noch vor
    le la les un une des du de et ou ne pas est sont que qui dans pour avec sur au aux se rendu avant fois
    el los las una unos y o no es son que en por para con del al se su cuando""".split()
)
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_LINK = re.compile(r"(?i)\[[^\]\n]*\]\([^)\s]*\)|<?(?:https?://|www\.)[^\s)>\]]+>?|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/[^\s)>\]]*|<a\s[^>]*>.*?</a>")
_ADDRESS = re.compile(r"\w\.\w[\w.-]*/\S|://|\]\(")
_HEADING = re.compile(r"#{1,6}[ \t]+\S.{0,118}$")
_WIDE = r"぀-ヿ㐀-鿿가-힯"
_HAS_WIDE = re.compile(f"[{_WIDE}]")
_SEPARATOR = re.compile(r"[,;|/·•>»、]|::|--|#(?=\w)")
_UNIT = re.compile(r"[^\W_]+|[.!?](?=\s|$)|[。！？]")
_WIDE_UNIT = re.compile(rf"[{_WIDE}]|[^\W_{_WIDE}]+|[.!?](?=\s|$)|[。！？]")
_MARKS = frozenset(".!?。！？")
_MARK = re.compile(r"""[,;|·•>»<#*_\-()\[\]{}=+~^&%$@"'、：（）「」]""")

#: what the rules vote by
EVIDENCE = ["links", "function", "varied", "sentences", "separators", "words", "cells", "same_cells", "figures"]
#: what the trees see
NAMES = ["distinct", "top", "triples", "word_length", "address", "addressed", "marks", "ends", "upper", "short", "function", "log_words", "lines", "digits", "packed"]


def _words(text: str) -> tuple[list[str], float, float]:
    """Words of a text in lower case, their share in sentences and that of function words. In
    Chinese, Japanese and Korean script each character counts as a word, none as a function word
    or all, so that repetition and marks decide."""
    wide = not text.isascii() and _HAS_WIDE.search(text) is not None
    words: list[str] = []
    inside = function = size = mine = 0
    for u in [*(_WIDE_UNIT if wide else _UNIT).findall(text), "."]:
        if u in _MARKS:
            if size >= 3 and mine >= max(1, 0.1 * size):
                inside += size
            function += mine
            size = mine = 0
        elif not u.isdigit():
            words.append(u)
            size += 1
            mine += u in FUNCTION_WORDS or (wide and u > "　")
    return words, inside / max(1, len(words)), function / max(1, len(words))


def evidence(block: str, cells: list[str] | None = None) -> list[float]:
    """Measures of a block that the rules vote by; ``cells`` are those of a table."""
    found = _LINK.findall(block) if "/" in block or "](" in block or "<a" in block else []
    rest = (_LINK.sub(" ", block) if found else block).lower()
    words, inside, function = _words(rest)
    n = len(words)
    varied = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    cells = cells or []
    figures = sum(c[-1].isdigit() and c[0].isdigit() for c in cells) / max(1, len(cells))
    return [
        sum(map(len, found)) / max(1, len(block.strip())), function, varied, inside, len(_SEPARATOR.findall(rest)) / max(1, n), float(n),
        float(len(cells)), 1 - len(set(cells)) / len(cells) if cells else 0.0, figures,
    ]


def features(block: str) -> list[float]:
    """Measures of a block that the trees see."""
    lower = block.lower()
    wide = not block.isascii() and _HAS_WIDE.search(block) is not None
    words = [u for u in (_WIDE_UNIT if wide else _UNIT).findall(lower) if u not in _MARKS]
    n, size = max(1, len(words)), max(1, len(block))
    count = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    letters = sum(map(len, words))
    lines = block.splitlines() or [""]
    return [
        len(count) / n,
        sum(c for _, c in count.most_common(5)) / n,
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        letters / n,
        (block.count("/") + block.count("://") + len(re.findall(r"\w\.\w", block))) / n,
        sum(_ADDRESS.search(x) is not None for x in lines) / len(lines),
        len(_MARK.findall(block)) / n,
        len(re.findall(r"[.!?](?=\s|$)|[。！？]", block)) / n,
        sum(map(str.isupper, block)) / size,
        sum(len(w) <= 3 for w in words) / n,
        0.3 if wide else sum(w in FUNCTION_WORDS for w in words) / n,
        float(np.log1p(len(words))),
        len(lines) / n,
        sum(map(str.isdigit, block)) / size,
        len(zlib.compress(block.encode("utf-8", "surrogatepass"), 1)) / (size + 20),
    ]


def blocks(text: str) -> tuple[list[tuple[str, list[str] | None]], int]:
    """Blocks of a page, tables with their cells, and the number of characters set apart as
    code. Lines that stand together are a block, split at blank lines; headings are left out."""
    code = sum(len(m[0]) for m in _FENCE.finditer(text))
    kept, tables, open_ = [], [], False
    for line in _FENCE.sub("\n\n", text).splitlines():
        s = line.strip()
        row = s.startswith("|") and s.endswith("|") and s.count("|") >= 3
        if row and not open_:
            tables.append([])
        if row:
            tables[-1].append(s)
        open_ = row
        kept.append("" if row or _HEADING.match(s) else line)
    out: list[tuple[str, list[str] | None]] = [(b.strip(), None) for b in re.split(r"\n\s*\n", "\n".join(kept)) if b.strip()]
    out += [("\n".join(t), [c.strip().lower() for r in t for c in r.split("|") if c.strip(" -:")]) for t in tables]
    return out, code


#: each rule: a vote, and the conditions on the evidence under which it does not abstain
RULES = [
    (1, lambda e: e["links"] > 0.6),
    (1, lambda e: (e["words"] >= 20) & (e["varied"] < 0.45)),
    (1, lambda e: (e["words"] >= 12) & (e["cells"] == 0) & (e["separators"] > 0.2) & (e["function"] < 0.05) & (e["sentences"] < 0.2)),
    (1, lambda e: (e["cells"] >= 12) & (e["figures"] < 0.1) & (e["same_cells"] > 0.4)),
    (0, lambda e: (e["sentences"] > 0.7) & (e["function"] > 0.1) & (e["varied"] > 0.7) & (e["links"] < 0.3)),
    (0, lambda e: (e["links"] < 0.05) & (e["separators"] < 0.1) & (e["varied"] > 0.85) & (e["cells"] == 0)),
    (0, lambda e: (e["figures"] > 0.25) | ((e["cells"] > 0) & (e["same_cells"] < 0.2))),
    (0, lambda e: (e["words"] < 8) & (e["links"] < 0.3)),
    (0, lambda e: (e["function"] > 0.2) & (e["varied"] > 0.5) & (e["links"] < 0.3)),
]


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 or 0 where the rules that do not abstain agree, -1 where they contradict each other or
    all abstain."""
    e = {n: x[:, i] for i, n in enumerate(EVIDENCE)}
    votes = np.zeros((2, len(x)), int)
    for vote, holds in RULES:
        votes[vote] += holds(e)
    return np.where((votes[1] > 0) & (votes[0] == 0), 1, np.where((votes[0] > 0) & (votes[1] == 0), 0, -1))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), cut, left, right, spam share of the leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                down = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
                at = np.where(inner, down, at)
            out += value[at]
        return out / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> tuple[np.ndarray, ...]:
    """One tree by the Gini impurity, with a random choice of features at each node."""
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        share = float(y[rows].mean()) if len(rows) else 0.0
        for column, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (value, share)):
            column.append(v)
        if level == 0 or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return at
        best = None
        for f in rng.permutation(x.shape[1])[: max(2, int(np.ceil(x.shape[1] / 2)))]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            i = np.arange(leaf, len(rows) - leaf + 1)
            i = i[v[i - 1] < v[np.minimum(i, len(v) - 1)]]
            if not len(i):
                continue
            a, n = ones[i - 1], len(rows)
            b = ones[-1] - a
            impurity = a * (i - a) / i + b * (n - i - b) / (n - i)
            j = int(np.argmin(impurity))
            if best is None or impurity[j] < best[0]:
                best = (float(impurity[j]), f, float((v[i[j] - 1] + v[i[j]]) / 2))
        if best is None:
            return at
        _, f, c = best
        feature[at], cut[at] = int(f), c
        low = x[rows, f] <= c
        left[at] = node(rows[low], level - 1)
        right[at] = node(rows[~low], level - 1)
        return at

    node(np.arange(len(y)), depth)
    return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 7) -> Forest:
    """Bagging: each tree sees a bootstrap draw of as many rows, both classes drawn alike."""
    rng = np.random.default_rng(seed)
    groups = [g for g in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(g)]
    out = []
    for _ in range(trees if groups else 0):
        rows = np.concatenate([rng.choice(g, len(g)) for g in groups])
        out.append(_grow(x[rows], y[rows], rng, depth, min(leaf, max(1, len(rows) // 4))))
    return Forest(out)


def pages(documents: DataFrame) -> DataFrame:
    """The .md and .txt rows, but for requirements and CMakeLists files, with a text that is
    neither null nor blank."""
    path = F.lower("file_path")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    other = name.rlike(r"^requirements.*\.txt$") | (name == "cmakelists.txt")
    return documents.where((path.endswith(".md") | path.endswith(".txt")) & ~other & F.col("text").rlike(r"(?U)\S"))


def page_blocks(documents: DataFrame) -> DataFrame:
    """doc_id, host, size (characters of the page that count), weights, labels and features of
    its blocks, as arrays."""
    host = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), "_", "-"), F.lit(""))
    rows = pages(documents).select("doc_id", host.alias("host"), "text")

    def run(batches):
        for b in batches:
            parts = [blocks(t) for t in b.column("text").to_pylist()]
            every = [x for found, _ in parts for x in found]
            e = np.array([evidence(*x) for x in every], float).reshape(-1, len(EVIDENCE))
            f = np.array([features(t) for t, _ in every], float).reshape(-1, len(NAMES))
            weight = [len(t) for t, _ in every]
            ends = np.cumsum([0, *(len(found) for found, _ in parts)])
            size = [sum(len(t) for t, _ in found) + code for found, code in parts]
            array = lambda v, by=1: pa.ListArray.from_arrays(pa.array(ends * by, pa.int32()), v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), pa.array(size, pa.int64()), array(pa.array(weight, pa.int32())), array(pa.array(weak_labels(e), pa.int32())), array(pa.array(f.ravel(), pa.float32()), len(NAMES))],
                ["doc_id", "host", "size", "weights", "labels", "f"],
            )

    return rows.mapInArrow(run, "doc_id long, host string, size long, weights array<int>, labels array<int>, f array<float>")


def _sample(rows: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled blocks, of either label up to half of
    it, drawn by a hash of page and block."""
    width = F.lit(len(NAMES))
    one = rows.select("doc_id", "f", F.posexplode("labels").alias("no", "label")).where("label >= 0")
    one = one.select("doc_id", "no", "label", F.slice("f", F.col("no") * width + 1, width).alias("f"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = sample // 2
    draw = F.pmod(F.xxhash64("doc_id", "no", F.lit(5)), F.lit(1_000_000))
    part = None
    for label in (0, 1):
        share = int(min(1.0, half / max(1, counts.get(label, 0))) * 1_000_000)
        own = one.where((F.col("label") == label) & (draw < share)).limit(half + half // 10)
        part = own if part is None else part.unionByName(own)
    fitted = part.toPandas().sort_values(["doc_id", "no"])
    return np.array(fitted["f"].tolist(), float).reshape(-1, len(NAMES)), fitted["label"].to_numpy()


def score_pages(documents: DataFrame, sample: int = SAMPLE, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, host, page_score, rule_score, host_rate, score of every page.

    The trees are fitted on at most ``sample`` weakly labelled blocks. Features, scores and host
    rates cover all pages. ``page_score`` is the share of the page's characters in spam, each
    block counting by the trees' score; ``rule_score`` is that of the weak labels alone, with
    half of what they leave open. A host's rate is the mean page score of its pages, and the
    score is the page's own, moved by ``smoothing`` of what the host's rate is above or below
    that of all pages. Null sources are one host; spellings that differ in case, blanks or
    underscores are one. Null and blank texts are no pages. With no pages there are no rows; if
    the rules label one class only, every block gets that class's score.
    """
    from spanforge.runtime import cut

    rows = cut(page_blocks(documents), "page-blocks")
    forest = train(*_sample(rows, sample))

    def run(batches):
        for b in batches:
            f = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            weight, label = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("weights", "labels"))
            page = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column("labels")).to_numpy(zero_copy_only=False))
            size = np.maximum(1, b.column("size").to_numpy())
            mean = lambda s: np.bincount(page, s * weight, b.num_rows) / size
            scores = [pa.array(mean(s)) for s in (forest.score(f), np.where(label < 0, 0.5, label))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *scores], ["doc_id", "host", "page_score", "rule_score"])

    scored = rows.mapInArrow(run, "doc_id long, host string, page_score double, rule_score double")
    scored = cut(scored, "page-scores")
    rates = scored.groupBy("host").agg(F.avg("page_score").alias("host_rate"))
    overall = scored.agg(F.avg("page_score").alias("_all"))
    moved = F.col("page_score") + smoothing * (F.col("host_rate") - F.col("_all"))
    return scored.join(rates, "host").crossJoin(F.broadcast(overall)).withColumn("score", moved).drop("_all")


def find_spam(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id of the pages whose smoothed score reaches the threshold."""
    return score_pages(documents).where(F.col("score") >= threshold).select("doc_id")
