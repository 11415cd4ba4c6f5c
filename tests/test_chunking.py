import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators import chunking as C


@pytest.mark.parametrize(
    "span,size,want",
    [
        ((0, 0), 2000, []),
        ((0, 2000), 2000, [(0, 2000)]),
        ((0, 2001), 2000, [(0, 2000), (1700, 2001)]),
        ((0, 4500), 2000, [(0, 2000), (1700, 3700), (3400, 4500)]),
        ((0, 120), 100, [(0, 100), (50, 120)]),
    ],
)
def test_windows(spark, span, size, want):
    assert list(C.windows(*span, size)) == want
    rows = C.slice_windows(spark.createDataFrame([span], "first long, last long"), max_chunk=size).orderBy("window_no").collect()
    assert [(r.first, r.last) for r in rows] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 50), st.integers(0, 9000), st.integers(60, 2500))
def test_windows_cover(first, length, size):
    out = list(C.windows(first, first + length, size))
    assert all(b - a <= size for a, b in out)
    assert {i for a, b in out for i in range(a, b)} == set(range(first, first + length))


PY = '''import os
X = 1
"é"; Y = 2


@deco
def f(a):
    return a
Z = 3


class Small:
    a = 1
'''


def text_of(text, spans):
    return [text[a:b] for a, b in spans]


def test_python_file():
    got = text_of(PY, C.python_spans(PY))
    assert got == ['import os\nX = 1\n"é"; Y = 2', "def f(a):\n    return a", "Z = 3", "class Small:\n    a = 1"]


def test_python_columns_are_characters():
    text = '"é"; Y = 2\n' * 1
    assert text_of(text, C.python_spans(text)) == ['"é"; Y = 2']
    assert C.python_spans(text, byte_columns=True) == [(0, 11)]


def test_large_class():
    body = "    def m(self):\n        " + "x = 1; " * 10 + "\n"
    text = "class Big:\n" + f"    small = {'1' * 86}\n" + f"    long = {'1' * 100}\n" + "    class In:\n" + "        y = 1\n" * 20 + body * 30
    got = C.python_spans(text)
    assert got[0] == (0, 1000)
    parts = text_of(text, got)
    assert "long = " + "1" * 100 in parts and not any(p.startswith("small") for p in parts)
    assert sum(p.startswith("def m") for p in parts) == 30 and any(p.startswith("class In") for p in parts)


@pytest.mark.parametrize("text", ["", "  \n\t", "\r\n"])
def test_blank_files_have_no_chunks(text):
    assert C.python_spans(text) == [] == C.markdown_spans(text)


def test_comments_only_and_broken_python():
    assert C.python_spans("# only\n") == [(0, 7)]
    broken = "# Title of it all, which is long enough to stay here\ndef f(:\n"
    assert C.python_spans(broken) == C.markdown_spans(broken) != []


def test_markdown_sections():
    p = "word " * 12
    text = f"intro {p}\n# A\n{p}\n## B\n{p}\n```\n# no\n{p}\n```\n# C\nshort\n"
    parts = text_of(text, C.markdown_spans(text))
    assert parts[0] == ("intro " + p).strip()
    assert any(x.startswith("# A") and "## B" in x for x in parts)  # parent
    assert any(x.startswith("# A") and "## B" not in x for x in parts)  # leaf
    assert any(x.startswith("# no") for x in parts)  # fences do not hide headers
    assert not any(x.startswith("# C") for x in parts)  # under 40 characters


@pytest.mark.parametrize("n,kept", [(39, False), (40, True)])
def test_least_section(n, kept):
    text = "# T\n" + "x" * (n - 4) + "\n# Other section that is long enough to be kept whole\n"
    assert (((0, n)) in C.markdown_spans(text)) == kept


def test_short_markdown_survives_as_window():
    assert C.markdown_spans("tiny") == [(0, 4)]


def test_oversized_preamble_is_dropped():
    text = "y" * 2100 + "\n# H\n" + "z" * 60
    assert all(a >= 2100 for a, _ in C.markdown_spans(text))


def test_blocks_overlap_and_bound():
    text = "\n\n".join("p%03d " % i + "w" * 180 for i in range(60))
    spans = C.block_spans(text, 0, len(text))
    assert all(b - a <= 2000 for a, b in spans)
    assert all(0 < e - s2 < 300 or s2 >= e for (_, e), (s2, _) in zip(spans, spans[1:]))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)


def test_admonition():
    text = "# Head of the page, long enough to be a section\n!!! note\n    " + "a" * 60 + "\n\nmore\n"
    assert any(text[a:b].startswith("!!! note") for a, b in C.markdown_spans(text))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a#\n =():def", max_size=400), st.integers(200, 400))
def test_any_text_gives_bounded_spans(text, size):
    for spans in (C.markdown_spans(text, size), C.python_spans(text, size)):
        assert all(0 <= a < b <= len(text) and b - a <= size for a, b in spans)
        assert len(set(spans)) == len(spans)
        assert bool(spans) == bool(text.strip())


def test_chunk_files(spark):
    rows = [(1, "a/__init__.py", "x = 1\r\ny = 2\r\n"), (2, "b.md", None), (3, None, "t"), (4, "c.json", "{}"), (5, "CMakeLists.txt", "add(x)"), (6, "d.PY", "x")]
    df = spark.createDataFrame(rows, "doc_id long, file_path string, text string")
    got = [(r.doc_id, r.first_character_index, r.last_character_index) for r in C.chunk_files(df).orderBy("doc_id").collect()]
    assert got == [(1, 0, 11), (5, 0, 6)]


def test_headers_native(spark):
    df = spark.createDataFrame([(1, "##\n# A\r\ntext\n#no\n### B c "), (2, None), (3, "#")], "doc_id long, text string")
    assert [(r.offset, r.level, r.title) for r in C.headers(df).orderBy("offset").collect()] == [(0, 2, ""), (3, 1, "A"), (16, 3, "B c")]


ODD = "a\x0b# One\x0c## Two\x1c#\xa0Three\x1d#　Four\x1e#\x1fFive\x85# Six # Seven # Eight\r\n# Nine\r# Ten\n#\x0b#x\n# Last  "


@pytest.mark.parametrize("text", [ODD, ODD + "\n", "\x0c", "", "\r\n\x85", "##\n\n# a#\xa0", "#​no"])
def test_lines_and_headers_end_as_python_ends_them(spark, text):
    import re

    normal = text.replace("\r\n", "\n").replace("\r", "\n")
    files = spark.createDataFrame([(1, text)], "doc_id long, text string")
    offset, want, starts = 0, [], []
    for line in normal.splitlines(keepends=True):
        starts.append(offset)
        if m := re.match(r"^(#{1,6})\s+(.*)$", line):
            want.append((offset, len(m[1]), m[2].strip()))
        offset += len(line)
    got = [(r.offset, r.level, r.title) for r in C.headers(files).orderBy("offset").collect()]
    assert got == want
    assert [r.line_start for r in C.lines(files).orderBy("line_no").collect()][: len(starts)] == starts


def test_blank_paragraphs_have_no_blocks(spark):
    assert C.block_spans("\n \n", 0, 3) == [] == C.block_spans("a\n\n\nb", 1, 4)
    rows = spark.createDataFrame([(1, "\n\n"), (2, None), (3, ""), (4, "a\n\nb")], "doc_id long, text string")
    assert [tuple(r) for r in C.block_files(rows).collect()] == [(4, 2, 1, 0, 4)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", min_size=1, max_size=160), st.integers(8, 60), st.integers(1, 20))
def test_blocks_follow_the_rule(text, size, overlap):
    """Each span takes all blocks in reach; the next begins at the first block that starts less
    than ``overlap`` before its end."""
    import re

    gaps = [m.span() for m in re.finditer(r"\n\s*\n", text)]
    blocks = [(a, b) for a, b in zip([0, *(e for _, e in gaps)], [*(s for s, _ in gaps), len(text)]) if a < b]
    spans = C.block_spans(text, 0, len(text), size, overlap)
    if not gaps or any(b - a > size for a, b in blocks):
        return
    assert C.block_spans("xx" + text + "yy", 2, 2 + len(text), size, overlap) == [(a + 2, b + 2) for a, b in spans]
    assert {a for a, _ in spans} <= {a for a, _ in blocks} and all(b - a <= size for a, b in spans)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        later = [x for x, _ in blocks if x > a]
        inside = [x for x in later if x > b - overlap and x < b]
        assert c == (inside[0] if inside else next(x for x in later if x >= b))
    for a, b in spans:
        assert b == max(e for s, e in blocks if s >= a and e - a <= size)
    assert not blocks or spans[-1][1] == blocks[-1][1]
