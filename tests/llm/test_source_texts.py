import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import docpairs as D
from spanforge.llm import pieces as P
from spanforge.llm import syntax as S
from spanforge.llm.grammar import judge

DOCS = "doc_id long, file_path string, text string, source string, lang string, language string, cause string"


def documents(spark, rows):
    return spark.createDataFrame([(i, p, t, s, None, "l", "c") for i, p, t, s in rows], DOCS)


SOURCE = '''
"""def not_me(): 'no'"""
x = [
1, "def nor_me():",
]
class A[T]:
    def one(self, a: dict[str, int] = {"k": 1}, *args, **kw) -> "B":
        # first a comment

        r"""Opens \\d gates."""
    @deco(
        1)
    async def two(self): "Waits for the sun."; return 1
    class In:
        def deep(self):
            ("Joined "
             'up text.')
class Tabs:
\tdef tabbed(self):
\t\t"Tabbed text."
\t\tpass
if x:
    def three(): return 1
    def four():
        f"""Not a {x} docstring."""
    def five():
        b"""Nor this."""
    def six():
        "Nor this." .strip()
    def seven():
        "a", "b"
    def eight(): \\
        "Goes on after a break."
def nine(q=lambda: 1): ("Only " "this.")
'''


def by_ast(text):
    out = []

    def walk(node, path):
        for n in ast.iter_child_nodes(node):
            named = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            if named and not isinstance(n, ast.ClassDef) and (d := ast.get_docstring(n, clean=False)) is not None:
                out.append((n.lineno, ".".join([*path, n.name]), d))
            walk(n, [*path, n.name] if named else path)

    walk(ast.parse(text), [])
    return sorted(out)


@pytest.mark.parametrize("text", [SOURCE, SOURCE.replace("\n", "\r\n"), SOURCE.replace("\\\r\n", "\\\n")])
def test_islands_agree_with_the_parser(text):
    flat = lambda rows: [(a, b, d.replace("\r\n", "\n")) for a, b, d in rows]
    assert flat((f.line, f.name, f.doc) for f in D.python_functions(text)) == flat(by_ast(text))


@pytest.mark.parametrize(
    "doc,name,params,want",
    [
        ("", "f", [], False), ("  \n", "f", [], False), ("-----", "f", [], False), ("???", "f", [], False),
        ("TODO", "f", [], False), ("todo: write this", "f", [], False), ("TBD.", "f", [], False), ("N/A", "f", [], False), ("None.", "f", [], False),
        ("Placeholder docstring, to be replaced.", "f", [], False), ("[Write one sentence that says what this does.]".replace("Write", "Describe"), "f", [], False),
        ("<short summary>\n\n<longer text, to be filled in later>", "f", [], False),
        ("_summary_\n\nArgs:\n    x (int): _description_\n\nReturns:\n    _type_: _description_", "f", ["x"], False),
        ("[Write one sentence that says what this does.]", "f", [], False), ("_summary_\n\nArgs:\n    x (int): _description_\n\nReturns:\n    _type_: _description_", "f", [], False),
        ("_summary_", "f", [], False), ("<what>: [why]", "f", [], False), ("[internal] Opens gates.", "f", [], True), ("_summary_\n\nArgs:\n    x (int): how far", "f", ["x"], True),
        ("Guards the pool.", "guard_pool", [], False), ("GuardPool", "guard_pool", [], False), ("Copies entries", "copy_entry", [], False), ("guard_pool()", "A.guard_pool", ["self"], False),
        ("Maps lane.\n\n:param a: the a\n:param b:\n:return:", "map_lane", ["a", "b"], False),
        ("Not thread safe!", "f", [], True), ("Guards the deep pool.", "guard_pool", [], True), ("遅延なしで返す。", "f", [], True), ("Returns -1 when lazy.", "f", [], True),
        ("Maps lane.\n\n:param a: how far", "map_lane", ["a"], True), ("Needs 2 GB free", "f", [], True),
    ],
)
def test_says_something(doc, name, params, want):
    assert D.says_something(doc, name, params) == want


def test_pairs_and_edges(spark):
    good = 'def f(a):\n    """Adds it up."""\n    return a\n\n\ny = 1\n'
    rows = [(1, "a.py", good, "s"), (2, "b.py", good + "def (", "s"), (3, "c.py", None, "s"), (4, None, good, "s"), (5, "d.md", good, None), (6, "e.py", "", "s"), (1, "a.py", good, "s")]
    rows.append((7, "f.java", "/** Sums it. @param a x */\n@Override public int sum(int a) { if (a) { return 1; } return a; }\nint no(int b) { return b; }", "s"))
    got = D.pair_functions(documents(spark, rows)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.def_line, r.qual_name) for r in got] == [(1, 1, "f"), (1, 1, "f"), (7, 2, "sum")]
    assert got[0].code.endswith("return a") and got[0].documentation == "Adds it up."
    assert got[2].code.endswith("return a; }")
    assert D.pair_functions(documents(spark, rows).limit(0)).count() == 0


def test_verdicts(spark):
    rows = [
        (1, "a.py", "x = 1\n", "S_a"), (2, "b.py", "def f(:\n", "s-A"), (3, "c.json", '{"a": NaN}', None), (4, "d.toml", 'a = 1\n[b]\nc = "d"\n', "s"), (5, "e.json", 'a = 1\n[b]\nc = "d"\n', "s"),
        (6, "f.py", "<<<<<<< HEAD\nx = 1\n=======\n", "s"), (7, "g.py", None, "s"), (8, "h.py", " \n", "s"), (9, None, "x", "s"), (10, "i.md", "x", "s"), (11, "j.py", "x\0", "s"), (12, "k.JSON", "[]", "s"),
    ]
    got = {r.doc_id: r for r in S.verdicts(documents(spark, rows)).collect()}
    assert sorted(i for i, r in got.items() if not r.parses) == [2, 3, 5, 6, 11] and sorted(got) == [1, 2, 3, 4, 5, 6, 11, 12]
    assert got[5].cause == "wrong extension: toml" and got[6].cause == "conflict markers" and got[2].cause == "corrupt"
    rates = {(r.source, r.language): (r.files, r.failed, r.rate) for r in S.rates(S.verdicts(documents(spark, rows))).collect()}
    assert rates["s-a", "python"] == (2, 1, 0.5) and rates[None, "json"] == (1, 1, 1.0)
    assert S.verdicts(documents(spark, rows).limit(0)).count() == 0


def test_language_ranking():
    assert judge('{"a": [1, null]}', "json")[1][0] == "json"
    assert judge("def f(a):\n    return a\n", "python")[1][0] == "python"
    assert judge('[a]\nb = "c"\n', "toml")[1][0] == "toml"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n,é漢。\u0301", max_size=600), st.integers(20, 120), st.integers(0, 15))
def test_pieces_tile_and_bound(text, limit, overlap):
    out = P.spans(text, limit, overlap)
    assert "".join(text[c:z] for _, c, z in out) == text
    assert all(z - a <= limit and 0 <= c - a <= overlap for a, c, z in out)
    assert (len(out) > 1) == (len(text) > limit)


def test_pieces_cut_at_paragraphs():
    text = "\n\n".join("Sentence number %d ends here. " % i * 8 for i in range(40))
    assert all(text[:z].endswith("\n\n") for _, _, z in P.spans(text)[:-1])


def test_split_documents(spark):
    long = "word one two. " * 200
    rows = [(1, "a", "x" * 2000, "s"), (2, "b", "x" * 2001, "s"), (3, "c", ("y" * 99 + "\r\n") * 20, "s"), (4, "d", None, "s"), (5, "e", "", "s"), (6, "f", long.replace("two. ", "two.\r\n"), "s")]
    got = P.split_documents(documents(spark, rows)).orderBy("doc_id", "piece_no").collect()
    count = {i: [r.piece_no for r in got if r.doc_id == i] for i in range(1, 7)}
    assert count[1] == [1] and count[2] == [1, 2] and count[3] == [1] and count[4] == [] and count[5] == [1] and len(count[6]) > 1
    six = [r for r in got if r.doc_id == 6]
    crlf = lambda s: s.replace("\r\n", "\n")
    assert "".join(crlf(r.piece)[r.core_first - r.first :] for r in six) == crlf(rows[5][2])
    assert all(len(crlf(r.piece)) == r.last - r.first <= 2000 for r in six)
    with pytest.raises(ValueError):
        P.spans("x", 10, 10)


def test_go_comments_above_functions():
    text = """package a

// Far away.

func lone() {}

// Open opens gates
// until all are open.
//go:noinline
func (g *Gate) Open(n int, f func(a, b int) error) (int, error) {
	s := "}" // }
	if n > 0 { return 1, nil }
	return 0, nil
}

/* a block */
// Keys of the map, sorted.
func Keys[K comparable](m map[K]interface{}) []K {
	return nil
}

// Not closed.
func broken() {
"""
    got = [(f.line, f.name, f.params[:1], f.doc, text[f.start : f.end][-3:]) for f in D.go_functions(text)]
    assert got == [(10, "Gate.Open", ["n"], "Open opens gates\nuntil all are open.", "l\n}"), (18, "Keys", ["m"], "Keys of the map, sorted.", "l\n}")]


@pytest.mark.parametrize(
    "text,lang,want",
    [
        ("def f(a,\n", "python", "truncated"), ('x = """abc\n', "python", "truncated"), ("def f():\n", "python", "truncated"), ("x = = 1\ny = 2\n", "python", "corrupt"),
        ('{"a": [1, 2', "json", "truncated"), ('{"a": "b', "json", "truncated"), ('{"a": 1 "b": 2}', "json", "corrupt"), ("a = [1,\n", "toml", "truncated"), ("a = = 1\nb = 2\n", "toml", "corrupt"),
        ("<<<<<<< ours\nx = (\n=======\n", "python", "conflict markers"),
    ],
)
def test_causes(text, lang, want):
    assert judge(text, lang)[3] == want
