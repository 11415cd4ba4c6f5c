"""Functions paired with their documentation, by island grammars.

Only the islands are parsed: definitions with their signatures, documentation, annotations
and balanced bodies. Everything between is water and skipped by one scanning expression that
knows just strings, comments, brackets and line starts, so that no island is seen inside them.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.grammar import parses_python


@dataclass
class Function:
    line: int
    name: str  # with the enclosing classes and functions, joined by dots
    params: list[str]
    doc: str
    start: int
    end: int


_QUOTED = r"""(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+(?:\"{3}|\Z)|'{3}(?:[^'\\]++|\\.|'(?!''))*+(?:'{3}|\Z)|"(?:[^"\\\r\n]++|\\(?:\r\n|.))*+"?|'(?:[^'\\\r\n]++|\\(?:\r\n|.))*+'?)"""
_PLAIN = r"[^()\[\]{}\"'#\\\r\n]*+"
_WATER = rf"""(?:[^"'#()\[\]{{}}\\\r\n]++|{_QUOTED}|\#[^\r\n]*+|\({_PLAIN}\)|\[{_PLAIN}\]|\{{{_PLAIN}\}}|\\(?:\r\n|.)|(?:\r\n|[\r\n])[ \t\f]*+(?=[\r\n#]|\Z))*+"""
#: water up to a line start, with the definition on it if there is one, or to a bracket
_ISLAND = re.compile(
    _WATER + r"""(?:(?P<line>(?:\r\n|[\r\n])(?P<blank>[ \t\f]*+)(?:(?P<kind>async[ \t]+def|def|class)[ \t]+(?P<name>\w+))?)|(?P<open>[(\[{])|(?P<close>[)\]}]))""",
    re.S,
)
_HEADER = re.compile(rf"""{_QUOTED}|\#[^\r\n]*|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<colon>:)|(?P<comma>,)""", re.S)
_SIMPLE_HEADER = re.compile(r"""\(([^()\[\]{}"'#]*)\)[ \t]*(?:->[^:()\[\]{}"'#\r\n]*)?:""")
_GAP = re.compile(r"(?:[ \t\f\r\n]|\\\r?\n|#[^\r\n]*)*")
_INLINE_GAP = re.compile(r"(?:[ \t\f]|\\\r?\n)*")
_PIECE = re.compile(r"(?P<prefix>[A-Za-z]{0,2})" + _QUOTED, re.S)
_END = re.compile(r"[ \t\f]*(?:#[^\r\n]*)?(?:[\r\n;]|\Z)")


def _indent(blank: str) -> int:
    n = 0
    for c in blank:
        n = (n // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else n + 1
    return n


def _header(text: str, at: int) -> tuple[list[str], int] | None:
    """Parameter names and the position after the colon of a signature that starts at ``at``."""
    if simple := _SIMPLE_HEADER.match(text, at):
        found = (re.match(r"[\s*]*(\w+)", n) for n in simple[1].split(","))
        return [f[1] for f in found if f], simple.end()
    depth, names, start, closed = 0, [], None, False
    for m in _HEADER.finditer(text, at):
        kind = m.lastgroup
        if kind == "open":
            depth += 1
            if depth == 1 and m[0] == "(" and start is None and not closed:
                start = m.end()
        elif kind == "close":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0 and start is not None and not closed:
                names.append(text[start : m.start()])
                closed = True
        elif kind == "comma" and depth == 1 and start is not None and not closed:
            names.append(text[start : m.start()])
            start = m.end()
        elif kind == "colon" and depth == 0:
            found = (re.match(r"[\s*]*(?:#[^\n]*\n\s*)*\**\s*(\w+)", n) for n in names)
            return [f[1] for f in found if f], m.end()
    return None


def _docstring(text: str, at: int) -> str | None:
    """The docstring of a body that starts at ``at``, as Python defines it: a first statement
    that is nothing but plain string literals, in parentheses or not."""
    at = _GAP.match(text, at).end()
    depth = 0
    while text.startswith("(", at):
        depth += 1
        at = _GAP.match(text, at + 1).end()
    first, last = at, at
    while m := _PIECE.match(text, at):
        if m["prefix"].lower() not in ("", "r", "u"):
            return None
        last = m.end()
        at = (_GAP if depth else _INLINE_GAP).match(text, last).end()
    if last == first:
        return None
    close = last
    for _ in range(depth):
        close = _GAP.match(text, close).end()
        if not text.startswith(")", close):
            return None
        close += 1
    if not _END.match(text, close):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval("(" + text[first:last] + ")")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    return value if isinstance(value, str) else None


def python_functions(text: str) -> list[Function]:
    """Functions of a Python text that have a docstring, blank ones included, in order."""
    out: list[Function] = []
    scopes: list[tuple[int, str, Function | None]] = []
    depth = 0
    text = "\n" + text  # so that each line has a start; positions and lines are one more here
    line, counted = 0, 0
    for m in _ISLAND.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif depth == 0:
            column = _indent(m["blank"])
            while scopes and column <= scopes[-1][0]:
                if f := scopes.pop()[2]:
                    f.end = m.start("line") - 1
            if m["kind"] is None:
                continue
            function = None
            if m["kind"] != "class" and (head := _header(text, m.end())):
                doc = _docstring(text, head[1])
                if doc is not None:
                    at = m.start("kind")
                    line += text.count("\n", counted, at)
                    counted = at
                    function = Function(line, ".".join([s[1] for s in scopes] + [m["name"]]), head[0], doc, at - 1, len(text) - 1)
                    out.append(function)
            scopes.append((column, m["name"], function))
    return out


_BRACE = re.compile(
    r"""(?P<doc>/\*\*(?!/).*?\*/|(?:^[ \t]*///[^\n]*\n)+)(?P<note>(?:\s*(?:@[\w.]+(?:\([^()]*\))?|\#\[[^\]]*\]|export|default))*)\s*
    (?P<head>[^{};=@/"']*?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>]*>)?\s*\((?P<params>(?:[^()]|\([^()]*\))*)\)[^{};=]*)\{""",
    re.S | re.M | re.X,
)
_BRACE_WATER = re.compile(r"""/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?P<open>\{)|(?P<close>\})""", re.S)
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "new", "else"}


def _balanced(text: str, at: int) -> int | None:
    """End of the body whose opening brace is at ``at``; None if it is not closed."""
    depth = 0
    for t in _BRACE_WATER.finditer(text, at):
        depth += {"open": 1, "close": -1}.get(t.lastgroup or "", 0)
        if depth == 0 and t.lastgroup == "close":
            return t.end()
    return None


def brace_functions(text: str) -> list[Function]:
    """Functions of a language with braces that a documentation comment precedes and whose
    body is balanced."""
    out = []
    for m in _BRACE.finditer(text):
        end = None if m["name"] in _CONTROL else _balanced(text, m.end() - 1)
        if end is None:
            continue
        doc = re.sub(r"^[ \t]*(?:/\*\*|\*/|\*|///)?[ \t]?|\*/", "", m["doc"], flags=re.M)
        params = [w[-1] for p in m["params"].split(",") if (w := re.findall(r"[A-Za-z_$][\w$]*", p.split(":")[0].split("=")[0]))]
        start = m.start("head")
        out.append(Function(text.count("\n", 0, start) + 1, m["name"], params, doc, start, end))
    return out


_GO = re.compile(
    r"""(?P<doc>(?:^//[^\n]*\n)+)(?P<head>func[ \t]+(?:\([ \t]*(?:\w+[ \t]+)?\*?(?P<of>\w+)[^()\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?
    \((?P<params>(?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)(?:[^{}\n]|interface\{\}|struct\{\})*)\{[ \t]*(?=[\r\n}]|\S)""",
    re.M | re.X,
)


def go_functions(text: str) -> list[Function]:
    """Functions and methods of a Go text with lines of comment directly above them. A method's
    name begins with its receiver's type; directives such as //go:noinline are no documentation."""
    out = []
    for m in _GO.finditer(text):
        end = _balanced(text, m.end("head"))
        if end is None:
            continue
        doc = "\n".join(line[2:].strip() for line in m["doc"].splitlines() if not re.match(r"//\w+:\S", line))
        params = [w[0] for p in m["params"].split(",") if (w := re.findall(r"\w+", p))]
        start = m.start("head")
        out.append(Function(text.count("\n", 0, start) + 1, f"{m['of']}.{m['name']}" if m["of"] else m["name"], params, doc, start, end))
    return out


GRAMMARS = {".py": python_functions} | {s: brace_functions for s in (".java", ".js", ".ts", ".c", ".h", ".cc", ".cpp", ".rs", ".cs", ".kt")} | {".go": go_functions}

# fixed words of texts that stand in for a description
_MARKER = {"todo", "fixme", "tbd", "xxx", "tbc"}
_ANCHOR = _MARKER | {"placeholder", "docstring", "docstrings", "description", "describe", "summary", "documented", "undocumented", "document", "documentation", "docs", "doc", "template", "none", "na"}
_FILLER = {
    "the", "a", "an", "this", "that", "it", "here", "goes", "go", "to", "be", "is", "was", "were", "are", "has", "have", "and", "or", "of", "for", "by", "with", "in", "on",
    "no", "not", "yet", "missing", "add", "write", "written", "put", "insert", "fill", "filled", "replace", "replaced", "please", "provide", "needs", "need", "needed", "later",
    "line", "lines", "longer", "long", "short", "one", "sentence", "text", "real", "brief", "extended", "optional", "type", "what", "does", "me", "more", "some", "something",
    "your", "you", "function", "method", "arguments", "argument", "args", "parameters", "parameter", "returns", "return", "value", "says", "string", "there", "available", "details",
}
_SECTION = re.compile(r"(?im)^[ \t]*(?::(?:param|parameter|arg|argument|type|returns?|rtype|raises?|yields?)\b[^:\n]*:|@(?:param|returns?|throws)\b|(?:args|arguments|parameters|params|returns?|raises|yields?|attributes|notes?|examples?)[ \t]*(?::[ \t]*$|\n[ \t]*-{3,}))")
_SLOT = r"(?:(?<!\w)_[a-z]+_(?!\w)|\[[^\[\]]*\]|<[^<>]*>)"  # of a template, still to be filled in
_SLOTS_ONLY = re.compile(rf"(?:[\s.,:;-]*{_SLOT})+[\s.,:;-]*")
_EMPTY_ENTRY = re.compile(rf"(?m)^[ \t]*\*{{0,2}}\w+[ \t]*(?:\([^()\n]*\))?[ \t]*:[ \t]*{_SLOT}[ \t.]*$")
_NAMED_SLOT = re.compile(r"(?<!\w)_[a-z]+_(?!\w)")
_TYPED = re.compile(r"(?m)^([ \t]*\*{0,2}\w+)[ \t]*\([^()\n]*\)[ \t]*:")
_WORD = re.compile(r"\w+")


def _stem(word: str) -> str:
    """What inflected forms of an English word have in common."""
    w = word.lower()
    for end in ("ing", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 2 and not (end == "s" and w.endswith("ss")):
            w = w[: -len(end)]
            break
    if len(w) > 2 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    if len(w) > 2 and w[-1] == "e":
        w = w[:-1]
    return w[:-1] + "i" if len(w) > 2 and w[-1] == "y" else w


def _name_words(name: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+", name)


def says_something(doc: str, name: str, params: list[str]) -> bool:
    """Whether a documentation text says anything of its function. It does not if it is blank
    or only marks, a stand-in for a text still to be written (a marker such as TODO, slots of
    a template in brackets or underscores, a sentence about documentation), or only repeats the words of
    the function's name (also inflected, with an article) and bare parameter names."""
    if not re.search(r"[^\W_]", doc) or _SLOTS_ONLY.fullmatch(doc):
        return False
    doc = _NAMED_SLOT.sub(" ", _EMPTY_ENTRY.sub(" ", doc))
    own = name.rsplit(".", 1)[-1]
    bare = {p.lower() for p in params}
    body = _TYPED.sub(r"\1:", doc)

    def heading(m: re.Match) -> str:
        rest = _WORD.findall(m[0])[1:] if m[0].lstrip()[:1] == ":" else []
        return " " + " ".join(w for w in rest if w.lower() not in bare) + " "

    body = _SECTION.sub(heading, body)
    words = [w.strip("_") for w in _WORD.findall(re.sub(r"(?i)\bn/a\b", "na", body)) if w.lower() not in bare and w.strip("_")]
    parts = _name_words(own)
    stems = {_stem(x) for x in parts} | {x.lower() for x in parts} | {"".join(parts).lower(), "a", "an", "the"}
    left = [x.lower() for x in words if x.lower() not in stems and _stem(x) not in stems and not ((y := _name_words(x)) and all(_stem(z) in stems for z in y))]
    if not left:
        return False
    if words[0].lower() in _MARKER:
        return False
    return not (any(x in _ANCHOR for x in left) and all(x in _ANCHOR or x in _FILLER for x in left))


PAIRS = "doc_id long, file_path string, def_line long, qual_name string, signature string, documentation string, code string"


def pair_functions(documents: DataFrame, code: bool = True) -> DataFrame:
    """One row per function with a documentation that says something, of every file whose
    suffix has a grammar: doc_id, file_path, def_line (1-based line of the def, lines ending at
    LF or CRLF), qual_name, signature, documentation and the code with the documentation.

    A Python file counts only if the whole file parses; its parse follows the islands and is
    made only where one was found. Null paths, null, empty and blank texts give no rows. Whole
    texts are read, each in its batch, without a shuffle. With ``code`` false the last three
    columns are null, where only the places are wanted."""
    suffix = F.regexp_extract(F.lower("file_path"), r"(\.[a-z]+)$", 1)
    rows = documents.select("doc_id", "file_path", suffix.alias("_suffix"), "text").where(F.col("_suffix").isin(*GRAMMARS) & F.col("text").isNotNull())
    rows = rows.where(F.when(F.col("_suffix") == ".py", F.col("text").contains("def ") | F.col("text").contains("def\t")).otherwise(F.lit(True)))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for i, path, suffix, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "file_path", "_suffix", "text"))):
                found = [f for f in GRAMMARS[suffix](text) if says_something(f.doc, f.name, f.params)]
                if found and suffix == ".py" and not parses_python(text):
                    continue
                for f in found:
                    span = text[f.start : f.end].rstrip() if code else None
                    out.append((i, path, f.line, f.name, span.split("\n", 1)[0].strip() if code else None, f.doc if code else None, span))
            names = ["doc_id", "file_path", "def_line", "qual_name", "signature", "documentation", "code"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(run, PAIRS)
