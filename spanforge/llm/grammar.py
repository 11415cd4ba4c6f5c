"""Does a text parse? One exact judge per supported language."""

from __future__ import annotations

import ast
import json
import re
import symtable
import tomllib
import warnings

LANGUAGES = ("python", "json", "toml")
SUFFIX = {".py": "python", ".json": "json", ".toml": "toml"}


def parses_python(text: str) -> bool:
    """Whether Python's own parser accepts the text. The symbol-table pass accepts a subset
    without building a tree; what it refuses is decided by a full parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for judge in (lambda: symtable.symtable(text, "<text>", "exec"), lambda: ast.parse(text)):
            try:
                judge()
                return True
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
    return False


def _no_constant(name: str):
    raise ValueError(name)


def parses_json(text: str) -> bool:
    """RFC 8259: NaN and the infinities are refused."""
    try:
        json.loads(text, parse_constant=_no_constant)
        return True
    except (ValueError, RecursionError):
        return False


def parses_toml(text: str) -> bool:
    try:
        tomllib.loads(text)
        return True
    except (ValueError, RecursionError):
        return False


PARSERS = {"python": parses_python, "json": parses_json, "toml": parses_toml}

_SIGNS = {
    "python": re.compile(r"^[ \t]*(?:def|class|import|from|return|if|for|while|with|try|except|elif|else|yield|assert|del|pass|async)\b|\bself\b|:[ \t]*$", re.M),
    "json": re.compile(r'\A\s*(?:\{|\[\s*[\d"{\[\]tfn-])|"[ \t]*:|^[ \t]*[\]}],?[ \t]*$|\bnull\b', re.M),
    "toml": re.compile(r"^[ \t]*\[{1,2}[\w.\"' -]+\]{1,2}[ \t]*$|^[ \t]*[\w.\"'-]+[ \t]*=", re.M),
}


def rank_languages(text: str) -> list[str]:
    """Languages by the number of their typical tokens in the whole text, most first."""
    counts = {lang: sum(1 for _ in sign.finditer(text)) for lang, sign in _SIGNS.items()}
    return sorted(LANGUAGES, key=lambda lang: (-counts[lang], LANGUAGES.index(lang)))


_MERGE = re.compile(r"^(?:<{7}|={7}|>{7})(?:[ \t]|$)", re.M)


def ends_early(text: str, lang: str) -> bool:
    """Whether the grammar that refuses the text does so at its end: more was to come."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            {"python": ast.parse, "json": json.loads, "toml": tomllib.loads}[lang](text)
    except json.JSONDecodeError as e:
        return e.pos >= len(text.rstrip()) or e.msg.startswith("Unterminated string")
    except tomllib.TOMLDecodeError as e:
        return "end of document" in str(e)
    except SyntaxError as e:
        last = len(text.rstrip().splitlines())
        open_ = any(m in (e.msg or "") for m in ("was never closed", "unterminated triple-quoted", "unexpected EOF"))
        return open_ or ((e.lineno or 0) >= last and (e.msg or "").startswith("expected an indented block"))
    except (ValueError, RecursionError, MemoryError):
        return False
    return False


def judge(text: str, declared: str) -> tuple[bool, list[str], list[str], str | None]:
    """Parses as declared, ranked languages, languages that accept it, cause of failure.

    Every grammar is tried in ranked order. A file that its own grammar refuses and another
    accepts has the wrong extension; one that all refuse is corrupt, by conflict markers, by
    truncation, or else.
    """
    ranked = rank_languages(text)
    accepted = [lang for lang in ranked if PARSERS[lang](text)]
    if declared in accepted:
        return True, ranked, accepted, None
    if accepted:
        return False, ranked, accepted, f"wrong extension: {accepted[0]}"
    return False, ranked, accepted, "conflict markers" if _MERGE.search(text) else "truncated" if ends_early(text, declared) else "corrupt"
