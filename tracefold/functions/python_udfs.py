"""The few functions that need Python, as Arrow-batched UDFs."""

from __future__ import annotations

import ast
import difflib
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def params_hash(params: pd.Series) -> pd.Series:
    """16 hex digits of the SHA-256 of the params with sorted keys; null where they are null or no JSON."""

    def one(p: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(p), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
        except (TypeError, ValueError):
            return None

    return params.map(one)


_MARK = re.compile(r'\\.|["{}]', re.S)
# A fenced block, and a comma before a closing bracket.
_FENCE = re.compile(r"```(?:json|JSON)?\s*\n?(.*?)\n?\s*```", re.S)
_COMMA = re.compile(r",\s*([}\]])")


def _first_object(text: str) -> str | None:
    """From the first { to the } that closes it, strings and escapes minded; one pass over the text."""
    at, depth, quoted = text.find("{"), 0, False
    if at < 0:
        return None
    for m in _MARK.finditer(text, at):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[at : m.end()]
    return None


def _repaired(text: str) -> str | None:
    """The text as a repair library mends it, where one is installed."""
    try:
        from json_repair import repair_json
    except ImportError:
        return None
    try:
        return repair_json(text, return_objects=False) or None
    except (ValueError, TypeError, RecursionError):
        return None


def extract_object(text: str | None) -> dict | None:
    """The JSON object in a text; the first of these that is one: the text itself, a fenced block, the same without trailing commas, the first braces, those without trailing commas, the repaired text."""
    if not isinstance(text, str):
        return None
    fenced, braces = _FENCE.search(text), _first_object(text)
    tidy = lambda t: t and _COMMA.sub(r"\1", t)
    inner = fenced and fenced[1].strip()
    for t in (lambda: text, lambda: inner, lambda: tidy(inner), lambda: braces, lambda: tidy(braces), lambda: _repaired(text)):
        try:
            o = json.loads(t() or "")
        except (ValueError, RecursionError):
            continue
        if isinstance(o, dict):
            return o
    return None


@F.pandas_udf(T.StringType())
def json_object_in(text: pd.Series) -> pd.Series:
    """The JSON object that a text holds, as JSON text; null if there is none."""
    return text.map(lambda t: (lambda o: None if o is None else json.dumps(o, ensure_ascii=False))(extract_object(t)))


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
    """The unified diff of two texts; '' if they are equal."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for a, b, p in zip(old, new, path)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def similar_lines(text: pd.Series, wanted: pd.Series) -> pd.Series:
    """The three lines of a text most like the first line wanted, of at least 0.6 by difflib's ratio."""
    return pd.Series([difflib.get_close_matches(((w or "").strip().splitlines() or [""])[0].strip(), [x.strip() for x in (t or "").splitlines()], n=3, cutoff=0.6) for t, w in zip(text, wanted)], dtype=object)


@F.pandas_udf(T.StringType())
def python_syntax_error(text: pd.Series) -> pd.Series:
    """'line N: message' if the text isn't valid Python, else null."""

    def one(t: str | None) -> str | None:
        try:
            ast.parse(t or "")
        except (SyntaxError, ValueError) as e:
            return f"line {getattr(e, 'lineno', 0) or 0}: {getattr(e, 'msg', e)}"
        return None

    return text.map(one)


SIGNATURES = 15


def signatures_in(text: str | None, most: int = SIGNATURES) -> list[str]:
    """The headers of a module's functions and classes in order, a class's methods indented below it, names of positional arguments only.

    Once there are `most` or more, '    ...' ends the list; a class that was begun is listed whole. What doesn't parse has none.
    """
    try:
        body = ast.parse(text or "").body
    except (SyntaxError, ValueError, RecursionError):
        return []
    head = lambda f, indent: f"{indent}{'async def' if isinstance(f, ast.AsyncFunctionDef) else 'def'} {f.name}({', '.join(a.arg for a in f.args.args)})"
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    out: list[str] = []
    for n in body:
        if isinstance(n, functions):
            out.append(head(n, ""))
        elif isinstance(n, ast.ClassDef):
            out += [f"class {n.name}:", *(head(m, "    ") for m in n.body if isinstance(m, functions))]
        if len(out) >= most:
            return [*out, "    ..."]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_signatures(text: pd.Series) -> pd.Series:
    """The headers in a Python module, see signatures_in."""
    return text.map(signatures_in)
