"""Token streams and bracket structure of source texts, and names harvested from JSON, as table functions.

Tokens: class (identifier, number, string, comment, operator, open, close), text, offset in code points
(0-based) and bracket depth (an opening bracket has the depth outside it, as has its closing one). White
space makes no token. An unclosed string ends at the line's end, an unclosed block comment at the text's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: What begins a comment up to the line's end, by language; other languages take both.
LINE_COMMENTS = {"c": "//", "cpp": "//", "csharp": "//", "go": "//", "java": "//", "javascript": "//", "typescript": "//", "rust": "//", "swift": "//", "kotlin": "//", "python": "#", "ruby": "#", "r": "#"}


@lru_cache(maxsize=32)
def lexer_for(language: str | None = None) -> re.Pattern:
    """The tokens of a language; without one ``//`` and ``#`` both begin comments."""
    marks = [LINE_COMMENTS[language]] if language in LINE_COMMENTS else ["//", "#"]
    line = "|".join(re.escape(m) + r"[^\n]*" for m in marks)
    block = r"|/\*(?:.*?\*/|.*)" if "//" in marks else ""
    return re.compile(
        rf"""(?P<comment>{line}{block})"""
        r"""|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?)"""
        r"""|(?P<number>0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<identifier>[^\W\d]\w*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<operator>[^\s\w()\[\]{}"'`]+?)""",
        re.S,
    )


PAIRS = {")": "(", "]": "[", "}": "{"}


def lex(text: str, language: str | None = None) -> Iterator[tuple[str, str, int, int]]:
    """(class, text, offset, depth) of each token."""
    depth = 0
    for m in lexer_for(language).finditer(text):
        kind = m.lastgroup or "operator"
        if kind == "close":
            depth -= 1
        yield kind, m.group(), m.start(), depth
        if kind == "open":
            depth += 1


def brackets(text: str) -> tuple[bool, list[tuple[int, int]]]:
    """Whether the brackets outside strings and comments balance, and the (open, close) offsets of the pairs."""
    stack: list[tuple[str, int]] = []
    pairs, ok = [], True
    for kind, t, at, _ in lex(text):
        if kind == "open":
            stack.append((t, at))
        elif kind == "close":
            if stack and stack[-1][0] == PAIRS[t]:
                pairs.append((stack.pop()[1], at))
            else:
                ok = False
    return ok and not stack, sorted(pairs)


def harvest(value: Any) -> list[str]:
    """Sorted distinct strings under keys that hold ``node``, ``kind`` or ``type``, and strings standing in lists, at any depth."""
    found: set[str] = set()
    todo = [(value, False)]
    while todo:
        v, named = todo.pop()
        if isinstance(v, dict):
            todo += [(x, any(w in k.lower() for w in ("node", "kind", "type"))) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, True) for x in v]
        elif isinstance(v, str) and named and v.strip():
            found.add(v.strip())
    return sorted(found)


def json_rows(value: Any, path: str = "$") -> Iterator[tuple[str, dict[str, str]]]:
    """Every object of a JSON tree as (path, its scalar members as text)."""
    todo = [(value, path)]
    while todo:
        v, p = todo.pop()
        if isinstance(v, dict):
            yield p, {k: x if isinstance(x, str) else json.dumps(x) for k, x in v.items() if x is not None and not isinstance(x, (dict, list))}
            todo += [(x, f"{p}.{k}") for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, f"{p}[{i}]") for i, x in enumerate(v)]


def _loads(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _table(df: DataFrame, key: str, text: str, names: list[str], kinds: list[pa.DataType], schema: str, rows) -> DataFrame:  # noqa: ANN001
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                got = list(rows(b.column(1)[i].as_py()))
                if got:
                    k = b.column(0).slice(i, 1).take(pa.array([0] * len(got)))
                    yield pa.RecordBatch.from_arrays([k, *(pa.array(c, t) for c, t in zip(zip(*got), kinds))], [key, *names])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, {schema}")


def token_stream(df: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """(key, token_class, token, token_offset, depth) of every text; null and blank texts give none. ``language`` tells what a comment is."""
    return _table(df, key, text, ["token_class", "token", "token_offset", "depth"], [pa.string(), pa.string(), pa.int32(), pa.int32()], "token_class string, token string, token_offset int, depth int", lambda t: lex(t or "", language))


def bracket_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, balanced, open_offset, close_offset), one row per pair; a text without pairs gives one row of nulls."""

    def rows(t: str | None) -> list[tuple]:
        ok, pairs = brackets(t or "")
        return [(ok, a, b) for a, b in pairs] or [(ok, None, None)]

    return _table(df, key, text, ["balanced", "open_offset", "close_offset"], [pa.bool_(), pa.int32(), pa.int32()], "balanced boolean, open_offset int, close_offset int", rows)


def harvest_names(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name) harvested from JSON texts; broken JSON gives none."""
    return _table(df, key, text, ["name"], [pa.string()], "name string", lambda t: [(n,) for n in harvest(_loads(t))])


def json_tree_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, obj_path, cells) of every object in JSON texts."""
    return _table(df, key, text, ["obj_path", "cells"], [pa.string(), pa.map_(pa.string(), pa.string())], "obj_path string, cells map<string,string>", lambda t: json_rows(_loads(t)))
