"""Formulas of derived primitives, as ``DIV(SUM($0),LENGTH($0))``, read into a tree and built as columns.

``$n`` is the n-th argument (from 0), ``CONST(x)`` a number, anything else a call of a known primitive. A primitive
that is not known, or has another number of arguments, is refused; nothing has a plausible default.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import vector as V

_TOKEN = re.compile(r"\s*(?:(\$\d+)|([A-Za-z_][A-Za-z0-9_]*)|(-?\d+(?:\.\d+)?)|([(),]))")


@dataclass(frozen=True)
class Node:
    """A slot, a number or a call."""

    name: str = ""
    slot: int = -1
    number: float | None = None
    args: tuple[Node, ...] = ()


def read(text: str) -> Node:
    """The tree of a formula; a broken one raises ``ValueError`` with the place."""
    tokens: list[tuple[int, str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text!r}")
        tokens.append((m.lastindex or 0, m.group(m.lastindex or 0), str(at)))
        at = m.end()
    open_calls: list[tuple[str, list[Node]]] = []
    done: Node | None = None
    want_value = True
    for k, (kind, word, place) in enumerate(tokens):
        if done is not None and not open_calls:
            raise ValueError(f"text after the end at {place}: {text!r}")
        if kind == 4 and word == ")" and open_calls and (not want_value or not open_calls[-1][1] and tokens[k - 1][1] == "("):
            name, args = open_calls.pop()
            node = Node(name=name, args=tuple(args))
        elif kind == 4 and word == "," and open_calls and not want_value:
            want_value = True
            continue
        elif kind == 4 and word == "(" and k and tokens[k - 1][0] == 2 and want_value:
            continue  # opened with its name
        elif kind == 4 or not want_value:
            raise ValueError(f"unexpected {word!r} at {place}: {text!r}")
        elif kind == 2 and k + 1 < len(tokens) and tokens[k + 1][1] == "(":
            open_calls.append((word.upper(), []))
            continue
        else:
            node = Node(slot=int(word[1:])) if kind == 1 else Node(number=float(word)) if kind == 3 else Node(name=word.upper())
        want_value = False
        if open_calls:
            open_calls[-1][1].append(node)
        else:
            done = node
    if open_calls or done is None:
        raise ValueError(f"unfinished formula: {text!r}")
    return done


#: Primitives that formulas may call: how many arguments, and what they are.
PRIMITIVES: dict[str, tuple[int, Callable[..., Column]]] = {
    "ADD": (2, lambda a, b: a + b),
    "SUB": (2, lambda a, b: a - b),
    "MUL": (2, lambda a, b: a * b),
    "DIV": (2, V.divide),
    "SQRT": (1, F.sqrt),
    "ABS": (1, F.abs),
    "SUM": (1, V.sum_),
    "PROD": (1, V.prod),
    "LENGTH": (1, lambda a: F.size(a).cast("double")),
    "REDUCE_AND": (1, lambda a: F.forall(a, V.as_logical_number)),
    "REDUCE_OR": (1, lambda a: F.exists(a, V.as_logical_number)),
    "CONST": (1, lambda a: a),
}
#: Primitives that work on each element where an argument is an array.
ELEMENTWISE = frozenset({"ADD", "SUB", "MUL", "DIV", "SQRT", "ABS"})


def build(node: Node, arguments: list[Column], arrays: frozenset[int] = frozenset()) -> Column:
    """The column of a tree; ``arrays`` are the slots that hold arrays."""
    return _build(node, arguments, arrays)[0]


def _build(node: Node, arguments: list[Column], arrays: frozenset[int]) -> tuple[Column, bool]:
    if node.slot >= 0:
        if node.slot >= len(arguments):
            raise ValueError(f"no argument ${node.slot}")
        return arguments[node.slot], node.slot in arrays
    if node.number is not None:
        return F.lit(node.number), False
    if node.name not in PRIMITIVES:
        raise ValueError(f"unsupported primitive: {node.name}")
    n, make = PRIMITIVES[node.name]
    if len(node.args) != n:
        raise ValueError(f"{node.name} takes {n} arguments")
    got = [_build(a, arguments, arrays) for a in node.args]
    if node.name in ELEMENTWISE and any(many for _, many in got):
        if n == 1:
            return F.transform(got[0][0], make), True
        (a, many_a), (b, many_b) = got
        if many_a and many_b:
            return V.recycle(a, b, make), True
        return F.transform(a if many_a else b, lambda x: make(x, b) if many_a else make(a, x)), True
    return make(*(c for c, _ in got)), False
