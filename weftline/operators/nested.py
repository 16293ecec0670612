"""Nested semi-structured records into related flat tables.

One depth-first visit of each record emits every object once, as (table tag, primary key,
parent key, payload). The tag names the flat table, the keys are the record id with the
object's path, and the payload holds as JSON text all that the object's own members hold
besides the objects below it that are rows themselves. The emission is written partitioned by tag, and a schema is applied per tag on reading.

Defined results
* a null, empty or incomplete payload gives no rows; nor does JSON that is no object;
* nulls and non-objects inside arrays give no row, but count in the index;
* one object where an array is usual gets a path without index;
* text that holds a JSON object or array, where one is looked for, is read in place;
* a member leaves the payload only if all it holds became rows; in what else stands beside
  such objects (array members that are no objects, an argument's name) they are null or absent;
* a key that occurs twice in one object: the last counts, as JSON parsers do;
* a record id delivered more than once: its latest delivery is visited, ties by the greater payload;
* extra columns of the input are ignored, so their names cannot clash; an empty table gives
  an empty result. Depth is limited by stacks on the heap, not by the interpreter's recursion,
  in parsing, visiting and writing payloads (a member deeper than 900 is held there as JSON
  text); whole numbers may have any number of digits.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import Staging

EMITTED = "table_tag string, record_id bigint, obj_path string, parent_path string, payload string"

#: What the visitor looks for: role -> (member key, role of the objects found there, tag).
#: A key with a dot descends through plain objects that make no row themselves.
DOCUMENT_RULES: dict[str, list[tuple[str, str, str]]] = {
    "document": [
        ("universal_ast.nodes", "leaf", "ast_node"),
        ("universal_ast.relations", "leaf", "ast_relation"),
        ("trace.nodes", "leaf", "trace_node"),
        ("root", "statement", "statement"),
    ],
    "statement": [
        *((k, "statement", "statement") for k in ("then", "else", "body", "statements")),
        *((k, "expression", "expression") for k in ("expression", "condition", "sequence", "patterns")),
    ],
    "expression": [
        *((k, "expression", "expression") for k in ("left", "right", "value")),
        ("arguments*.value", "expression", "expression"),
    ],
    "leaf": [],
}


_GONE = object()


def _loads(text: str) -> Any:
    """The JSON value of a whole text, or None if it is broken."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep_loads(text)
    except ValueError:
        return None


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = json.JSONDecoder().scan_once


def _deep_loads(text: str) -> Any:
    """As ``_loads``, with open arrays and objects on a list instead of the interpreter's stack."""

    def skip(i: int) -> int:
        return _BLANK.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        k, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        return k, skip(i + 1)

    above: list[tuple[Any, Any]] = []  # open arrays and objects with the key that is being read
    try:
        i = skip(0)
        while True:
            c = text[i : i + 1]
            if c in ("[", "{"):
                v: Any = [] if c == "[" else {}
                i = skip(i + 1)
                if text[i : i + 1] != ("]" if c == "[" else "}"):
                    k = None
                    if c == "{":
                        k, i = key(i)
                    above.append((v, k))
                    continue
                i += 1
            else:
                v, i = _PLAIN(text, i)
            while above:  # v is whole
                into, k = above[-1]
                if k is None:
                    into.append(v)
                else:
                    into[k] = v
                i = skip(i)
                c = text[i : i + 1]
                if c == ",":
                    i = skip(i + 1)
                    if k is not None:
                        k, i = key(i)
                        above[-1] = (into, k)
                    break
                if c != ("]" if k is None else "}"):
                    return None
                v = above.pop()[0]
                i += 1
            else:
                return v if skip(i) == len(text) else None
    except (ValueError, StopIteration):
        return None


def _dumps(v: Any) -> str:
    """The JSON text of a value of any depth."""
    try:
        return json.dumps(v, separators=(",", ":"))
    except RecursionError:
        return _deep_dumps(v)


def _deep_dumps(v: Any) -> str:
    out: list[str] = []
    todo: list[tuple[str, Any]] = [("", v)]  # text to write, then a value or nothing
    while todo:
        before, x = todo.pop()
        out.append(before)
        if x is _GONE:
            continue
        if not isinstance(x, (dict, list)):
            out.append(json.dumps(x))
            continue
        pairs = [(json.dumps(k) + ":", y) for k, y in x.items()] if isinstance(x, dict) else [("", y) for y in x]
        out.append("{" if isinstance(x, dict) else "[")
        todo.append(("}" if isinstance(x, dict) else "]", _GONE))
        todo.extend(("," * (i > 0) + k, y) for i, (k, y) in reversed(list(enumerate(pairs))))
    return "".join(out)


def _opened(v: Any) -> Any:
    """Text that holds a JSON object or array is read in place."""
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        inner = _loads(v)
        return inner if isinstance(inner, (dict, list)) else v
    return v


def _members(v: Any, path: str) -> Iterator[tuple[dict, str]]:
    v = _opened(v)
    if isinstance(v, dict):
        yield v, path
    elif isinstance(v, list):
        for i, x in enumerate(v):
            x = _opened(x)
            if isinstance(x, dict):
                yield x, f"{path}[{i}]"


def _reach(obj: dict, steps: list[str], path: str) -> Iterator[tuple[dict, str]]:
    """Objects at ``a.b`` (through one object) or ``a*.b`` (through each member of a)."""
    step, rest = steps[0], steps[1:]
    key = step.rstrip("*")
    if key not in obj:
        return
    if not rest:
        yield from _members(obj[key], f"{path}.{key}")
        return
    for x, p in _members(obj[key], f"{path}.{key}"):
        yield from _reach(x, rest, p)


def visit(record: Any, rules: dict[str, list[tuple[str, str, str]]], top: str, top_tag: str = "") -> Iterator[tuple[str, str, str | None, str, dict]]:
    """Depth first: (tag, path, path of the nearest enclosing row, role, object).

    With ``top_tag`` the record itself is a row too, at ``$`` and without parent.
    """
    record = _opened(record)
    if not isinstance(record, dict):
        return
    compiled = {role: [(k.split("."), r, tag) for k, r, tag in found] for role, found in rules.items()}
    stack: list[tuple[str, str, str, str | None, dict]] = [(top_tag, top, "$", None, record)]
    while stack:
        tag, role, path, parent, obj = stack.pop()
        if tag:
            yield tag, path, parent, role, obj
        below = [(t, r, p, path, x) for steps, r, t in compiled[role] for x, p in _reach(obj, steps, path)]
        stack.extend(reversed(below))


def _taken(found: list[tuple[str, str, str]]) -> dict:
    """The keys of a role's rules as a tree; None where the objects found are rows."""
    tree: dict = {}
    for key, _, _ in found:
        *above, last = (k.rstrip("*") for k in key.split("."))
        at = tree
        for k in above:
            at = at.setdefault(k, {})
            if at is None:
                break
        else:
            at[last] = None
    return tree


def _without(obj: dict, taken: dict | None) -> Any:
    """What an object holds besides rows, or _GONE if that is nothing."""
    if taken is None:
        return _GONE
    kept = {k: r for k, v in obj.items() if (r := _rest(v, taken[k]) if k in taken else v) is not _GONE}
    return kept if kept or not obj else _GONE


def _rest(v: Any, taken: dict | None) -> Any:
    """What a member that rules visit holds besides rows, or _GONE if that is nothing."""
    v = _opened(v)
    if isinstance(v, dict):
        return _without(v, taken)
    if isinstance(v, list):
        rest = [_without(o, taken) if isinstance(o := _opened(x), dict) else x for x in v]
        if any(x is _GONE for x in rest):
            rest = [None if x is _GONE else x for x in rest]
            return rest if any(x is not None for x in rest) else _GONE
        return rest
    return v


#: The JSON writer behind text columns stops at a depth of 1,000, so deeper members are text in the payload.
_DEEP = 900


def _deeper(v: Any, most: int) -> bool:
    level = [v]
    for _ in range(most + 1):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return False
    return True


def _payload(obj: dict, taken: dict) -> str:
    own = _without(obj, taken)
    own = {} if own is _GONE else own
    text = _dumps(own)
    if text.count("[") + text.count("{") > _DEEP:
        text = _dumps({k: _dumps(v) if _deeper(v, _DEEP) else v for k, v in own.items()})
    return text


def _emitter(rules: dict, top: str, payload: bool, top_tag: str = "") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)
        taken = {role: _taken(found) for role, found in rules.items()}
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            size = 0
            for rid, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                for tag, path, parent, role, obj in visit(_loads(t) if t else None, rules, top, top_tag):
                    row = (tag, rid, path, parent, _payload(obj, taken[role]) if payload else None)
                    for c, v in zip(cols, row):
                        c.append(v)
                    size += 64 + len(path) + len(parent or "") + len(row[4] or "")
                    if size > 32_000_000:
                        yield _batch(cols)
                        cols, size = [[], [], [], [], []], 0
            yield _batch(cols)

    return run


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["table_tag", "record_id", "obj_path", "parent_path", "payload"])


def latest(df: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """One row per key: the delivery with the greatest ``at``, ties by the greatest values."""
    best = F.max(F.struct(F.col(at).alias("__at"), *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])).alias("__best")
    return df.groupBy(F.col(key)).agg(best).select(F.col(key), *[F.col(f"__best.__v{i}").alias(v) for i, v in enumerate(values)])


def flatten_json(df: DataFrame, record_id: str, payload: str, at: str, rules: dict | None = None, top: str = "document", with_payload: bool = True, top_tag: str = "") -> DataFrame:
    """Tagged emission of the JSON texts in ``payload``: one row per object (columns ``EMITTED``), and with ``top_tag`` one per record."""
    one = latest(df.filter(F.col(record_id).isNotNull()), record_id, at, payload)
    picked = one.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).alias("payload"))
    return picked.mapInArrow(_emitter(rules or DOCUMENT_RULES, top, with_payload, top_tag), EMITTED)


def flatten_structs(df: DataFrame, record_id: str, member: str, at: str, tag: str, top_tag: str = "") -> DataFrame:
    """The same emission for an array-of-struct column; stays in the JVM. With ``top_tag`` the record's other columns are a row."""
    if top_tag:
        rest = [c for c in df.columns if c not in (record_id, member)]
        one = latest(df.filter(F.col(record_id).isNotNull()).withColumn("__rest", F.to_json(F.struct(*rest))), record_id, at, member, "__rest")
        whole = F.struct(F.lit(top_tag).alias("table_tag"), F.lit("$").alias("obj_path"), F.lit(None).cast("string").alias("parent_path"), F.col("__rest").alias("payload"))
        path = lambda i: F.concat(F.lit(f"$.{member}["), i.cast("string"), F.lit("]"))
        part = lambda o, i: F.when(o.isNotNull(), F.struct(F.lit(tag).alias("table_tag"), path(i).alias("obj_path"), F.lit("$").alias("parent_path"), F.to_json(o).alias("payload")))
        none = F.array().cast("array<struct<table_tag:string,obj_path:string,parent_path:string,payload:string>>")
        every = F.explode(F.concat(F.array(whole), F.coalesce(F.transform(member, part), none))).alias("r")  # one pass over the record
        x = one.select(F.col(record_id).cast("bigint").alias("record_id"), every).filter("r IS NOT NULL")
        return x.select("r.table_tag", "record_id", "r.obj_path", "r.parent_path", "r.payload")
    one = latest(df.filter(F.col(record_id).isNotNull()), record_id, at, member)
    x = one.select(F.col(record_id).cast("bigint").alias("record_id"), F.posexplode(member).alias("__i", "__o")).filter(F.col("__o").isNotNull())
    return x.select(
        F.lit(tag).alias("table_tag"),
        "record_id",
        F.concat(F.lit(f"$.{member}["), F.col("__i").cast("string"), F.lit("]")).alias("obj_path"),
        F.lit("$").alias("parent_path"),
        F.to_json("__o").alias("payload"),
    )


#: The JSON reader's own bounds on depth and lengths would make a whole row null.
_NO_LIMITS = {k: str(2**31 - 1) for k in ("maxNestingDepth", "maxNumLen", "maxStringLen")}


def stage_tagged(spark: SparkSession, emitted: DataFrame) -> DataFrame:
    """Write the emission once, partitioned by tag, and read it back."""
    path = f"{Staging(spark, 'tagged').root}/by_tag"
    emitted.write.partitionBy("table_tag").parquet(path)
    return spark.read.schema("record_id bigint, obj_path string, parent_path string, payload string, table_tag string").parquet(path)


def tagged_table(staged: DataFrame, tag: str, ddl: str) -> DataFrame:
    """One tag's table of a staged emission under its schema; a member missing in an object is null."""
    rows = staged.filter(F.col("table_tag") == tag)
    return rows.select("record_id", "obj_path", "parent_path", F.from_json("payload", ddl, _NO_LIMITS).alias("o")).select("record_id", "obj_path", "parent_path", "o.*")


def write_tagged(spark: SparkSession, emitted: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Write the emission once, partitioned by tag, and give each tag's table under its schema.

    ``schemas`` maps a tag to the DDL of its payload; a member missing in an object is null.
    """
    staged = stage_tagged(spark, emitted)
    return {tag: tagged_table(staged, tag, ddl) for tag, ddl in schemas.items()}
