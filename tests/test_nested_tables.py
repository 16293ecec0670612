"""The flat tables of nested records against the parsed payloads themselves."""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from weftline.operators.nested import DOCUMENT_RULES, flatten_json, flatten_structs, write_tagged
from weftline.session import Staging

SF = Path("/root/testdata/sf0.001")
TABLES = ["p5_statements", "p5_expressions", "p5_ast_nodes", "p5_ast_relations", "p5_trace_nodes", "p5_file_fields"]
needs_tables = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def latest_rows(name: str, key: str, at: str, value: str) -> dict:
    rows = pq.read_table(SF / f"{name}.parquet").to_pylist()
    return {r[key]: r[value] for r in sorted(rows, key=lambda r: (r[at], r[value] if isinstance(r[value], str) else ""))}


def at_path(v, path: str):
    for key, i in re.findall(r"\.(\w+)|\[(\d+)\]", path):
        v = json.loads(v) if isinstance(v, str) else v
        v = v[key] if key else v[int(i)]
    return json.loads(v) if isinstance(v, str) else v


@needs_tables
def test_all_objects_in_tables(spark):
    docs = {k: json.loads(v) for k, v in latest_rows("semantic_document", "document_id", "received_at", "payload").items() if v and v.endswith("}") and _whole(v)}
    files = latest_rows("semantic_package_manifest", "manifest_id", "imported_at", "files")
    seen = 0
    for name in TABLES:
        rows = entry.queries()[name](spark, str(SF)).collect()
        assert rows
        seen += len(rows)
        for r in rows:
            have = r.asDict(recursive=True)
            want = at_path({"files": files[r.record_id]} if name == "p5_file_fields" else docs[r.record_id], r.obj_path)
            for k, v in want.items():
                if not isinstance(v, (dict, list)) or name == "p5_file_fields":
                    assert have.get(k) == v, (name, r.obj_path, k)
    assert seen == entry.queries()["p5_found"](spark, str(SF)).count()


def _whole(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


@needs_tables
def test_found_reads_written_emission(spark):
    df = entry.queries()["p5_found"](spark, str(SF))
    assert df.inputFiles() and all("/by_tag/table_tag=" in f for f in df.inputFiles())


@needs_tables
def test_lists_and_objects_kept(spark):
    docs = {k: json.loads(v) for k, v in latest_rows("semantic_document", "document_id", "received_at", "payload").items() if v and _whole(v)}
    seen = Counter()
    for name, rules in zip(TABLES[:5], ["statement", "expression", "leaf", "leaf", "leaf"]):
        visited = {k.split("*")[0] for k, _, _ in DOCUMENT_RULES[rules]}
        for r in entry.queries()[name](spark, str(SF)).collect():
            have = r.asDict(recursive=True)
            for k, v in at_path(docs[r.record_id], r.obj_path).items():
                if isinstance(v, (dict, list)) and v and k not in visited:
                    assert (json.loads(have[k]) if isinstance(have[k], str) else have[k]) == v, (name, r.obj_path, k)
                    seen[name, k] += 1
    assert seen.keys() >= {("p5_ast_relations", "to"), ("p5_ast_nodes", "fields"), ("p5_ast_nodes", "source_span"), ("p5_expressions", "source"), ("p5_expressions", "attributes"), ("p5_statements", "effects")}


def test_payload_beside_rows(spark):
    left = {"k": 1, "arguments": {"name": "only", "value": [{"k": 2}, 7]}}
    expression = {"left": json.dumps(left), "right": [None, {"k": 3}], "value": [4, {"k": 5}], "arguments": [{"name": "a", "value": {"k": 6}}, {"name": "b", "value": 8}, None, {"value": {"k": 9}}], "source": {"lines": [1, 2]}, "odd": "\ud800"}
    text = json.dumps({"root": {"expression": expression, "effects": ["x", None], "then": "no object", "statements": []}})
    got = {r.obj_path: json.loads(r.payload) for r in flatten_json(spark.createDataFrame([(1, text, 1)], "id long, p string, at long"), "id", "p", "at").collect()}
    at = "$.root.expression"
    assert got == {
        "$.root": {"effects": ["x", None], "then": "no object", "statements": []},
        at: {"value": [4, None], "arguments": [{"name": "a"}, {"name": "b", "value": 8}, None, None], "source": {"lines": [1, 2]}, "odd": "\ud800"},
        f"{at}.left": {"k": 1, "arguments": {"name": "only", "value": [None, 7]}},
        f"{at}.left.arguments.value[0]": {"k": 2},
        f"{at}.right[1]": {"k": 3}, f"{at}.value[1]": {"k": 5},
        f"{at}.arguments[0].value": {"k": 6}, f"{at}.arguments[3].value": {"k": 9},
    }


def test_beyond_interpreter_limits(spark):
    deep = '{"root": {"kind": "deep", "attributes": ' + '[{"a": ' * 20_000 + "1" + "}]" * 20_000 + ', "then": {"id": 7}}}'
    chain = '{"root": ' + '{"then": ' * 2_000 + '{"effects": ' + "[" * 12_000 + "]" * 12_000 + "}" + "}" * 2_000 + "}"
    digits = "9" * 5_000
    number = '{"root": {"kind": "long", "attributes": ' + digits + "}}"
    rows = [(1, deep, 1), (2, deep[:-1], 1), (3, chain, 1), (4, number, 1)]
    emitted = flatten_json(spark.createDataFrame(rows, "id long, p string, at long"), "id", "p", "at")
    emitted = Staging(spark, "deep").put(emitted)
    got = emitted.groupBy("record_id").count().collect()
    assert {r.record_id: r["count"] for r in got} == {1: 2, 3: 2_001, 4: 1}
    table = {(r.record_id, r.obj_path): r for r in write_tagged(spark, emitted, {"statement": "id int, kind string, attributes string"})["statement"].filter("record_id != 3").collect()}
    assert table[1, "$.root"].kind == "deep" and table[1, "$.root.then"].id == 7 and table[4, "$.root"].kind == "long"
    assert table[4, "$.root"].attributes == digits and table[1, "$.root"].attributes == '[{"a":' * 20_000 + "1" + "}]" * 20_000


def test_structs_without_time(spark):
    rows = [(1, [("a",)], None), (1, [("b",)], None), (2, [("old",)], None), (2, [("new",)], 1), (3, [("c",)], 1), (3, None, 2)]
    df = spark.createDataFrame(rows, "id long, files array<struct<x:string>>, at long")
    assert {(r.record_id, r.payload) for r in flatten_structs(df, "id", "files", "at", "file").collect()} == {(1, '{"x":"b"}'), (2, '{"x":"new"}')}


def _put(root: dict, path: str, value) -> None:
    """Sets the value at a path, making lists and objects on the way."""
    steps = [int(x[1:-1]) if x[0] == "[" else x for x in re.findall(r"\[\d+\]|[^.\[\]]+", path.removeprefix("$."))]
    at = root
    for s, after in zip(steps, [*steps[1:], None]):
        new = value if after is None else ([] if isinstance(after, int) else {})
        if isinstance(at, list):
            at += [None] * (s + 1 - len(at))
            if after is None or at[s] is None:
                at[s] = new
        elif after is None or at.get(s) is None:
            at[s] = new
        at = at[s]


def test_records_are_rebuilt_from_their_rows(spark):
    """Documents put together again from their rows equal what was read but for nulls behind the last object of a list."""
    text = json.dumps({"schema": "s", "origin": {"tool": {"v": [1, None]}}, "universal_ast": {"projection": "p", "nodes": [None, {"id": 1}, 5, {"id": 2, "fields": {}}]}, "trace": {"nodes": {"node_id": "7"}, "ok": True},
        "root": {"kind": "Block", "statements": [None, {"expression": {"left": {"text": "1"}, "arguments": [{"name": "a", "value": {"k": 1}}, {"value": 3}]}, "effects": ["e"]}]}})
    df = spark.createDataFrame([(1, text, 1), (2, "[1]", 1), (3, "{", 1)], "id long, p string, at long")
    rows = flatten_json(df, "id", "p", "at", top_tag="document").collect()
    assert {r.record_id for r in rows} == {1}
    built: dict = {}
    for r in sorted(rows, key=lambda r: (r.obj_path != "$", r.obj_path.count(".") + r.obj_path.count("["), r.obj_path)):
        if r.obj_path == "$":
            assert r.parent_path is None
            built = json.loads(r.payload)
        else:
            _put(built, r.obj_path, json.loads(r.payload))
    assert built == json.loads(text)


def test_structs_with_their_record(spark):
    rows = [(1, "a", [("x",), None, ("y",)], 1), (2, "b", None, 1), (3, None, [], None), (None, "z", [("q",)], 1)]
    df = spark.createDataFrame(rows, "id long, name string, files array<struct<x:string>>, at long")
    got = {(r.table_tag, r.record_id, r.obj_path, r.parent_path): r.payload for r in flatten_structs(df, "id", "files", "at", "file", top_tag="record").collect()}
    assert got.keys() == {("record", i, "$", None) for i in (1, 2, 3)} | {("file", 1, "$.files[0]", "$"), ("file", 1, "$.files[2]", "$")}
    assert json.loads(got["record", 1, "$", None]) == {"name": "a", "at": 1} and got["file", 1, "$.files[2]", "$"] == '{"x":"y"}'
