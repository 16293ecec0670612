"""Nested records against a plain recursive walk."""

from __future__ import annotations

import json

from weftline.operators.nested import flatten_json, flatten_structs, write_tagged

DOC = {
    "universal_ast": json.dumps({"nodes": [{"id": 1}, None, 3, {"id": 2, "nodes": [{"no": 1}]}], "relations": {"kind": "r"}}),
    "trace": {"nodes": [None, {"node_id": "1"}]},
    "root": {
        "kind": "Block",
        "statements": [None, {"kind": "If", "condition": {"left": {"v": 1}, "arguments": [{"value": {"k": 1}}, {"value": 5}, {"name": "x"}]}, "then": {"kind": "A"}, "else": [{"kind": "B"}]}],
        "body": {"expression": '{"value": {"name": "deep"}}'},
        "attributes": {"left": {"not": "this"}},
    },
}
WANT = {
    ("$.universal_ast.nodes[0]", "$"), ("$.universal_ast.nodes[3]", "$"), ("$.universal_ast.relations", "$"), ("$.trace.nodes[1]", "$"), ("$.root", "$"), ("$.root.statements[1]", "$.root"),
    ("$.root.statements[1].condition", "$.root.statements[1]"), ("$.root.statements[1].condition.left", "$.root.statements[1].condition"),
    ("$.root.statements[1].condition.arguments[0].value", "$.root.statements[1].condition"), ("$.root.statements[1].then", "$.root.statements[1]"), ("$.root.statements[1].else[0]", "$.root.statements[1]"),
    ("$.root.body", "$.root"), ("$.root.body.expression", "$.root.body"), ("$.root.body.expression.value", "$.root.body.expression"),
}


def test_visit(spark):
    text = json.dumps(DOC)
    rows = [(1, text, 1), (1, text, 2), (2, text[:-1], 1), (3, None, 1), (4, "", 1), (5, "[1]", 1), (6, json.dumps({"root": None}), 1), (None, text, 1)]
    df = spark.createDataFrame(rows, "id long, p string, at long").selectExpr("*", "'x' AS obj_path", "'y' AS payload")
    got = flatten_json(df.drop("payload"), "id", "p", "at").collect()
    assert {(r.obj_path, r.parent_path) for r in got} == WANT and len(got) == len(WANT) and {r.record_id for r in got} == {1}
    tables = write_tagged(spark, flatten_json(df.drop("payload"), "id", "p", "at"), {"statement": "kind string", "trace_node": "node_id string"})
    assert {r.kind for r in tables["statement"].collect()} == {"Block", "If", "A", "B", None}
    assert [r.node_id for r in tables["trace_node"].collect()] == ["1"]


def test_deep_nesting(spark):
    text = '{"root": ' + '{"kind": "s", "then": ' * 400 + "{}" + "}" * 400 + "}"
    assert flatten_json(spark.createDataFrame([(1, text, 1)], "id long, p string, at long"), "id", "p", "at").count() == 401


def test_structs(spark):
    df = spark.createDataFrame([(1, [("a", 1), None, ("b", None)], 1), (1, [("old", 1)], 0), (2, None, 1), (3, [], 1)], "id long, files array<struct<x:string,y:int>>, at long")
    got = flatten_structs(df, "id", "files", "at", "file").collect()
    assert {(r.record_id, r.obj_path, r.payload) for r in got} == {(1, "$.files[0]", '{"x":"a","y":1}'), (1, "$.files[2]", '{"x":"b"}')}
    assert flatten_structs(df.limit(0), "id", "files", "at", "file").collect() == []
