"""Lexer tables, matches, overrides, covers and bundles on small cases."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import base64
import gzip
import hashlib
import json

import pytest

from weftline.functions import lexer as L
from weftline.operators import mining as X
from weftline.operators import relational as R
from weftline.sources import files as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lexer(spark):
    t = 'if (a1 >= 0x1F) { s = "x\\"}"; // c }\n}'
    got = list(L.lex(t))
    assert [(k, x) for k, x, _, _ in got] == [
        ("identifier", "if"), ("open", "("), ("identifier", "a1"), ("operator", ">"), ("operator", "="), ("number", "0x1F"), ("close", ")"), ("open", "{"), ("identifier", "s"), ("operator", "="),
        ("string", '"x\\"}"'), ("operator", ";"), ("comment", "// c }"), ("close", "}"),
    ]
    assert all(t[o : o + len(x)] == x for _, x, o, _ in got) and got[1][3] == got[6][3] == 0
    assert L.brackets(t)[0] and L.brackets("(]") == (False, []) and L.brackets("([])") == (True, [(0, 3), (1, 2)])
    df = spark.createDataFrame([(1, "f(x)"), (2, None), (3, ""), (4, "((")], "id long, t string")
    assert [r.token for r in L.token_stream(df, "id", "t").filter("id = 1").orderBy("token_offset").collect()] == ["f", "(", "x", ")"]
    assert rows(L.bracket_pairs(df, "id", "t")) == [(1, True, 1, 3), (2, True, None, None), (3, True, None, None), (4, False, None, None)]


def test_json_tables(spark):
    df = spark.createDataFrame([(1, '{"nodeKind": "A", "x": ["b", {"type": "C", "y": "no"}]}'), (2, "{broken"), (3, None)], "id long, t string")
    assert rows(L.harvest_names(df, "id", "t")) == [(1, "A"), (1, "C"), (1, "b")]
    assert {(r.obj_path, tuple(sorted(r.cells.items()))) for r in L.json_tree_rows(df, "id", "t").collect()} == {("$", (("nodeKind", "A"),)), ("$.x[1]", (("type", "C"), ("y", "no")))}


def test_matches(spark):
    ops = spark.createDataFrame([(1, "add", ["r", "m"]), (2, "add", ["r", "r"]), (3, "add", ["r"]), (4, "zzz", ["r"])], "id int, name string, kinds array<string>")
    pats = spark.createDataFrame([("add", ["r", "r"]), ("add", ["any", "m"])], "name string, kinds array<string>")
    assert rows(R.structural_match(ops, pats, "id", "name", "kinds")) == [(1, "conditional", 1), (2, "exact", 1), (3, "unsupported", 0), (4, "no_match", 0)]
    a, b = spark.createDataFrame([(1, "Load the Graph"), (2, "none")], "a int, t string"), spark.createDataFrame([(7, "graph_load, load")], "b int, t string")
    assert rows(R.token_overlap(a, b, "a", "b", "t")) == [(1, 7, 2)]
    w = R.witnessed(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string"), ["k", "v"])
    assert rows(w) == [(1, "x", True), (2, "y", False)]
    assert rows(R.override(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string"), "k", "v")) == [(1, "a"), (2, "z")]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")], "src string, dst string")
    assert rows(R.intermediate_routes(e, spark.createDataFrame([("a", "c"), ("c", "a")], "src string, dst string"))) == [("a", "c", "b")]
    c = spark.createDataFrame([("p1", "f"), ("p2", "g"), ("p3", "h")], "k string, fam string")
    assert rows(R.split_known(c, c.filter("k = 'p1'"), c.filter("k = 'p2'"), "k", "fam")) == [("p1", "EXACT"), ("p2", "PARAMETERISED"), ("p3", "NEW")]


def test_covers(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (4, "c")], "o int, x string")
    assert rows(X.undominated(p, "o", "x")) == [(1,), (4,)]
    assert X.smallest_cover({"p": frozenset("abc"), "q": frozenset("abd"), "r": frozenset("cef"), "s": frozenset("de")}) == ["q", "r"]
    many = {f"s{i:03d}": frozenset({i, i + 1, (7 * i) % 300}) for i in range(300)}
    got = X.smallest_cover({k: v for k, v in many.items() if int(k[1:]) % 2 == 0} | {"all": frozenset(range(302))})
    assert got == ["all"]
    r = random.Random(5)
    for _ in range(20):
        sets = {f"s{i}": frozenset(r.sample(range(9), r.randrange(1, 4))) for i in range(8)}
        every = frozenset().union(*sets.values())
        best = next(n for n in range(1, 9) if any(frozenset().union(*(sets[k] for k in c)) == every for c in combinations(sets, n)))
        got = X.smallest_cover(sets)
        assert len(got) == best and frozenset().union(*(sets[k] for k in got)) == every


def test_rectangle_cover(spark):
    """A staircase of three by three needs a rectangle per step; equal rows add nothing."""
    cells = [("r1", "a"), ("r1", "b"), ("r1", "c"), ("r2", "b"), ("r2", "c"), ("r3", "c"), ("r4", "c"), ("r1", None)]
    got = X.rectangle_cover(spark.createDataFrame(cells, "i string, j string").selectExpr("*", "1 AS x"), "i", "j").collect()
    assert len(got) == 3 and sum(r.n_cells for r in got) >= 6
    assert X.rectangle_cover(spark.createDataFrame([], "i string, j string"), "i", "j").collect() == []


def test_greedy_rounds_equal_one_choice_at_a_time(spark):
    r = random.Random(2)
    pairs = {(r.randrange(40), r.randrange(120)) for _ in range(500)} | {(7, a) for a in range(40)}
    got = X.greedy_cover(spark.createDataFrame(sorted(pairs), "o int, a int"), "o", "a").collect()
    left, want = set(pairs), []
    while left:
        n = Counter(o for o, _ in left)
        o = min(n, key=lambda k: (-n[k], k))
        want.append((o, n[o]))
        gone = {a for k, a in left if k == o}
        left = {p for p in left if p[1] not in gone}
    assert sorted((x.o, x.n_new) for x in got) == sorted(want)


def test_bundles_and_discovery(spark, tmp_path):
    data = b"hello"
    members = [{"path": "m/a.txt", "content": base64.b64encode(data).decode(), "sha256": hashlib.sha256(data).hexdigest()}, {"path": "bad", "content": base64.b64encode(data).decode(), "sha256": "0"}]
    (tmp_path / "x.bundle").write_bytes(base64.b64encode(gzip.compress(json.dumps(members).encode())))
    (tmp_path / "y.bundle").write_bytes(b"no bundle")
    got = S.bundle_members(S.read_folder(spark, str(tmp_path), "*.bundle"))
    assert {(r.member, r.verified) for r in got.collect()} == {("m/a.txt", True), ("bad", False), (None, False)}
    (tmp_path / "a.go").write_text("x")
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(b"a,b"))
    assert {(r.kind, r.language) for r in S.discover(spark, str(tmp_path)).collect()} == {("other", None), ("source", "go"), ("csv", None)}
