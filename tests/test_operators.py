"""Relational, matrix, fixpoint, mining and capability operators on small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.operators import capability as C
from weftline.operators import fixpoint as G
from weftline.operators import matrix as M
from weftline.operators import mining as X
from weftline.operators import relational as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_closure_reach_cycles(spark):
    r = random.Random(714)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(20)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    c = G.transitive_closure(e)
    assert set(rows(c)) == want
    assert {x for (x,) in rows(G.cycles(c))} == {a for a, b in want if a == b}
    root = spark.createDataFrame([(0,)], "node int")
    dist, frontier, k = {0: 0}, {0}, 0
    while frontier:
        k += 1
        frontier = {b for a, b in edges if a in frontier} - dist.keys()
        dist |= dict.fromkeys(frontier, k)
    assert dict(rows(G.reachable(e, root))) == dist
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert dict(rows(G.reachable(chain, root))) == {i: i for i in range(41)}


def test_horn_and_levels(spark):
    rules = spark.createDataFrame([("r1", "c", "a"), ("r1", "c", "b"), ("r2", "d", "c"), ("r3", "d", "a"), ("r4", "x", "y"), ("r5", "y", "x"), ("r6", "free", None)], "rule string, head string, body string")
    facts = spark.createDataFrame([("a",), ("b",)], "fact string")
    assert dict(rows(G.horn_closure(rules, facts))) == {"a": 0, "b": 0, "c": 1, "d": 1, "free": 1}
    e = spark.createDataFrame([("m", "n"), ("n", "o"), ("p", "p")], "src string, dst string")
    nodes = spark.createDataFrame([("m",), ("n",), ("o",), ("p",)], "node string")
    assert dict(rows(G.levels(e, nodes))) == {"o": 0, "n": 1, "m": 2}
    assert rows(G.propagate(e, spark.createDataFrame([("o",)], "node string"))) == [("m",), ("n",), ("o",)]


def test_refine(spark):
    nodes = spark.createDataFrame([(1, "f"), (2, "f"), (3, "x"), (4, "x"), (5, "f"), (6, "y")], "node int, kind string")
    edges = spark.createDataFrame([(1, 0, 3), (2, 0, 4), (5, 0, 6)], "src int, ordinal int, dst int")
    got = dict(rows(G.refine(nodes, edges, "kind")))
    assert got[1] == got[2] != got[5] and got[3] == got[4] != got[6]


def test_matrix(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 1, 2.0)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "i int, j int, v double")
    assert rows(M.multiply(a, b)) == [(1, 0, 2.0)]
    bad = spark.createDataFrame([(0, 0, 0.0), (5, 0, 1.0), (1, 1, 1.0), (1, 1, 1.0)], "i int, j int, v double")
    assert rows(M.validate_coo(bad, 3, 3)) == [(0, 0, "zero"), (1, 1, "duplicate"), (5, 0, "out_of_range")]
    assert rows(M.argmax_class(spark.createDataFrame([("p", "a", 1.0), ("p", "b", 1.0), ("q", "a", 0.0)], "i string, j string, v double"), "none")) == [("p", "a"), ("q", "none")]
    need = spark.createDataFrame([("n", "f"), ("n", "g")], "need string, feature string")
    sup = spark.createDataFrame([("t", "f", True), ("u", "f", True), ("u", "g", True), ("w", "f", False)], "target string, feature string, supported boolean")
    plan = M.plan_targets(need, sup, sup.select("target"))
    assert rows(plan) == [("n", "t", 1, 0, 1), ("n", "u", 2, 0, 0), ("n", "w", 0, 1, 1)] and rows(M.eligible(plan)) == [("n", "u")]
    assert rows(M.demand_gate(need, sup, sup.select("target"))) == [("n", "t", "", "g"), ("n", "w", "f", "g")]


def test_relational(spark):
    df = spark.createDataFrame([("h", 2, "S:2"), ("h", 1, "S:1"), (None, 3, "S:3"), ("k", 4, "S:4")], "h string, id int, origin string")
    assert rows(R.dedup_with_provenance(df, "h", "id", F.col("origin")).select("h", "id", "provenance", "n_members")) == [("h", 1, "S:1|S:2", 2), ("k", 4, "S:4", 1), (None, 3, "S:3", 1)]
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert rows(R.compare_status(left, right, ["k"], "v")) == [(1, "MISSING"), (2, "CONFLICT"), (3, "NEW")]
    seq = spark.createDataFrame([("u", i, c) for i, c in enumerate([4.0, 4.0, 4.0, 9.0, 1.0])], "k string, i int, c double")
    assert rows(R.greedy_units(seq, "k", ["i"], "c", 10.0, 4)) == [("u", 1, 2, 8.0), ("u", 2, 1, 4.0), ("u", 3, 2, 10.0)]
    assert rows(R.islands(spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 7)], "k string, p int"), ["k"], "p")) == [("a", 1, 3), ("a", 7, 7)]
    pts, rg = spark.createDataFrame([(5,), (10,), (99,)], "p int"), spark.createDataFrame([(0, 10, "a"), (10, 50, "b"), (7, 7, "none")], "lo int, hi int, name string")
    assert set(rows(R.range_join(pts, "p", rg, "lo", "hi", 8.0).select("p", "name"))) == {(5, "a"), (10, "b")}
    z = spark.range(1).select(R.wilson_lower(F.lit(0), F.lit(0)), R.wilson_lower(F.lit(9), F.lit(10)), R.ratio(F.lit(1), F.lit(0))).first()
    assert z[0] == 0.0 and abs(z[1] - 0.5958) < 1e-3 and z[2] == 0.0


def test_mining_and_capability(spark):
    f = spark.createDataFrame([(c, x) for c, xs in {1: "ab", 2: "ab", 3: "abc", 4: "b"}.items() for x in xs], "case_id int, fact string")
    assert ("a", "b", 3, 3, 100, 0) in rows(X.rules_one(f))
    basis = X.rule_basis(X.rules_one(f))
    assert rows(basis.select("antecedent", "consequent")) == [("a", "b")]
    assert X.greedy_cover(spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d")], "o int, a string"), "o", "a").orderBy("o").collect() == [(1, 2, 1), (2, 1, 2), (3, 1, 1)]
    t = spark.createDataFrame([("f", "go", "PRESENT", "r"), ("f", "go", "ABSENT", "s"), ("g", "go", "odd", "")], "feature string, target string, status string, reason string")
    assert rows(C.combine_evidence(t, ["feature", "target"]).select("feature", "status")) == [("f", "PRESENT"), ("g", "UNRESOLVED")]
    assert rows(C.matrix(t.limit(1), ["f", "z"], ["go"]).select("feature", "status")) == [("f", "PRESENT"), ("z", "UNKNOWN")]
    assert rows(C.preferred_route(spark.createDataFrame([("k", "RUNTIME"), ("k", "HELPER"), ("m", "odd")], "k string, mode string"), ["k"])) == [("k", "HELPER"), ("m", "ERROR")]
