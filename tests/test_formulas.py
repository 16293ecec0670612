"""Formulas, registries, arguments, timeouts, comments by language, flow and rewriting on small cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import formulas
from weftline.functions import vector as V
from weftline.functions.lexer import lex
from weftline.operators import fixpoint as G
from weftline.operators import matrix as M
from weftline.operators import relational as R


def test_formulas_are_read():
    n = formulas.read(" DIV( SUM($0) , LENGTH($0)) ")
    assert (n.name, [a.name for a in n.args], n.args[0].args[0].slot) == ("DIV", ["SUM", "LENGTH"], 0)
    assert formulas.read("CONST(-2.5)").args[0].number == -2.5 and formulas.read("NOW()").args == ()
    for broken in ("", "ADD($0", "ADD($0,)", "ADD($0,,$1)", "ADD $0", "$0 $1", ")", "ADD($0,$1))", "A;B"):
        with pytest.raises(ValueError):
            formulas.read(broken)


def test_unknown_primitives_are_refused(spark):
    for text in ("NOPE($0)", "ADD($0)", "ADD($0,$3)"):
        with pytest.raises(ValueError):
            formulas.build(formulas.read(text), [F.lit(1.0)])
    f = V.Formula("SCALE", "a, k=2", "a * k")
    df = spark.createDataFrame([(3.0, 9.0)], "x double, a double")
    assert f.apply(df, "y", F.col("x")).first().y == 6.0 and f.apply(df, "y", F.col("x"), k=F.lit(5)).first().y == 15.0
    with pytest.raises(TypeError):
        f.apply(df, "y")
    with pytest.raises(TypeError):
        f.apply(df, "y", F.col("x"), z=F.lit(1))


def test_comments_by_language():
    text = "#include <a>\nx // y # z\n"
    kinds = lambda g: [k for k, *_ in lex(text, g)]
    assert kinds("c")[:2] == ["operator", "identifier"] and kinds("c")[-1] == "comment"
    assert kinds("python")[0] == "comment" and kinds(None)[0] == "comment"


def test_timeouts(spark):
    def work(t):
        if t == "slow":
            time.sleep(5)
        if t is None:
            raise ValueError("none")
        return t.upper()

    df = spark.createDataFrame([(1, "a"), (2, "slow"), (3, None), (4, "b")], "k int, t string")
    got = {tuple(r) for r in R.with_timeout(df, "k", "t", work, 0.2).collect()}
    assert got == {(1, "OK", "A"), (2, "TIMEOUT", None), (3, "ERROR", "none"), (4, "OK", "B")}
    assert R.with_timeout(df.limit(0), "k", "t", work, 0.2).collect() == []


def test_arguments_bind_by_name_and_place(spark):
    a = spark.createDataFrame([("c1", "f", "x1", 0, None), ("c1", "f", "x2", 1, "b"), ("c2", "f", "y1", 0, None), ("c2", "f", "y2", 1, "a"), ("c2", "f", "y3", 9, None), ("c3", "g", "z", 0, None)], "call string, callee string, argument string, place int, name string")
    p = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b")], "callee string, place int, parameter string")
    bound, faults = R.bind_arguments(a, p)
    assert {tuple(r) for r in bound.collect()} == {("c1", "a", "x1"), ("c1", "b", "x2")}
    assert {tuple(r) for r in faults.collect()} == {("c2", "y1", "duplicate"), ("c2", "y2", "duplicate"), ("c2", "y3", "unknown"), ("c3", "z", "unknown")}


def test_definite_assignment_over_a_loop(spark):
    """e -> a -> b -> a, e -> c -> b; only a assigns v, so b may be reached without it by c."""
    flow = spark.createDataFrame([("e", "a"), ("a", "b"), ("b", "a"), ("e", "c"), ("c", "b")], "src string, dst string")
    got = G.maybe_unassigned(flow, spark.createDataFrame([("e",)], "node string"), spark.createDataFrame([("a", "v")], "node string, variable string"), spark.createDataFrame([("v",)], "variable string"))
    assert {r.node for r in got.collect()} == {"e", "a", "b", "c"}
    alone = flow.filter("src <> 'c' AND dst <> 'c'")
    got = G.maybe_unassigned(alone, spark.createDataFrame([("e",)], "node string"), spark.createDataFrame([("a", "v")], "node string, variable string"), spark.createDataFrame([("v",)], "variable string"))
    assert {r.node for r in got.collect()} == {"e", "a"}


def test_derivations_rounds_and_witnesses(spark):
    rules = spark.createDataFrame([("r1", "c", "a"), ("r1", "c", "b"), ("r2", "d", "c"), ("r0", "d", "x"), ("r3", "c", "a"), ("r4", "z", None), ("r5", "q", "q")], "rule string, head string, body string")
    log: list = []
    got = {tuple(r) for r in G.horn_proofs(rules, spark.createDataFrame([("a",), ("b",)], "fact string"), log).collect()}
    assert got == {("a", 0, None), ("b", 0, None), ("z", 1, "r4"), ("c", 1, "r1"), ("d", 2, "r2")}
    assert [n for _, _, n in log] == [3, 1, 1, 0]
    assert {r.reason for r in G.horn_blocked(rules, G.horn_closure(rules, spark.createDataFrame([("a",), ("b",)], "fact string"))).collect()} == {"missing dependency: q"}


def test_rewriting_ends_on_cycles(spark):
    r = spark.createDataFrame([("1", "a", "b"), ("2", "b", "a"), ("3", "b", "c"), ("0", "b", "c")], "rule string, before string, after string")
    one = lambda x, c: spark.createDataFrame([(x,)], f"{c} string")
    assert [tuple(x) for x in G.rewrite_chains(one("a", "term"), r, one("c", "goal"), 9).collect()] == [("a", "c", 2, "1>0")]
    assert G.rewrite_chains(one("a", "term"), r, one("c", "goal"), 1).collect() == []


def test_refinement_tells_repeats_apart(spark):
    n = spark.createDataFrame([(1, "p"), (2, "p"), (3, "x"), (4, "x"), (5, "y"), (6, "y")], "node int, k string")
    e = spark.createDataFrame([(1, 0, 3), (1, 0, 4), (2, 0, 5), (2, 0, 6)], "src int, ordinal int, dst int")
    got = {r.node: r.class_id for r in G.refine(n, e, "k").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def test_shapes_and_keys_are_checked(spark):
    m = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, v double")
    assert M.grow(m, (1, 1), (2, 1)) is m
    with pytest.raises(ValueError):
        M.grow(m, (2, 2), (1, 2))
    v = spark.createDataFrame([(1, "k", 1.0), (1, "k", 2.0)], "i int, k string, v double")
    with pytest.raises(Exception, match="twice"):
        M.project_checked(v, spark.createDataFrame([("k", "j", 1.0)], "k string, j string, v double"))[0].collect()


def test_runs_are_joined_over_ranges(spark):
    """One key with most rows, cut into several ranges; runs are those of a plain walk."""
    places = sorted({k for k in range(4000) if k % 13 and k % 401})
    df = spark.createDataFrame([("hot", k) for k in places] + [("hot", 5), ("b", 7), ("b", 9), ("b", None)], "k string, x int")
    want, start = set(), None
    for a, b in zip([None, *places], [*places, None]):
        if a is None or b is None or b != a + 1:
            if a is not None:
                want.add(("hot", start, a))
            start = b
    assert {tuple(r) for r in R.islands(df, ["k"], "x").collect()} == want | {("b", 7, 7), ("b", 9, 9)}
    assert R.islands(df.limit(0), ["k"], "x").collect() == []


def test_containment_by_the_rarest_item(spark):
    need = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z"), (3, "a"), (4, None), (1, "b")], "n int, item string")
    have = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("x", "a"), ("w", None)], "h string, item string")
    got = {tuple(r) for r in R.containment_join(need.filter("item IS NOT NULL"), have, "n", "h", "item").collect()}
    assert got == {(1, "x"), (2, "x"), (2, "y")}
