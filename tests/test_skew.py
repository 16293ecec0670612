"""Operators on tables of which one key holds a third of all rows, against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftline.operators import matrix as M
from weftline.operators import mining as X
from weftline.operators import relational as R


@pytest.fixture(scope="module")
def pairs():
    """(case, item): case 0 holds a third."""
    r = random.Random(4)
    hot = [(0, f"i{k}") for k in range(60)]
    rest = [(1 + r.randrange(30), f"i{r.randrange(60)}") for _ in range(120)]
    return hot + rest + rest[:9]


@pytest.fixture(scope="module")
def facts(pairs):
    return defaultdict(set, {c: {i for d, i in pairs if d == c} for c, _ in pairs})


def test_cooccurrence_and_gram(spark, pairs, facts):
    df = spark.createDataFrame(pairs, "c int, i string").selectExpr("*", "'x' AS a", "1 AS case")
    want = Counter(p for s in facts.values() for p in combinations(sorted(s), 2))
    assert {(r.a, r.b): r.n_both for r in R.cooccurrence(df, "c", "i").collect()} == want
    g = {(r.i, r.j): r.v for r in M.gram(M.from_pairs(df, "i", "c")).collect()}
    assert {k: v for k, v in g.items() if k[0] < k[1]} == want and all(g[j, i] == v for (i, j), v in g.items())
    assert all(g[i, i] == sum(i in s for s in facts.values()) for i in {i for _, i in pairs})


def test_rules(spark, pairs, facts):
    df = spark.createDataFrame(pairs, "case_id int, fact string").distinct()
    n = Counter(i for s in facts.values() for i in s)
    both = Counter(p for s in facts.values() for a, b in combinations(s, 2) for p in ((a, b), (b, a)))
    got = {(r.antecedent, r.consequent): (r.support, r.joint) for r in X.rules_one(df).collect()}
    assert got == {(a, b): (n[a], k) for (a, b), k in both.items() if k >= 2 and n[a] >= 2}
    few = df.filter("fact < 'i2'")
    two = Counter(p for s in facts.values() for p in combinations(sorted(i for i in s if i < "i2"), 2))
    three = Counter((*p, z) for s in facts.values() for p in combinations(sorted(i for i in s if i < "i2"), 2) for z in s if z < "i2" and z not in p)
    got = {(r.x, r.y, r.z): (r.support, r.joint) for r in X.rules_two(few, 2, 2).collect()}
    assert got == {(x, y, z): (two[x, y], k) for (x, y, z), k in three.items() if k >= 2 and two[x, y] >= 2}


def test_containment_with_an_item_of_everybody(spark):
    r = random.Random(6)
    have = {h: {"all"} | {f"i{r.randrange(9)}" for _ in range(3)} for h in range(60)}
    need = {n: {"all"} | {f"i{r.randrange(9)}" for _ in range(r.randrange(3))} for n in range(40)}
    flat = lambda d: [(k, v) for k, s in d.items() for v in s]
    got = {tuple(x) for x in R.containment_join(spark.createDataFrame(flat(need), "n int, item string"), spark.createDataFrame(flat(have), "h int, item string"), "n", "h", "item").collect()}
    assert got == {(n, h) for n, a in need.items() for h, b in have.items() if a <= b}


def test_ordered_units_of_a_hot_key(spark):
    r = random.Random(7)
    rows = [("hot", k, float(r.randrange(1, 50))) for k in range(300)] + [(f"k{r.randrange(40)}", k, float(r.randrange(1, 50))) for k in range(600)] + [("none", 1, None)]
    want = []
    for key in {k for k, _, _ in rows}:
        unit, n, cost = 0, 0, 0.0
        for _, _, c in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            c = c or 0.0
            if not unit or cost + c > 100 or n >= 7:
                unit, n, cost = unit + 1, 0, 0.0
                want.append(None)
            n, cost = n + 1, cost + c
            want[-1] = (key, unit, n, cost)
    df = spark.createDataFrame(rows, "k string, at int, c double").selectExpr("*", "1 AS unit", "2 AS n_items")
    assert sorted(tuple(x) for x in R.greedy_units(df, "k", ["at"], "c", 100.0, 7).collect()) == sorted(want)
    assert R.greedy_units(df.limit(0), "k", ["at"], "c", 100.0, 7).collect() == []


def test_plans_without_a_grid_of_features(spark, pairs):
    need = spark.createDataFrame(pairs, "need int, feature string")
    sup = [("t1", f"i{k}", k % 3 != 0) for k in range(40)] + [("t2", f"i{k}", None) for k in range(20)] + [("t3", "other", True)]
    support = spark.createDataFrame(sup, "target string, feature string, supported boolean")
    got = {(r.need, r.target): (r.n_supported, r.n_missing, r.n_unknown) for r in M.plan_targets(need, support, support).collect()}
    state = {(t, f): s for t, f, s in sup}
    want = {}
    for c in {c for c, _ in pairs}:
        own = {i for d, i in pairs if d == c}
        for t in ("t1", "t2", "t3"):
            have = Counter(state.get((t, f)) for f in own)
            want[c, t] = (have[True], have[False], have[None])
    assert got == want


def test_origins_of_one_text(spark):
    rows = [(f"h{k % 50 if k % 3 else 'ot'}", k, f"s{k % 4}") for k in range(300)]
    df = spark.createDataFrame(rows, "h string, id int, src string")
    got = {r.h: (r.id, r.n_members, r.provenance) for r in R.dedup_with_provenance(df, "h", "id", F.col("src")).collect()}
    want = {h: (min(i for g, i, _ in rows if g == h), sum(g == h for g, *_ in rows), "|".join(sorted({s for g, _, s in rows if g == h}))) for h, *_ in rows}
    assert got == want
    assert R.origins(df, "h", F.col("id").cast("string")).count() == 300
