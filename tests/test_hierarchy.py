"""Hierarchies against a plain walk, in one block and by joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.hierarchy import build_hierarchy, descendants, nodes_of, paths
from weftline.session import whole_number


def walk(par: dict) -> dict:
    out = {}
    for v in par:
        seen, u = [], v
        while par[u] in par and u not in seen:
            seen.append(u)
            u = par[u]
        if u in seen:
            ring, x = set(), u
            while x not in ring:
                ring.add(x)
                x = par[x]
            out[v] = (-1, -1 if v in ring else -2)
        else:
            out[v] = (u, len(seen))
    return out


def forest(seed: int) -> list[tuple[int, int, int | None]]:
    r, rows = random.Random(seed), []
    for g in range(12):
        ids = r.sample(range(-5, 400), r.choice([1, 2, 5, 60]))
        for i, v in enumerate(ids):
            k = r.random()
            rows.append((g, v, None if k < 0.1 else r.choice(ids) if k < 0.2 else ids[max(0, i - 1)] if k < 0.5 else r.choice(ids[: i + 1]) if i else 9999))
    return rows


@pytest.fixture(scope="module")
def case():  # noqa: ANN201
    rows = forest(5)
    want = {(g, v): x for g in range(12) for v, x in walk({b: c for a, b, c in rows if a == g}).items()}
    return rows, want


@pytest.mark.parametrize("block", [500_000, 20])
def test_roots_and_depths(spark, case, block):
    rows, want = case
    h = build_hierarchy(spark.createDataFrame(rows, "grp long, node long, parent long"), block).collect()
    assert {(r.grp, r.node): (r.root, r.depth) for r in h} == want
    for r in h:
        assert (r.entry < r.exit) if r.root != -1 or r.entry >= 0 else r.exit == -1


def test_paths_and_descendants(spark, case):
    rows, want = case
    h = build_hierarchy(spark.createDataFrame(rows, "grp long, node long, parent long"))
    par = {(g, v): p for g, v, p in rows}
    expected = {}
    for (g, v), (_, d) in want.items():
        if d >= 0:
            up = [v]
            while len(up) <= d:
                up.append(par[g, up[-1]])
            expected[g, v] = "/".join(map(str, reversed(up)))
    assert {(r.grp, r.node): r.path for r in paths(h).collect()} == expected
    pairs = {(r.grp, r.ancestor, r.node, r.distance) for r in descendants(h).collect()}
    ids = {k: list(map(int, filter(None, p.replace("/-", "/~").replace("~", "-").split("/")))) for k, p in expected.items()}
    assert pairs == {(g, a, v, len(p) - 1 - i) for (g, v), p in ids.items() for i, a in enumerate(p[:-1])}


def test_deep_chain_and_wide_star_by_joins(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(300)]
    star = [(2, i, 0 if i else None) for i in range(300)]
    h = build_hierarchy(spark.createDataFrame(chain + star, "grp long, node long, parent long"), 100)
    got = {(r.grp, r.node): (r.depth, (r.exit - r.entry - 1) // 2) for r in h.collect()}
    assert got == {(1, i): (i, 299 - i) for i in range(300)} | {(2, i): (1 if i else 0, 0 if i else 299) for i in range(300)}


def test_spellings_repeats_nulls_and_extra_columns(spark):
    rows = [(1, " 07\t", "", "a", 1), (1, "7", "-", "b", 2), (1, "8 ", " 007", "a", 1), (1, "9", "x", None, 3), (1, None, "7", "a", 1), (None, "1", None, "a", 1), (1, "5", "5", "a", 1), (1, "6", "5", "a", 1)]
    df = spark.createDataFrame(rows, "trace_id long, node_id string, parent_node_id string, entry string, at int")
    n = nodes_of(df, F.col("trace_id"), whole_number("node_id"), whole_number("parent_node_id"), F.col("at"))
    assert {(r.node, r.root, r.depth) for r in build_hierarchy(n).collect()} == {(7, 7, 0), (8, 7, 1), (9, 9, 0), (5, -1, -1), (6, -1, -2)}


def test_empty(spark):
    e = spark.createDataFrame([], "grp long, node long, parent long")
    assert build_hierarchy(e).collect() == [] and paths(build_hierarchy(e)).collect() == []


@pytest.mark.parametrize("block", [500_000, 3])
def test_any_id(spark, block):
    """Blocks and joins agree on ids up to the ends of 64 bits."""
    big = [2**63 - 1, -(2**63), 2**62, -(2**62), 0, -1]
    rows = [(1, big[0], None), *((1, v, u) for u, v in zip(big, big[1:])), (1, 5, 6), (1, 6, 5), (1, 7, 5), (1, 8, 999)]
    h = build_hierarchy(spark.createDataFrame(rows, "grp long, node long, parent long"), block).collect()
    got = {r.node: (r.parent, r.root, r.depth) for r in h}
    want = {v: (big[k - 1] if k else None, big[0], k) for k, v in enumerate(big)}
    assert got == want | {5: (6, -1, -1), 6: (5, -1, -1), 7: (5, -1, -2), 8: (None, 8, 0)}
