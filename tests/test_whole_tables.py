"""Self-joins that no filter narrows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_every_package_enters(spark):
    t = pq.read_table(SF / "semantic_package_file.parquet", columns=["package_name", "lang_id"]).to_pylist()
    langs: dict[str, set] = {}
    for r in t:
        if r["package_name"] is not None and r["lang_id"] is not None:
            langs.setdefault(r["package_name"], set()).add(r["lang_id"])
    got = {(r.a, r.b): r.relation for r in entry.queries()["vector_relations_packages"](spark, str(SF)).collect()}
    assert got == {(a, b): "EXACT" if x == y else "IMPLICATION" for a, x in langs.items() for b, y in langs.items() if a < b and (x <= y or y <= x)}
    closed = {r.a: r.intent.split(";") for r in entry.queries()["concept_closure_packages"](spark, str(SF)).collect()}
    assert closed == {a: sorted(b for b, y in langs.items() if x <= y) for a, x in langs.items()}


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_walks_of_two_edges(spark):
    def column(name: str, key: str, value: str) -> list:
        return [(r[key], r[value]) for r in pq.read_table(SF / f"{name}.parquet", columns=[key, value]).to_pylist()]

    buyer, seller, order = dict(column("customer", "c_custkey", "c_nationkey")), dict(column("supplier", "s_suppkey", "s_nationkey")), dict(column("orders", "o_orderkey", "o_custkey"))
    edge = Counter((buyer[order[o]], seller[s]) for o, s in column("lineitem", "l_orderkey", "l_suppkey"))
    want = Counter()
    for (i, k), v in edge.items():
        for (k2, j), w in edge.items():
            if k == k2:
                want[i, j] += v * w
    got = {(r.i, r.j): r.v for r in entry.queries()["two_hop_walk_counts"](spark, str(SF)).collect()}
    assert got == want and any(i == j for i, j in got)
