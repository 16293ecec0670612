"""Queries against their SQL on the smallest tables; structure of the registry."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
#: Deep recursions take long here; the driver compares them.
SLOW = {"reach_roots", "unknown_propagation", "transitive_closure", "graph_cycles", "reach_count_order", "stream_counts", "stream_dedup", "iteration_log", "definite_assignment"}


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted([tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()], key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found"])
def test_found_columns(spark, name):
    want = {
        "p2_found": "trace_id bigint, node_id bigint, root_node_id bigint, node_depth int", "p3_found": "src_table string, src_id bigint, field_name string, ref_key string, ref_period string",
        "p4_found": "src_table string, row_id bigint, field_name string, pos int, item string", "p5_found": "src_table string, record_id bigint, obj_path string, parent_path string",
    }
    df = entry.queries()[name](spark, str(SF))
    assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == want[name]
    assert df.count() == df.distinct().count() > 0
