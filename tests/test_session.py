"""Shared folder, staged tables and shuffle files."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

import __spark_entry__
from weftline.operators.relational import merge_graphs, pairs_within
from weftline.session import Staging, release_staged, shared_dir


def test_no_local_folder_on_a_cluster():
    sc = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(SimpleNamespace(sparkContext=sc))
    sc.getConf = lambda: {"spark.checkpoint.dir": "/shared/"}
    assert shared_dir(SimpleNamespace(sparkContext=sc)) == "/shared"


def test_released_results_leave_nothing(spark):
    release_staged(spark)
    before = set(os.listdir(shared_dir(spark)))
    for name in ("p3_found", "reach_count_order"):
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert set(os.listdir(shared_dir(spark))) - before
    release_staged(spark)
    assert set(os.listdir(shared_dir(spark))) <= before


def test_superseded_tables_are_dropped(spark):
    st = Staging(spark, "t")
    a = st.put(spark.range(3).toDF("x"))
    b = st.put(a)
    st.drop(a)
    assert b.count() == 3 and os.listdir(st.root) == ["t2"]
    st.close()


def test_a_broken_subpackage_is_no_missing_one(monkeypatch):
    import builtins

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "weftline.llm":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_merge_graphs_counts_id_zero(spark):
    one = (spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(0, 0)], "src long, dst long"))
    none = (spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long"))
    two = (spark.createDataFrame([(0,), (1,)], "id long"), spark.createDataFrame([(0, 1)], "src long, dst long"))
    n, e = merge_graphs([one, none, two])
    assert sorted(r.id for r in n.collect()) == [0, 1, 2]
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 0), (1, 2)]


def test_pairs_within_cuts_hot_groups(spark):
    rows = [("hot", i) for i in range(90)] + [("hot", 5), ("few", 1), ("few", 2), ("one", 1), (None, 3), ("few", None)]
    df = spark.createDataFrame(rows, "k string, v long").selectExpr("*", "1 AS v_a")
    got = pairs_within(df, ["k"], "v", block=7).collect()
    want = {("hot", a, b) for a in range(90) for b in range(a + 1, 90)} | {("few", 1, 2)}
    assert len(got) == len(want) and {(r.k, r.v_a, r.v_b) for r in got} == want
    assert pairs_within(df.limit(0), ["k"], "v").count() == 0
