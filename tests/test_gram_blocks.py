"""Gram matrices of full columns: no product is shuffled, and blocks give the cells that the join gives."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from weftline.operators import matrix as M


def _plain(cells):
    cols, out = defaultdict(list), defaultdict(float)
    for i, j, v in cells:
        cols[j].append((i, v))
    for c in cols.values():
        for a, va in c:
            for b, vb in c:
                out[a, b] += va * vb
    return {k: v for k, v in out.items() if v != 0}


@pytest.mark.parametrize("block_rows", [1, 7, 4096])
def test_blocks(spark, block_rows):
    """Rows of the same cells and of their own, negative cells that cancel, rows without a shared column, labels as text."""
    r = random.Random(block_rows)
    cells = [(f"s{i}", f"c{j}", 1.0) for i in range(40) for j in range(6)] + [(f"t{i}", f"c{j}", float(r.randrange(-3, 4) or 5)) for i in range(25) for j in r.sample(range(9), 5)]
    cells += [("alone", "x", 2.0), ("u", "c0", 1.0), ("u", "c1", -1.0), ("big", "c2", 1e6), ("half", "c3", 0.5), ("far", "x2", float("inf"))]
    df = spark.createDataFrame([*cells, (None, "c1", 1.0), ("s1", None, 1.0), ("n", "c1", None)], "i string, j string, v double")
    got = M.gram(df, block_rows, 64).collect()
    assert len(got) == len({(x.i, x.j) for x in got}) and {(x.i, x.j): x.v for x in got} == _plain(cells)


@pytest.mark.parametrize("sparse", [False, True])
def test_products(sparse):
    import numpy as np

    r = np.random.default_rng(3)
    rows = lambda n: tuple(np.array(x) for x in zip(*[(i, c, float(r.integers(1, 9))) for i in range(n) for c in r.choice(5000 if sparse else 20, 7, replace=False)], strict=True))
    a, b = rows(30), rows(50)
    full = lambda x, n: np.bincount(x[0] * 5000 + x[1], x[2], n * 5000).reshape(n, 5000)
    assert (M._products(a, b, 30, 50) == full(a, 30) @ full(b, 50).T).all()


def test_full_columns_shuffle_no_products(spark):
    """600 rows by 5 columns: the join meets 900,000 times, the blocks never."""
    df = spark.createDataFrame([(i, j, 1.0) for i in range(600) for j in range(5)], "i int, j int, v double")
    got = M.gram(df)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 360_000 and got.filter("v <> 5").count() == 0
