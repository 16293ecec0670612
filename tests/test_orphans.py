"""Orphan references against a plain check of every row."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.orphans import Bitmap, find_orphans, orphan_report


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=300), st.sets(st.integers(0, 200_000), max_size=300), st.booleans())
def test_bitmap_sets(a, b, dense):
    if dense:
        a = a | set(range(1000, 9000))
        b = b | set(range(5000, 12000))
    x, y = (Bitmap.of(np.array(sorted(s), np.int64)) for s in (a, b))
    assert x.and_not(y).places().tolist() == sorted(a - b)
    assert x.and_(y).places().tolist() == sorted(a & b)


@pytest.mark.parametrize(("ended", "per_range"), [(True, 7), (True, 1000), (False, 7)])
def test_against_rows(spark, ended, per_range):
    r = random.Random(3)
    t0 = datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(hours=r.randrange(24 * 200))
    parents = [(k, b, (b + timedelta(days=r.randrange(-5, 90))) if r.random() < 0.6 else None) for k in range(30) for b in [when() for _ in range(r.choice([1, 1, 2]))]] + [(31, None, None), (None, t0, None)]
    parents += [(32, t0, datetime(2024, 3, 1)), (32, datetime(2024, 3, 1), None)]
    refs = [(i, 3 if r.random() < 0.4 else r.randrange(36), when()) for i in range(400)] + [(900, None, t0), (901, 2, None), (902, 77, None), (903, 32, datetime(2024, 3, 1)), (904, 32, datetime(2023, 12, 31))]
    refs += refs[:20]
    p = spark.createDataFrame(parents, "k long, born timestamp_ntz, ended timestamp_ntz")
    f = spark.createDataFrame(refs, "ref long, k long, at timestamp_ntz").selectExpr("*", "'x' AS born", "1 AS kind", "2 AS key")
    got = {(x.ref, x.k) for x in find_orphans(f, p, keys=["k"], ref_at="at", carry=["ref"], born="born", ended="ended" if ended else None, keys_per_range=per_range).collect()}

    def alive(k, t):
        own = [(b, e if ended else None) for kk, b, e in parents if kk == k and not (ended and b and e and e <= b)]
        return bool(own) if t is None else any((b is None or b <= t) and (e is None or t < e) for b, e in own)

    assert got == {(i, k) for i, k, t in refs if k is not None and not alive(k, t)}


def test_empty_sides_and_report(spark):
    p = spark.createDataFrame([], "k string, born timestamp_ntz")
    f = spark.createDataFrame([(1, "a", datetime(2024, 5, 2)), (2, "a", datetime(2024, 5, 9))], "ref long, k string, at timestamp_ntz")
    o = find_orphans(f, p, keys=["k"], ref_at="at", carry=["ref"], born="born")
    assert {(x.ref, x.period) for x in o.collect()} == {(1, 2024 * 12 + 4), (2, 2024 * 12 + 4)}
    assert [x.n_orphans for x in orphan_report(o.selectExpr("'t' AS t", "'k' AS f", "period"), "t", "f", "period").collect()] == [2]
    assert find_orphans(f.limit(0), p, keys=["k"], ref_at="at", carry=["ref"], born="born").collect() == []
