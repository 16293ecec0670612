"""Packing: every item once, no container too full, little space left; plans by hand."""

from __future__ import annotations

import random

import pytest

from weftline.llm.packing import fill_report, pack, plan, upper_bounds


def run(spark, sizes, specs, **kw):
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n long").selectExpr("*", "'x' AS slot", "1 AS bound")
    spec = spark.createDataFrame(specs, "pid int, cap long, j int")
    out = pack(items, "id", "n", spec, pack_id="pid", capacity="cap", joint="j", **kw)
    return out, spec


def test_packing(spark):
    r = random.Random(9)
    sizes = [int(r.lognormvariate(5, 1)) for _ in range(3000)] + [0, 0, None, 256, 257, 512, 10_000] + [200] * 1500
    specs = [(1, 256, 0), (2, 512, 1), (3, 1024, 2)]
    out, spec = run(spark, sizes, specs, slices=5)
    rows = out.collect()
    for pid, cap, j in specs:
        own = [x for x in rows if x.pack_id == pid]
        back, bins = {}, {}
        for x in own:
            back.setdefault(x.item, []).append((x.piece, x.piece_tokens))
            if x.container_id is None:
                assert x.piece_tokens == 0
            else:
                bins.setdefault(x.container_id, []).append((x.slot, x.piece_tokens))
        assert set(back) == set(range(len(sizes)))
        for i, n in enumerate(sizes):
            p = sorted(back[i])
            assert sum(t for _, t in p) == (n or 0) and [k for k, _ in p] == list(range(1, len(p) + 1))
            assert len(p) == 1 if (n or 0) <= cap else all(t == cap for _, t in p[:-1])
        for b in bins.values():
            assert sum(t for _, t in b) + j * (len(b) - 1) <= cap and len({s for s, _ in b}) == len(b)
        assert sum(n or 0 for n in sizes) / (cap * len(bins)) > 0.9
    rep = {x.pack_id: x for x in fill_report(out, spec, "pid", "cap", "j").collect()}
    assert all(x.n_overfull == 0 for x in rep.values())


def test_plan_uses_everything_within_the_room():
    r = random.Random(1)
    bounds = upper_bounds(1000)
    counts = {b: r.randrange(0, 500) for b in bounds}
    used: dict[int, int] = {}
    for repeat, use in plan(counts, 1000):
        assert repeat > 0 and sum(b * k for b, k in use) <= 1000
        for b, k in use:
            used[b] = used.get(b, 0) + repeat * k
    assert used == {b: n for b, n in counts.items() if n}
    assert bounds[-1] == 1000 and bounds[0] == 1 and bounds == sorted(set(bounds))


def test_empty_and_bad_capacity(spark):
    assert run(spark, [], [(1, 10, 0)])[0].collect() == []
    with pytest.raises(ValueError, match="positive"):
        run(spark, [1], [(1, 0, 0)])


def test_containers_do_not_depend_on_the_session(spark):
    """The same items give the same containers under 4 and 200 shuffle partitions."""
    r = random.Random(3)
    sizes = [int(r.lognormvariate(4, 1)) for _ in range(2000)]
    found = []
    for parts in ("4", "200"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out, _ = run(spark, sizes, [(1, 256, 1)])
        found.append({(x["item"], x.piece, x.container_id, x.slot) for x in out.collect()})
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
