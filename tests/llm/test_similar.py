"""Similar sets against all pairs of a small case."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from weftline.llm.similar import ENTRY, Near, SimilarSets, _block_pairs, _meet, _multipliers, minhash_bits, radius_for, segments_for, sets_of


def made(seed: int) -> list[tuple[int, list | None, list | None, int]]:
    r = random.Random(seed)
    hot = [f"h{i}" for i in range(6)]
    rows, k = [], 0
    for _ in range(60):
        base = [f"v{r.randrange(10**6)}" for _ in range(r.choice([2, 3, 5, 12, 40]))] + r.sample(hot, r.randrange(0, 4))
        for _ in range(r.choice([1, 1, 2, 5])):
            s = [x for x in base if r.random() > 0.12] + [f"n{r.randrange(10**6)}" for _ in range(r.randrange(0, 3))]
            rows.append((k, s + r.choices(s or ["a"], k=2) + [None, " ", f" {s[0]} " if s else ""], r.choice([None, [], ["a", "b", "c"], hot[:4], hot[:4] + [f"u{k}"]]), 1))
            k += 1
    return rows


def test_all_pairs(spark):
    rows = made(4)
    again = [(i, list(reversed(a)), b, 2) for i, a, b, _ in rows[:10]] + [(0, ["only", "the", "latest", "counts"], None, 3), (None, ["a", "b", "c"], None, 1)]
    df = spark.createDataFrame(rows + again, "id long, x array<string>, y array<string>, at int").selectExpr("*", "1 AS cls", "'z' AS field")
    got = SimilarSets(sets_of(df, "id", ["x", "y"], "at")).record_pairs().collect()
    last = {}
    for i, a, b, t in sorted([r for r in rows + again if r[0] is not None], key=lambda r: r[3]):
        last[i] = (a, b)
    want = set()
    for f, name in enumerate(("x", "y")):
        sets = {i: {v.strip() for v in (ab[f] or []) if v and v.strip()} for i, ab in last.items()}
        want |= {(name, a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3 and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    found = [(r.field, r.record_a, r.record_b) for r in got]
    assert len(found) == len(set(found))
    assert not set(found) - want
    assert len(set(found) & want) >= 0.99 * len(want)


def test_hot_group_of_copies(spark):
    """A third of all records share one set: every pair once, none among the rest."""
    rows = [(i, ["p", "q", "r", "s"], 1) for i in range(60)] + [(100 + i, [f"a{i}", f"b{i}", f"c{i}"], 1) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x array<string>, at int")
    s = SimilarSets(sets_of(df, "id", ["x"], "at"))
    assert s.record_pairs().count() == 60 * 59 // 2
    assert {(r.record, r.class_id, r.n_links) for r in s.classes().collect()} == {(i, 0 if i < 60 else i, 0) for i in [*range(60), *range(100, 220)]}


def test_classes_and_representatives(spark):
    """Copies are one class; links are counted between classes."""
    a, b, c = ["p", "q", "r", "s", "t"], ["p", "q", "r", "s"], ["x", "y", "z"]
    df = spark.createDataFrame([(1, a, 1), (2, a, 1), (3, b, 1), (4, b[::-1], 1), (5, c, 1), (6, ["x"], 1)], "id long, x array<string>, at int")
    s = SimilarSets(sets_of(df, "id", ["x"], "at"))
    assert {(r.record, r.class_id, r.n_links) for r in s.classes().collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0)}
    assert [(r.field, r.a, r.b) for r in s.representative_pairs().collect()] == [("x", 1, 3)]


def test_hot_segments_as_block_pairs():
    """Cores that agree in a hot segment are compared in blocks: the same pairs as in one piece."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    entry = np.zeros(57, ENTRY)
    entry["c1"], entry["size"] = r.permutation(57), 5
    entry["code"] = r.integers(0, 4, 57).astype(np.uint64)
    t = pa.table({"part": pa.array([0], pa.int32()), "width": pa.array([1], pa.int32()), "cores": [entry.tobytes()], "keys": [np.zeros((57, 1), np.uint32).tobytes()]})
    near = Near(3, 5, 1)
    pairs = lambda x: {(a, b) for a, b, w in zip(x["a1"].to_pylist(), x["b1"].to_pylist(), x["x"].to_pylist()) if w is None}
    whole, cut = _meet(near)(t), _meet(near, hot=10)(t)
    assert pairs(cut) == set() and len(pairs(whole)) > 100
    blocks = cut.filter(pa.compute.is_valid(cut["x"]))
    assert pairs(pa.Table.from_batches(_block_pairs(near)(blocks.to_batches()))) == pairs(whole)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, x array<string>, at int")
    assert SimilarSets(sets_of(df, "id", ["x"], "at")).record_pairs().collect() == []


def test_bits_agree_as_often_as_they_should():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 100, dtype=np.uint64)
    b = np.r_[a[:75], r.integers(0, 2**63, 25, dtype=np.uint64)]
    bits = minhash_bits(np.r_[a, b], np.array([0, 100]), *_multipliers(4096, 1))
    assert abs((bits[0] == bits[1]).mean() - (1 + 75 / 125) / 2) < 0.03
    assert abs(bits.mean() - 0.5) < 0.05


@pytest.mark.parametrize("n", [10, 10_000, 10**7])
def test_calibration(n):
    b, m = segments_for(n, 3, 5, 0.002)
    assert (1 - 0.8**b) ** m <= 0.002
    assert radius_for(64, 3, 5, 0.002) >= 22
