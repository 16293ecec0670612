"""Covers of many rounds: few jobs, and the same rows whether rounds are jobs or done in one task."""

from __future__ import annotations

import random

from weftline.operators import mining as X


def test_many_rounds_are_few_jobs(spark):
    """Each object shares an attribute with the next, so that rounds choose one at a time: every other object, as the last covers two as well."""
    pairs = spark.createDataFrame([(o, a) for o in range(121) for a in (o, o + 1)], "o int, a int")
    sc = spark.sparkContext
    sc.setJobGroup("cover", "cover")
    try:
        got = X.greedy_cover(pairs, "o", "a").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in got) == [(o, 2, o // 2 + 1) for o in range(0, 121, 2)]
    assert len(sc.statusTracker().getJobIdsForGroup("cover")) < 60


def test_rounds_in_jobs_and_in_a_task(spark):
    r = random.Random(8)
    pairs = {(f"o{r.randrange(30)}", f"a{r.randrange(50)}") for _ in range(120)} | {("hot", f"a{k}") for k in range(20)} | {(f"p{k}", "shared") for k in range(9)}
    df = spark.createDataFrame([*sorted(pairs), ("o1", None), (None, "a1")], "o string, a string")
    got = [sorted(tuple(x) for x in X.greedy_cover(df, "o", "a", n).collect()) for n in (0, 120, 10**6)]
    assert got[0] == got[1] == got[2] and sum(n for _, n, _ in got[0]) == len({a for _, a in pairs})
    assert X.greedy_cover(df.limit(0), "o", "a").collect() == []
