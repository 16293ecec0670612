"""Blocked heads of Horn rules with their reasons."""

from __future__ import annotations

from weftline.operators.fixpoint import horn_blocked, horn_closure


def test_blocked(spark):
    rules = spark.createDataFrame([("r1", "b", "a"), ("r2", "c", "b"), ("r2", "c", "x"), ("r3", "d", "c"), ("r3", "d", "y"), ("r4", "e", None), ("r5", "b", "z"), ("r6", "p", "q"), ("r7", "q", "p")], "rule string, head string, body string")
    known = horn_closure(rules, spark.createDataFrame([("a",)], "fact string"))
    got = {tuple(r) for r in horn_blocked(rules, known).collect()}
    assert got == {(r, f, f"missing dependency: {b}") for r, f, b in [("r2", "c", "x"), ("r3", "d", "c"), ("r3", "d", "y"), ("r6", "p", "q"), ("r7", "q", "p")]}
