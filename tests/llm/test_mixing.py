"""Mixing: shares reached, repeats respected, texts counted once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.llm.mixing import mixer, source_key


def setup(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, source string, h string, n long")
    t = spark.createDataFrame(targets, "mix_id int, source_name string, share double, reps int")
    return mixer(d, t, doc_id="doc_id", source="source", text_hash="h", n_tokens="n", mix_id="mix_id", source_name="source_name", share="share", repeats="reps")


def test_shares_and_repeats(spark):
    r = random.Random(2)
    docs, k = [], 0
    for s, n in (("Big One", 2000), ("big-one ", 1000), ("mid", 600), ("small", 40), (None, 30)):
        for _ in range(n):
            docs.append((k, s, f"t{k if r.random() > 0.2 else k // 7}", int(r.lognormvariate(5, 0.8)) + 1))
            k += 1
    size = {}
    docs = [(i, s, h, size.setdefault(h, n)) for i, s, h, n in docs] + [(k, "mid", "empty", 0)]
    m = setup(spark, docs, [(1, "BIG_ONE", 0.5, 2), (1, "mid", 0.3, 2), (1, "small", 0.2, 3), (2, "big one", 30.0, 1), (2, "nowhere", 10.0, 2), (2, "small", 0.0, 2), (2, "mid", 60.0, 4)])
    c = m.copies()
    rep = {(x.mix_id, x.source_key): x for x in m.report(c).collect()}
    for s, want in (("big_one", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(rep[1, s].reached_share - want) < 0.005
        assert rep[1, s].most_copies <= rep[1, s].max_repeats
    assert abs(rep[2, "mid"].reached_share - 60 / 90) < 0.005 and rep[2, "nowhere"].n_tokens == 0 and rep[2, "small"].n_tokens == 0
    text = {i: h for i, _, h, _ in docs}
    used = {}
    for x in c.collect():
        used.setdefault((x.mix_id, text[x.doc_id]), []).append(x.source_key)
    assert all(len(v) == 1 for v in used.values())


def test_empty_tables(spark):
    m = setup(spark, [], [(1, "a", 1.0, 2)])
    assert m.copies().collect() == [] and m.report(m.copies()).first().reached_share == 0.0
    assert setup(spark, [(1, "a", "h", 5)], []).copies().collect() == []


def test_one_source_takes_all(spark):
    m = setup(spark, [(i, "a", f"h{i}", 10) for i in range(5)], [(1, "A", 3.0, 2)])
    assert {(x.doc_id, x.copies) for x in m.copies().collect()} == {(i, 2) for i in range(5)}


def test_names(spark):
    df = spark.createDataFrame([(" Design-Notes\t",), ("DESIGN  notes",), (" ",), (None,)], "s string").select(source_key(F.col("s")))
    assert [r[0] for r in df.collect()] == ["design_notes", "design_notes", None, None]


def test_small_source_is_repeated_until_no_text_fits(spark):
    """Four texts of which each may be used five times meet their goal but for less than the least usable text."""
    few = [(1, "few", "f1", 5202), (2, "few", "f2", 4400), (3, "few", "f3", 1111), (4, "few", "f4", 1073)]
    many = [(100 + i, "many", f"m{i}", 40 + i % 17) for i in range(2000)]
    m = setup(spark, few + many, [(1, "few", 0.3, 5), (1, "many", 0.7, 1)])
    rows = m.copies().collect()
    goal = m.goal[1, "few"]
    got = sum(x.n_tokens * x.copies for x in rows if x.source_key == "few")
    open_ = [n for i, _, _, n in few if sum(x.copies for x in rows if x.doc_id == i) < 5]
    assert 0 <= goal - got < min(open_, default=1) + 1
    assert max(x.copies for x in rows if x.source_key == "few") <= 5
