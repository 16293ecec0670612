"""Packed fields: dialects, and round trips of lists written in every dialect."""

from __future__ import annotations

import random

from weftline.operators.packed import Code, Dialect, learn_code, parse, parses, split_packed


def test_parses_by_hand():
    first = lambda t, a=False: parses(t, a)[0][1]
    assert first("E1;\nE2 ; e3", True) == ["E1", "E2", "e3"]
    assert first("E1 E2  E3", True) == ["E1", "E2", "E3"]
    assert first('a, "the ""b"" c";\nd|e f,\'g, h\'') == ["a", 'the "b" c', "d", "e f", "g, h"]
    assert first('["a, b", "c"]') == ["a, b", "c"]
    assert first("[]") == [] and first(" ; ,") == []
    assert first('"";a') == ["a"]


def test_open_quote_is_text():
    d = Dialect(frozenset(";"), frozenset('"'), False, False)
    assert parse('"a;b', d) == [('"a', False), ("b", False)]


def test_round_trips(spark):
    r = random.Random(1)
    words = [f"{a}_{b}" for a in ("loop", "name", "call", "field") for b in ("order", "exit", "rank")] + ["loop exit", "call, rank", "a; then b", 'the "x" y', "m|n"]
    rows, want = [], set()
    for i in range(300):
        items = [r.choice(words) for _ in range(r.randrange(0, 7))]
        sep = r.choice([";", "; ", ",", " | ", "\n", "\t", "；", ";;"])
        quote = lambda w: '"' + w.replace('"', '""') + '"' if any(c in w for c in ';,|"') or r.random() < 0.1 else w  # noqa: E731, B023
        text = sep.join(map(quote, items))
        text = r.choice([text, text + ";", " " + text, "[" + text + "]"])
        rows.append((i, text, i))
        want |= {(i, k + 1, w) for k, w in enumerate(items)}
    rows += [(1000, None, 1), (1001, "  ", 1), (None, "a", 1), (0, rows[0][1], -1)]
    df = spark.createDataFrame(rows, "row_id long, f string, at long").selectExpr("*", "1 AS n", "'x' AS items", "2 AS text")
    got = split_packed(df, "row_id", "f", "at").collect()
    assert {(x.row_id, x.pos, x["item"]) for x in got} == want and len(got) == len(want)


def test_empty_and_very_long(spark):
    assert split_packed(spark.createDataFrame([], "row_id long, f string, at long"), "row_id", "f", "at").collect() == []
    text = ";".join(f"E{i:06d}" for i in range(20_000))
    assert split_packed(spark.createDataFrame([(1, text, 1)], "row_id long, f string, at long"), "row_id", "f", "at", atomic=True).count() == 20_000


def test_the_value_code_decides():
    """Without code lengths the simplest dialect would win; with them the separator inside an unquoted value is dear."""
    text = "a_name; b_name, c_name"
    assert parses(text)[0][1] == ["a_name", "b_name", "c_name"]
    flat = Code()
    flat.bits = {q: dict.fromkeys(flat.bits[q], 0.0) for q in flat.bits}
    assert parses(text, code=flat)[0][1] == [text]


def test_known_values_turn_the_choice(spark):
    """``R|D`` is known from quoted lists, so it is one value where ``R`` and ``D`` are unknown ones."""
    rows = [(i, f'"R|D";name_{i % 7}', 1) for i in range(60)] + [(100, "name_1;R|D", 1), (101, "name_1|name_2", 1), (102, "name_3;P|Q", 1)]
    df = spark.createDataFrame(rows, "row_id long, f string, at long")
    got = {}
    for r in split_packed(df, "row_id", "f", "at").orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append(r["item"])
    assert got[0] == ["R|D", "name_0"]
    assert got[100] == ["name_1", "R|D"]
    assert got[101] == ["name_1", "name_2"]
    assert got[102] == ["name_3", "P", "Q"]


def test_code_learns_from_all_rows(spark):
    """Values that hold commas in plain texts of the column make a comma cheap."""
    rare = learn_code(spark.createDataFrame([(f"name_{i}",) for i in range(500)], "text string"))
    assert rare.bits[False][","] > 12
    quoted = learn_code(spark.createDataFrame([('"a, b, c";d',)] * 300, "text string"))
    assert quoted.bits[True][","] < 4
