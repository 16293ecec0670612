"""Reading levels: prose found, ranker and calibration, held-out grades."""

from __future__ import annotations

import random

import numpy as np
import pytest

from weftline.llm.reading import _Spelled, Reader, edge_paragraphs, find_notices, fit_ranker, isotonic, paragraph_key, prose_text, read_levels, tokens_of, _Spelled

EASY = "the cat sits on a mat . we see the dog . it runs to the red box . you can read it".split(" . ")
HARD = ["the interoperability of each representation necessitates conservative reconciliation, notwithstanding that the specification deliberately underdetermines its normalisation", "an exhaustive enumeration of every dependency circumscribes the compositionality, insofar as its approximation presupposes parameterisation"]


def text_of(level: int, r: random.Random, n: int = 14) -> str:
    return " ".join((r.choice(HARD) if r.random() < (level - 1) / 4 else r.choice(EASY)).capitalize() + "." for _ in range(n))


def graded(seed: int, each: int = 12):
    r = random.Random(seed)
    return [(text_of(lv, r), float(lv)) for lv in range(1, 6) for _ in range(each)]


def test_prose_only():
    t = "# Title here\n\nThe tool reads `code_x` one file.\nIt works in v1.2.\n\n```\nif a_b < 3 {\n}\n```\n\n    [12] WARN read: x -> y\n\n- first point\n- second point\n\nThis is a notice.\n\nx = call(y, 2)\n"
    words = tokens_of(prose_text(t, frozenset({paragraph_key("this is a  Notice.")})), _Spelled())
    assert words == "the tool reads one file . it works in . first point . second point .".split()
    assert prose_text("") == "" and tokens_of(prose_text("\n \n"), _Spelled()) == []


def test_ranker_and_isotonic():
    r = np.random.default_rng(0)
    y = np.repeat([1.0, 2, 3], 20)
    w = fit_ranker(np.c_[y + r.normal(0, 0.3, 60), r.normal(0, 1, 60)], y)
    assert w[0] > 5 * abs(w[1])
    x, v = isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0]))
    assert v.tolist() == [1.0, 2.5, 4.0] and (np.diff(x) > 0).all()


def test_held_out_levels():
    m = Reader(graded(1))
    r = random.Random(77)
    off = [abs(m.read(text_of(lv, r, 25))[3] - lv) for lv in range(1, 6) for _ in range(10)]
    assert np.mean(off) < 0.7
    with pytest.raises(ValueError, match="two levels"):
        Reader([("a b", 1.0)])


def test_documents(spark):
    r = random.Random(5)
    notice = "Provided without any warranty whatsoever by the contributors of it."
    docs = [(i, text_of(5, r) + "\n\n" + notice) for i in range(6)] + [(6, text_of(1, r)), (7, None), (8, " \n"), (9, "Der Baum liest die Datei und das Paket ist nicht auf der Liste. " * 8), (10, text_of(5, r, 3000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS level", "2 AS score")
    s = spark.createDataFrame(graded(1), "t string, y double")
    assert find_notices(df, "text") == {paragraph_key(notice)}
    got = {x.doc_id: x for x in read_levels(df, s, doc_id="doc_id", text="text", sample_text="t", sample_level="y").collect()}
    assert all(got[i].level > 3.5 and got[i].is_english for i in [*range(6), 10])
    assert got[6].level < 2.5 and (got[7].n_words, got[7].level) == (0, None) and not got[8].is_english and not got[9].is_english
    assert read_levels(df.limit(0), s, doc_id="doc_id", text="text", sample_text="t", sample_level="y").collect() == []


def test_edges():
    assert edge_paragraphs("a\r\n\r\nb\n \nc") == ["a", "c"] and edge_paragraphs("one") == []


def test_level_does_not_depend_on_what_was_read_before(monkeypatch):
    """A memory of spellings of three pieces gives the same tokens as one without bound, also within one text."""
    r = random.Random(8)
    texts = [text_of(lv, r) + " We compare the Specification with Interoperability and Compilers here." for lv in (1, 3, 5, 2)]
    m = Reader(graded(1))
    alone = [m.read(t) for t in texts]
    monkeypatch.setattr(_Spelled, "MOST", 3)
    one = _Spelled()
    assert [m.read(t, spelled=one) for t in texts] == alone
    assert [m.read(t, spelled=one) for t in reversed(texts)] == alone[::-1]
