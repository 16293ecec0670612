"""Languages by character n-grams, with some labels wrong."""

from __future__ import annotations

import random

from weftline.llm import language
from weftline.llm.reading import fit_languages, read_levels

WORDS = {
    "en": "the parser keeps every value that each writer has given when this step runs through them with care".split(),
    "de": "der baum wird nicht geschrieben weil sich die werte einer liste mit jedem schritt noch ändern können".split(),
    "es": "el valor de cada paso no se escribe porque los árboles son más largos que una lista del paquete".split(),
}


def text_of(lang: str, r: random.Random, n: int = 40) -> str:
    return " ".join(r.choices(WORDS[lang], k=n)).capitalize() + "."


def test_labels():
    assert [language.label_of(x) for x in ("en-GB", " EN", "de_DE", "e", "", None, "12")] == ["en", "en", "de", None, None, None, None]
    assert set(language.grams("ab")) == {"<", "a", "b", ">", "<a", "ab", "b>", "<ab", "ab>"}


def test_wrong_labels_do_not_matter(spark):
    r = random.Random(1)
    truth = [r.choice(["en", "en", "de", "es"]) for _ in range(200)]
    rows = [(i, text_of(g, r), r.choice([g, g.upper(), f"{g}-XX", g, g, g, r.choice(["en", "de", "es"]), None])) for i, g in enumerate(truth)] + [(900, None, "en"), (901, " ", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS gram")
    m = fit_languages(df, "doc_id", "text", "lang")
    assert all(m.of(text_of(g, r, 12).lower().replace(".", " .").split()) == g for g in WORDS for _ in range(20))
    assert m.of([]) is None
    graded = spark.createDataFrame([(text_of("en", r, 10 * y), float(y)) for y in range(1, 6) for _ in range(3)], "t string, y double")
    got = read_levels(df, graded, doc_id="doc_id", text="text", sample_text="t", sample_level="y", label="lang").collect()
    assert {x.doc_id for x in got if x.is_english} == {i for i, g in enumerate(truth) if g == "en"}


def test_too_few_languages(spark):
    r = random.Random(2)
    one = spark.createDataFrame([(i, text_of("en", r), "en") for i in range(9)] + [(10, text_of("de", r), "de")], "doc_id long, text string, lang string")
    assert fit_languages(one, "doc_id", "text", "lang") is None and fit_languages(one.limit(0), "doc_id", "text", "lang") is None
