"""Notices of any length, counted exactly."""

from __future__ import annotations

import pytest

from weftline.llm.reading import find_notices, paragraph_key, prose_text


def test_long_notice(spark):
    notice = "\n".join(["This file comes without any warranty."] * 120)
    df = spark.createDataFrame([(f"Text number {i} reads a file.\n\n{notice}",) for i in range(6)] + [("Another text.",)], "text string")
    found = find_notices(df, "text")
    assert len(notice) > 2000 and found == {paragraph_key(notice)}
    assert "warranty" not in prose_text(df.first().text, found)
    assert "warranty" not in prose_text("One text.\n\nNo" + " " * 90 + "warranty.", frozenset({"no warranty."}))


@pytest.mark.parametrize("n", [3_000, 4_000, 5_000, 6_000])
def test_exact_threshold(spark, n):
    k = n // 200  # the least number of texts at half a percent
    ends = ["Stands often enough."] * k + ["Falls one short."] * (k - 1)
    df = spark.createDataFrame([(f"Text {i}." + (f"\n\n{ends[i]}" if i < len(ends) else ""),) for i in range(n)], "text string")
    assert find_notices(df, "text") == {"stands often enough."}
