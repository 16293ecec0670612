"""Column functions against plain Python."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from weftline.functions import ints as I
from weftline.functions import text as X
from weftline.functions import vector as V


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r)


def test_vector(spark):
    a, e = F.array(*map(F.lit, (3.0, 1.0, 2.0))), F.array().cast("array<double>")
    got = one(spark, V.recycle(a, F.array(F.lit(10.0), F.lit(20.0)), lambda x, y: x + y), V.recycle(a, e, lambda x, y: x + y), V.subset(a, F.array(F.lit(3), F.lit(0), F.lit(9), F.lit(1))), V.which(F.transform(a, lambda x: x > 1)), V.running(a, lambda s, x: s * x), V.sequence_length(F.lit(0)), V.rep(a, F.lit(2)), V.seq_by(F.lit(1.0), F.lit(2.0), F.lit(0.25)))
    assert got == [[13.0, 21.0, 12.0], [], [2.0, 3.0], [1, 3], [3.0, 3.0, 6.0], [], [3.0, 1.0, 2.0] * 2, [1.0, 1.25, 1.5, 1.75, 2.0]]
    inf = math.inf
    assert one(spark, V.divide(F.lit(1.0), F.lit(0.0)), V.divide(F.lit(-1.0), F.lit(0.0)), V.log(F.lit(0.0)), V.floor_mod(F.lit(-7.0), F.lit(3.0)), V.floor_mod(F.lit(7.0), F.lit(-3.0)), V.floor_div(F.lit(-7.0), F.lit(2.0)), V.sum_(e), V.prod(e)) == [inf, -inf, -inf, 2.0, -2.0, -4.0, 0.0, 1.0]
    assert all(math.isnan(x) for x in one(spark, V.divide(F.lit(0.0), F.lit(0.0)), V.log(F.lit(-1.0)), V.floor_mod(F.lit(1.0), F.lit(0.0)), V.mean(e), V.match(F.lit(9.0), a)))
    assert one(spark, V.number_text(F.lit(3.0)), V.number_text(F.lit(math.nan)), V.number_text(F.lit(-inf)), V.number_text(F.lit(0.5)), V.as_numeric(F.lit("x")), V.as_numeric(F.lit(" 2.5 ")), V.which_max(a), V.which_min(e)) == ["3", "NA", "-Inf", "0.5", 0.0, 2.5, 1, 0]
    assert one(spark, V.sub_literal(F.lit("abcabc"), "b", "$1"), V.gsub(F.lit("abcabc"), "(b)", "<$1>"), V.substr(F.lit("hello"), F.lit(0), F.lit(3)), V.substr(F.lit("hello"), F.lit(4), F.lit(2))) == ["a$1cabc", "a<b>ca<b>c", "hel", ""]
    r = spark.createDataFrame([(5.0,), (0.0,), (None,)], "x double").select(V.gamma("x"), V.lgamma("x")).collect()
    assert r[0][0] == 24.0 and abs(r[0][1] - math.log(24)) < 1e-12 and r[1][1] == inf


def test_text(spark):
    assert one(spark, X.normalize_source(F.lit("a \r\nb\t\r\n\n")), X.strip_comments(F.lit("a/*x*/b//c\nd/*e")), X.normalize_signature(F.lit("At 0xFF line  12")), X.strip_offset(F.lit("bad at 12")), X.sanitize_name(F.lit("  ")), X.failure_signature(F.lit(" a"), F.lit(None).cast("string")), X.normalize_language(F.lit(" C++ "))) == ["a\nb\n", "ab\nd", "at <n> line <n>", "bad", "unknown", "A|", "cpp"]
    assert one(spark, X.split_multi(F.lit("a; b,,c|")), X.set_text(X.split_multi(F.lit("b;a;b"))), X.basename(F.lit("a\\b/c.go")), X.dirname(F.lit("x")), X.hex_value(F.lit("0xFFFFFFFFFFFFFFFF")), X.truthy_text(F.lit("PASS")), X.first_present(F.lit(""), F.lit("z"))) == [["a", "b", "c"], "a;b", "c.go", ".", "18446744073709551615", True, "z"]


def test_integers(spark):
    r = random.Random(2)
    rows = []
    for w in (8, 16, 32, 64):
        lo, hi = -(2 ** (w - 1)), 2 ** (w - 1) - 1
        for a, b in [(lo, -1), (hi, hi), (lo, lo), (0, 5)] + [(r.randint(lo, hi), r.randint(lo, hi) or 1) for _ in range(25)]:
            rows.append((w, a, b, r.randrange(0, w + 3)))

    def wrap(x, w, s):
        x %= 2**w
        return x - 2**w if s and x >= 2 ** (w - 1) else x

    for w in (8, 16, 32, 64):
        for signed in (True, False):
            own = [(wrap(a, w, signed), wrap(b, w, signed) or 1, n) for k, a, b, n in rows if k == w]
            df = spark.createDataFrame([(str(a), str(b), n) for a, b, n in own], "a string, b string, n int").select(F.col("a").cast(I.WIDE).alias("a"), F.col("b").cast(I.WIDE).alias("b"), "n")
            a, b, n = F.col("a"), F.col("b"), F.col("n")
            ops = {
                "add": (I.add(a, b, w, signed), lambda x, y, k: x + y), "sub": (I.subtract(a, b, w, signed), lambda x, y, k: x - y), "mul": (I.multiply(a, b, w, signed), lambda x, y, k: x * y),
                "neg": (I.negate(a, w, signed), lambda x, y, k: -x), "not": (I.complement(a, w, signed), lambda x, y, k: ~x), "and": (I.bit_and(a, b, w, signed), lambda x, y, k: x & y),
                "or": (I.bit_or(a, b, w, signed), lambda x, y, k: x | y), "xor": (I.bit_xor(a, b, w, signed), lambda x, y, k: x ^ y), "andnot": (I.bit_and_not(a, b, w, signed), lambda x, y, k: x & ~y),
                "div": (I.divide(a, b, w, signed), lambda x, y, k: abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)), "rem": (I.remainder(a, b, w, signed), lambda x, y, k: abs(x) % abs(y) * (1 if x >= 0 else -1)),
                "shl": (I.shift_left(a, n, w, signed), lambda x, y, k: x << k if k < w else 0), "shr": (I.shift_right(a, n, w, signed), lambda x, y, k: x >> k),
            }
            got = df.select(*[c.cast("string").alias(k) for k, (c, _) in ops.items()]).collect()
            for (x, y, k), row in zip(own, got):
                for name, (_, f) in ops.items():
                    assert int(row[name]) == wrap(f(x, y, k), w, signed), (name, w, signed, x, y, k)


def test_literals(spark):
    assert [None if x is None else int(x) for x in one(spark, I.literal(F.lit("127"), 8, True), I.literal(F.lit("128"), 8, True), I.literal(F.lit("007"), 8, True), I.literal(F.lit("-0"), 8, True), I.literal(F.lit("255"), 8, False))] == [127, None, None, None, 255]
