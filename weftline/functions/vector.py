"""The vector runtime's functions over array columns and scalars: 1-based, recycling, text equality.

Division by zero, logarithms of non-positive numbers and unreadable numbers follow IEEE and the
runtime (infinities, NaN, 0), also under ANSI mode. An empty operand gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def _nan() -> Column:
    return F.lit(float("nan"))


def divide(x: Column, y: Column) -> Column:
    """IEEE division."""
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), _nan()).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def floor_mod(x: Column, y: Column) -> Column:
    """x - floor(x / y) * y; NaN for a zero divisor; the divisor's sign."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(y == 0, _nan()).otherwise(x - F.floor(F.try_divide(x, y)) * y)


def floor_div(x: Column, y: Column) -> Column:
    q = divide(x, y)
    return F.when(F.isnan(q) | (F.abs(q) == float("inf")), q).otherwise(F.floor(q).cast("double"))


def log(x: Column, base: float | None = None) -> Column:
    """Natural (or other) logarithm: -Infinity at 0, NaN below."""
    x = x.cast("double")
    v = F.ln(F.when(x > 0, x))
    if base is not None:
        v = F.log2(F.when(x > 0, x)) if base == 2 else F.log10(F.when(x > 0, x)) if base == 10 else v / math.log(base)
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, _nan()).otherwise(v)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def as_numeric(c: Column) -> Column:
    """Number of a text; 0 where it is none; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0)))


def as_integer(c: Column) -> Column:
    return trunc(as_numeric(c))


def as_logical_number(x: Column) -> Column:
    """0, NaN and null are false."""
    return F.coalesce((x != 0) & ~F.isnan(x.cast("double")), F.lit(False))


def number_text(x: Column) -> Column:
    """A number as the runtime prints it: whole numbers without a point, NA, Inf, -Inf, NULL."""
    x = x.cast("double")
    inf = float("inf")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), "NULL").when(F.isnan(x), "NA").when(x == inf, "Inf").when(x == -inf, "-Inf").when(whole, F.when(whole, x).cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def less(x: Column, y: Column) -> Column:
    """x < y, false with NaN (Spark orders NaN last)."""
    x, y = x.cast("double"), y.cast("double")
    return (x < y) & ~F.isnan(x) & ~F.isnan(y)


def sequence_length(n: Column) -> Column:
    """1..n; empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def recycle(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Element-wise ``op`` with the shorter array repeated; empty if either is."""
    n = F.greatest(F.size(a), F.size(b))
    at = lambda v, i: F.element_at(v, (F.pmod(i - 1, F.greatest(F.size(v), F.lit(1))) + 1).cast("int"))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.transform(sequence_length(n), lambda i: op(at(a, i), at(b, i)))).otherwise(F.filter(a, lambda _: F.lit(False)))


def subset(a: Column, idx: Column) -> Column:
    """Elements at 1-based places; places out of range are left out."""
    n = F.size(a)
    return F.transform(F.filter(idx, lambda i: (i >= 1) & (i <= n)), lambda i: F.element_at(a, i.cast("int")))


def which(flags: Column) -> Column:
    """1-based places of true."""
    return F.filter(F.transform(flags, lambda v, i: F.when(v, i + 1)), lambda x: x.isNotNull())


def which_max(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int")).otherwise(0)


def which_min(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)).cast("int")).otherwise(0)


def match(x: Column, table: Column) -> Column:
    """1-based place of x in a list, NaN where absent."""
    return F.coalesce(F.nullif(F.array_position(table, x), F.lit(0)).cast("double"), _nan())


def sum_(a: Column) -> Column:
    """Sum of an array; 0 of an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def prod(a: Column) -> Column:
    """Product; 1 of an empty array."""
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def mean(a: Column) -> Column:
    """Mean; NaN of an empty array."""
    return F.when(F.size(a) > 0, sum_(a) / F.greatest(F.size(a), F.lit(1))).otherwise(_nan())


def rms(a: Column) -> Column:
    """Root of the mean of squares; NaN of an empty array."""
    return F.sqrt(mean(F.transform(a, lambda x: x * x)))


def extremes(a: Column) -> Column:
    """[min, max]; [NaN, NaN] of an empty array."""
    return F.when(F.size(a) > 0, F.array(F.array_min(a), F.array_max(a))).otherwise(F.array(_nan(), _nan()))


def running(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running fold: cumsum, cumprod, cummin, cummax."""
    empty = F.filter(a, lambda _: F.lit(False))
    return F.aggregate(a, empty, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), x)).otherwise(x))))


def rep(a: Column, times: Column) -> Column:
    return F.flatten(F.array_repeat(a, times.cast("int")))


def seq_by(start: Column, stop: Column, by: Column) -> Column:
    """start, start + by, ... up to stop (with a tolerance of 1e-12)."""
    n = F.floor(divide(stop - start, by) + F.lit(1e-12)).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: start + i * by)).otherwise(F.array().cast("array<double>"))


def paste(sep: str, *cols: Column) -> Column:
    """All parts as one text."""
    return F.concat_ws(sep, *cols)


def substr(s: Column, first: Column, last: Column) -> Column:
    """Characters first..last, 1-based and inclusive, clamped."""
    a = F.greatest(first.cast("int"), F.lit(1))
    return F.substring(s, a, F.greatest(last.cast("int") - a + 1, F.lit(0)))


def sub_literal(s: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced by the replacement as it stands."""
    i = F.regexp_instr(s, F.lit(pattern))
    m = F.regexp_substr(s, F.lit(pattern))
    return F.when(m.isNull() | (i == 0), s).otherwise(F.concat(F.substring(s, F.lit(1), i - 1), F.lit(replacement), F.substring(s, i + F.length(m), F.length(s))))


def gsub(s: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; ``$1`` in the replacement stands for the first group."""
    return F.regexp_replace(s, pattern, replacement)


@F.pandas_udf(DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    """Gamma function; NaN at its poles."""

    def one(v: float) -> float:
        try:
            return math.gamma(v)
        except (ValueError, OverflowError):
            return math.inf if v > 0 else math.nan

    return x.map(one, na_action="ignore")


@F.pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """Logarithm of the gamma function's magnitude; infinite at its poles."""

    def one(v: float) -> float:
        try:
            return math.lgamma(v)
        except (ValueError, OverflowError):
            return math.inf

    return x.map(one, na_action="ignore")


def grep(pattern: str, a: Column) -> Column:
    """1-based places of the elements that match."""
    return which(F.transform(a, lambda x: F.coalesce(x.rlike(pattern), F.lit(False))))


def colon(first: Column, last: Column) -> Column:
    """first..last by ones, upwards or downwards."""
    return F.sequence(first.cast("int"), last.cast("int"))


def is_na(x: Column) -> Column:
    """Null or NaN."""
    return x.isNull() | F.isnan(x)


def is_infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x.cast("double")) == float("inf"), F.lit(False))


def is_finite(x: Column) -> Column:
    return ~(is_na(x) | is_infinite(x))


#: What the runtime calls Spark's types.
TYPE_NAMES = {"string": "character", "boolean": "logical", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "double", "double": "double"}


def type_of(x: Column) -> Column:
    """The runtime's name of a value's kind; null is ``NULL``, arrays and other nested values are lists."""
    names = F.create_map(*[F.lit(v) for kv in TYPE_NAMES.items() for v in kv])
    kind = F.typeof(x)
    return F.when(x.isNull(), "NULL").otherwise(F.coalesce(F.try_element_at(names, kind), F.when(kind.startswith("decimal"), "double"), F.lit("list")))


def sys_time() -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def sys_date() -> Column:
    """Days since 1970."""
    return F.unix_date(F.current_date())


def stop(message: Column) -> Column:
    """Ends the query with a message where it is evaluated."""
    return F.raise_error(message)


class Formula:
    """A function of columns from a formula: ``arguments`` are names, some with a default after ``=``; the body is an SQL expression.

    Arguments are given by place or by name; one without value or default is refused, as is an unknown name.
    """

    def __init__(self, name: str, arguments: str, body: str) -> None:
        parsed = [a.partition("=") for a in arguments.split(",")]
        self.name, self.names = name, [a.strip() for a, _, _ in parsed]
        self.defaults = {a.strip(): F.expr(v) for a, eq, v in parsed if eq}
        self.body = re.sub(r"\b(" + "|".join(map(re.escape, self.names)) + r")\b", r"__given.\1", body)

    def apply(self, df: DataFrame, out: str, *given: Column, **named: Column) -> DataFrame:
        """``df`` with the formula's value in ``out``; names of other columns cannot get in the way."""
        if len(given) > len(self.names) or set(named) - set(self.names):
            raise TypeError(f"{self.name}: arguments do not fit")
        bound = self.defaults | dict(zip(self.names, given)) | named
        if missing := [n for n in self.names if n not in bound]:
            raise TypeError(f"{self.name}: no value for {', '.join(missing)}")
        return df.withColumn("__given", F.struct(*[bound[n].alias(n) for n in self.names])).withColumn(out, F.expr(self.body)).drop("__given")
