"""Exact fixed-width integers: 8, 16, 32 and 64 bits, signed and unsigned, two's-complement wrap.

Values travel as DECIMAL(38,0), so that ANSI mode never overflows; results are in the domain's range.
A null operand gives null; division by zero raises, as Spark's own does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _dec(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast(WIDE)


def _big(n: int) -> Column:
    return F.expr(f"CAST('{n}' AS DECIMAL(38,0))")


def wrap(x: Column, width: int, signed: bool) -> Column:
    """x modulo 2^width in the domain's range."""
    m = _big(2**width)
    r = F.pmod(_dec(x), m)
    return (F.when(r >= _big(2 ** (width - 1)), r - m).otherwise(r) if signed else r).cast(WIDE)


def convert(x: Column, width: int, signed: bool) -> Column:
    """Sign-extend, then mask to the width."""
    return wrap(x, width, signed)


def literal(text: Column, width: int, signed: bool) -> Column:
    """A canonical decimal text in range, or null."""
    v = F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,20})$"), text).try_cast(WIDE)
    lo, hi = (-(2 ** (width - 1)), 2 ** (width - 1) - 1) if signed else (0, 2**width - 1)
    return F.when((v >= _big(lo)) & (v <= _big(hi)), v)


def add(a: Column, b: Column, width: int, signed: bool) -> Column:
    return wrap((_dec(a) + _dec(b)).cast(WIDE), width, signed)


def subtract(a: Column, b: Column, width: int, signed: bool) -> Column:
    return wrap((_dec(a) - _dec(b)).cast(WIDE), width, signed)


def multiply(a: Column, b: Column, width: int, signed: bool) -> Column:
    """The product is split at 32 bits, so 64-bit operands stay within 38 digits."""
    m = _big(2**width)
    x, y = F.pmod(_dec(a), m).cast(WIDE), F.pmod(_dec(b), m).cast(WIDE)
    half = _big(2**32)
    if width <= 32:
        return wrap((x * y).cast(WIDE), width, signed)
    low = F.pmod(x, half).cast(WIDE)
    high = ((x - low) / half).cast(WIDE)
    upper = F.pmod((high * F.pmod(y, half).cast(WIDE)).cast(WIDE), half).cast(WIDE)
    return wrap(((low * y).cast(WIDE) + (upper * half).cast(WIDE)).cast(WIDE), width, signed)


def negate(a: Column, width: int, signed: bool) -> Column:
    return wrap((-_dec(a)).cast(WIDE), width, signed)


def complement(a: Column, width: int, signed: bool) -> Column:
    return wrap((-_dec(a) - 1).cast(WIDE), width, signed)


def _quotient(a: Column, b: Column) -> Column:
    x, y = F.abs(_dec(a)), F.abs(_dec(b))
    return (x - x % y) / y


def divide(a: Column, b: Column, width: int, signed: bool) -> Column:
    """Truncated toward zero; the least value by -1 wraps."""
    same = F.signum(a.cast("double")) * F.signum(b.cast("double")) < 0
    q = _quotient(a, b).cast(WIDE)
    return wrap(F.when(same, -q).otherwise(q), width, signed)


def remainder(a: Column, b: Column, width: int, signed: bool) -> Column:
    """Sign of the dividend."""
    return wrap((_dec(a) % _dec(b)).cast(WIDE), width, signed)


def _pattern(x: Column, width: int) -> Column:
    """The bit pattern as a BIGINT."""
    r = wrap(x, 64, True).cast("bigint")
    return r.bitwiseAND(F.lit(2**width - 1)) if width < 64 else r


def _bitwise(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column, int, bool], Column]:
    def f(a: Column, b: Column, width: int, signed: bool) -> Column:
        return wrap(op(_pattern(a, width), _pattern(b, width)).cast(WIDE), width, signed)

    return f


bit_and = _bitwise(lambda x, y: x.bitwiseAND(y))
bit_or = _bitwise(lambda x, y: x.bitwiseOR(y))
bit_xor = _bitwise(lambda x, y: x.bitwiseXOR(y))
bit_and_not = _bitwise(lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def shift_left(a: Column, n: Column, width: int, signed: bool) -> Column:
    """0 for counts of the width or more."""
    p = _pattern(a, width)
    kept = F.call_function("shiftleft", p, F.least(n, F.lit(width - 1)).cast("int"))
    return F.when(n >= width, F.lit(0).cast(WIDE)).otherwise(wrap(kept.cast(WIDE), width, signed))


def shift_right(a: Column, n: Column, width: int, signed: bool) -> Column:
    """Arithmetic for signed (-1 for negative values beyond the width), logical for unsigned."""
    k = F.least(n, F.lit(width - 1)).cast("int")
    if signed:
        v = wrap(a, width, True).cast("bigint")
        return F.when(n >= width, F.when(v < 0, -1).otherwise(0).cast(WIDE)).otherwise(F.call_function("shiftright", v, k).cast(WIDE))
    p = _pattern(a, width)
    return F.when(n >= width, F.lit(0).cast(WIDE)).otherwise(wrap(F.call_function("shiftrightunsigned", p, k).cast(WIDE), width, False))


def compare(a: Column, b: Column, op: str) -> Column:
    """equal, not_equal, less, less_equal, greater, greater_equal; sign-aware, as values are in range."""
    x, y = _dec(a), _dec(b)
    return {"equal": x == y, "not_equal": x != y, "less": x < y, "less_equal": x <= y, "greater": x > y, "greater_equal": x >= y}[op]


def value(x: Column, width: int, signed: bool) -> Column:
    """A plain number taken into a domain; one that does not fit ends the query."""
    fits = wrap(x, width, signed) == _dec(x)
    return F.when(x.isNull() | fits, _dec(x)).otherwise(F.raise_error(F.concat(F.lit("outside the domain: "), x.cast("string"))))


def format_value(x: Column, width: int, signed: bool) -> Column:
    """Decimal text of a number of a domain."""
    return value(x, width, signed).cast("decimal(38,0)").cast("string")
