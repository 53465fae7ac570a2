"""Exact integer columns: clamps, rounding shifts, saturating arithmetic, bit fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def lit64(v: int) -> Column:
    return F.lit(v).cast("bigint")


def clip(v: Column, low, high) -> Column:
    return F.greatest(F.least(v, F.lit(high) if isinstance(high, int) else high), F.lit(low) if isinstance(low, int) else low)


def round_shift(v: Column, n: int) -> Column:
    """(v + half) >> n, arithmetic."""
    return F.shiftright(v + (1 << (n - 1)), n) if n else v


def div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b)


def saturate(v: Column, bits: int) -> Column:
    """A wide value clamped to a signed range and cast to bigint."""
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.greatest(F.least(v, F.lit(str(high)).cast(WIDE)), F.lit(str(low)).cast(WIDE)).cast("bigint")


def wide(v: Column) -> Column:
    return v.cast(WIDE)


def bit_scan(v: Column) -> Column:
    """Place of the highest set bit; 0 for values of 0 or less."""
    return F.when(v <= 0, lit64(0)).otherwise((F.length(F.bin(v)) - 1).cast("bigint"))


def power(base: Column, exponent: Column, bits: int) -> Column:
    """Saturating integer power; base 0 stays 0, and a negative exponent gives 0 unless the base is 1 or -1."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(exponent, F.lit(64) + exponent % 2)).cast("int"))
    grown = F.aggregate(steps, lit64(1), lambda acc, _: saturate(wide(acc) * wide(base), bits))
    unit = F.when(exponent % 2 == 0, lit64(1)).otherwise(lit64(-1))
    return F.when(base.isin(0, 1), base).when(base == -1, unit).when(exponent < 0, lit64(0)).when(exponent == 0, lit64(1)).otherwise(grown)


def bits_of(byte: Column, first: int, n: int) -> Column:
    """``n`` bits of a byte value from bit ``first``, counted from the highest."""
    return F.shiftright(byte, 8 - first - n).bitwiseAND((1 << n) - 1)


def unsigned(data: Column, offset, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes at a 0-based offset; null past the end."""
    part = F.substring(data, (F.lit(offset) if isinstance(offset, int) else offset) + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("bigint"))


def leb128(groups: Column) -> Column:
    """Value of an array of byte values, seven bits each, lowest first; stops at the first byte under 128."""
    stop = F.array_position(F.transform(groups, lambda b: (b < 128)), True)
    used = F.when(stop > 0, F.slice(groups, 1, stop.cast("int"))).otherwise(groups)
    return F.aggregate(F.transform(used, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lit64(0), lambda acc, x: acc + F.call_function("shiftleft", (x["b"] % 128).cast("bigint"), 7 * x["i"]))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
