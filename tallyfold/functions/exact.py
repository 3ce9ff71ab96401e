"""Exact sums of doubles, whatever their size and order.

A double is a whole number of at most 53 bits times a power of two.  Cut at fixed powers of 2^24 it falls into at most
four digits (of either sign, as each is rounded, not cut off), and digits of equal place add up as 64-bit integers: plain sums, which aggregate partially, lose nothing and
do not depend on order.  ``lo`` and ``hi`` say which places are kept, as powers of 2^24; the usual ones hold numbers
from 1e-30 to 1e43 with all their bits.  Numbers that need other places are counted, never rounded.

A group may have 2^39 rows before a digit's sum outgrows its type, which is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.names import col

BITS = 24
BASE = 1 << BITS
USUAL = (-7, 5)
ALL = (-45, 43)
FEW = 24
Span = tuple[int, int]


def _scaled(value: Column, power: int) -> Column:
    """Times a power of two, without a factor that no double can hold."""
    while power:
        step = max(-1000, min(1000, power))
        value, power = value * F.lit(2.0 ** step), power - step
    return value


def span_of(least: float | None, most: float | None) -> Span:
    """Places that numbers of these magnitudes need (the least one above zero)."""
    if not least or not most:
        return 0, 0
    lowest, highest = math.frexp(least)[1] - 53, math.frexp(most)[1]
    return max(ALL[0], lowest // BITS), min(ALL[1], highest // BITS)


def fits(value: Column, span: Span) -> Column:
    lo, hi = span
    if span == ALL:
        return F.abs(value) < F.lit(math.inf)
    scaled, above = F.abs(_scaled(value, -BITS * lo)), BITS * (hi + 1)
    return (F.abs(value) < F.lit(2.0 ** above if above < 1024 else math.inf)) & (F.rint(scaled) == scaled)


def _digit(value: Column, place: int, span: Span) -> Column:
    # To the nearest whole number: what a place rounds away is what the place below it has, so their sum loses nothing.
    cut = F.rint(_scaled(value, -BITS * place))
    if place < span[1]:
        cut = cut - F.lit(float(BASE)) * F.rint(_scaled(value, -BITS * (place + 1)))
    cut = cut.cast("bigint")
    if span[1] - span[0] < 40 or BITS * (place + 4) > 1023:
        return cut
    # Far above this place the scaled number would not be finite, and its digit here is 0.
    far = F.lit(0).cast("bigint")
    return F.when(F.abs(value) < F.lit(2.0 ** (BITS * (place + 4))), cut).when(value.isNotNull(), far)


def digit_sums(value: Column, span: Span = USUAL) -> list[Column]:
    """Sums of the digits of all values that fit, one for each place, lowest first; zeros without any."""
    held = F.when(fits(value, span), value)
    return [F.coalesce(F.sum(_digit(held, j, span)), F.lit(0).cast("bigint")) for j in range(span[0], span[1] + 1)]


def outside(value: Column, span: Span = USUAL) -> Column:
    """How many values do not fit."""
    return F.count_if(value.isNotNull() & ~F.isnan(value) & ~fits(value, span))


def padded(digits: Column, span: Span) -> Column:
    """Digits of some places as digits of all places."""
    zero = F.lit(0).cast("bigint")
    return F.concat(F.array_repeat(zero, span[0] - ALL[0]), digits, F.array_repeat(zero, ALL[1] - span[1]))


def _carried(digits: Column) -> Column:
    """(digits from 0 to BASE - 1, what is carried beyond the last): the same number has one such form."""
    start = F.struct(F.array().cast("array<bigint>").alias("digits"), F.lit(0).cast("bigint").alias("carry"))

    def step(state: Column, digit: Column) -> Column:
        sum_ = state["carry"] + digit
        return F.struct(F.concat(state["digits"], F.array(sum_.bitwiseAND(F.lit(BASE - 1)))).alias("digits"),
                        F.shiftright(sum_, BITS).alias("carry"))

    return F.aggregate(digits, start, step)


def magnitude(digits: Column) -> Column:
    """(negative, digits): sign and digits of the absolute value, two digits longer."""
    zero = F.lit(0).cast("bigint")
    signed = _with(F.concat(digits, F.array(zero, zero)), lambda long: F.struct(
        (_carried(long)["carry"] < 0).alias("negative"), long.alias("digits")))
    return _with(signed, lambda x: F.struct(x["negative"], _carried(F.transform(
        x["digits"], lambda d: F.when(x["negative"], -d).otherwise(d)))["digits"].alias("digits")))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """Use a value in several places of an expression, computed once."""
    return F.transform(F.array(value), then)[0]


def with_nearest(df: DataFrame, numbers: Mapping[str, tuple[Sequence[str], int]]) -> DataFrame:
    """Replace columns of digits by the double nearest to the number they give.

    ``numbers`` says for each new column which columns hold its digits, lowest first, and where the lowest stands.
    Up to ``FEW`` digits this is plain arithmetic over columns, a step at a time, which is compiled; expressions for
    more would get too large, so those go through arrays.
    """
    zero = F.lit(0).cast("bigint")
    used = {c for columns, _ in numbers.values() for c in columns}
    kept = [col(c) for c in df.columns if c not in used]
    long = {n: nearest(F.array(*map(col, columns)), lo).alias(n) for n, (columns, lo) in numbers.items()
            if len(columns) > FEW}
    if long:
        rest = {n: v for n, v in numbers.items() if n not in long}
        df = df.select(*kept, *long.values(), *[col(c) for columns, _ in rest.values() for c in columns])
        return with_nearest(df, rest) if rest else df
    names = {n: [f"{n} #{k}" for k in range(len(columns) + 2)] for n, (columns, _) in numbers.items()}
    digits = {n: [*map(col, columns), zero, zero] for n, (columns, _) in numbers.items()}
    signs = {n: f"{n} #negative" for n in numbers}
    df = df.select("*", *[(_chain(digits[n])[1] < 0).alias(signs[n]) for n in numbers])
    sized = {n: [F.when(col(signs[n]), -d).otherwise(d) for d in digits[n]] for n in numbers}
    df = df.select(*kept, *[col(c) for c in signs.values()],
                   *[d.alias(c) for n in numbers for d, c in zip(_chain(sized[n])[0], names[n])])
    return df.select(*kept, *[_from_digits([col(c) for c in names[n]], col(signs[n]), lo).alias(n)
                              for n, (_, lo) in numbers.items()])


def _chain(digits: list[Column]) -> tuple[list[Column], Column]:
    """Digits from 0 to BASE - 1, and what is carried beyond the last."""
    carry, found = F.lit(0).cast("bigint"), []
    for d in digits:
        found.append((d + carry).bitwiseAND(F.lit(BASE - 1)))
        carry = F.shiftright(d + carry, BITS)
    return found, carry


def _from_digits(digits: list[Column], negative: Column, lo: int) -> Column:
    """The nearest double of an absolute value given by carried digits."""
    zero, value = F.lit(0).cast("bigint"), F.lit(0.0)
    for top, first in enumerate(digits):
        at = [digits[top - back] if top >= back else zero for back in range(4)]
        low = at[2] * BASE + at[3]
        if top > 3:
            low = low.bitwiseOR(F.when(F.greatest(*digits[:top - 3], zero) > 0, 1).otherwise(0).cast("bigint"))
        # Both parts are whole numbers below 2^48, so only their sum is rounded, once.
        both = (at[0] * BASE + at[1]).cast("double") * F.lit(2.0 ** 48) + low.cast("double")
        value = F.when(first != 0, _scaled(both, BITS * (top - 3 + lo))).otherwise(value)
    return F.when(negative, -value).otherwise(value)


def nearest(digits: Column, lo: int) -> Column:
    """The same for an array of digits; for a few rows."""
    return _with(magnitude(digits), lambda m: _nearest(m, lo))


def _nearest(size: Column, lo: int) -> Column:
    zero = F.lit(0).cast("bigint")
    # Three zeros below, so that there are always four digits from the first one that counts.
    digits = F.concat(F.array(zero, zero, zero), size["digits"])
    top = F.array_max(F.transform(digits, lambda d, i: F.when(d != 0, i)))

    def at(back: int) -> Column:
        return F.get(digits, top - back)

    more = F.exists(F.slice(digits, 1, F.greatest(top - 3, F.lit(0))), lambda d: d != 0)
    high = at(0) * BASE + at(1)
    low = (at(2) * BASE + at(3)).bitwiseOR(F.when(more, 1).otherwise(0).cast("bigint"))
    value = high.cast("double") * F.lit(2.0 ** 48) + low.cast("double")
    place = top - 6 + lo
    half = F.shiftright(place, 1)
    powers = F.array(*[F.lit(2.0 ** (BITS * k)) for k in range(-28, 29)])
    value = value * F.get(powers, half + 28) * F.get(powers, place - half + 28)
    return F.when(top.isNull(), F.lit(0.0)).when(size["negative"], -value).otherwise(value)


def two_decimals(digits: Column, lo: int) -> Column:
    """A number given by its digits as decimal(38,2), NULL if it has more than 36 digits before the point."""
    return F.when(digits.isNotNull(), _with(magnitude(digits), lambda m: _two_decimals(m, lo)))


def _two_decimals(size: Column, lo: int) -> Column:
    digits, kind = size["digits"], "decimal(38,0)"

    def place(j: int) -> Column:
        return F.coalesce(F.get(digits, F.lit(j - lo)), F.lit(0).cast("bigint")) if j >= lo else F.lit(0).cast("bigint")

    # Horner's rule, five places: everything above would not fit anyway.
    whole = place(4).cast(kind)
    for j in (3, 2, 1, 0):
        whole = (whole * F.lit(BASE).cast("decimal(8,0)") + place(j).cast("decimal(8,0)")).cast(kind)
    above = F.exists(F.slice(digits, max(1, 6 - lo), 1 << 20), lambda d: d != 0)
    # Hundredths of what stands after the point: four places decide any rounding that a double shows.
    rest = sum((place(j).cast("double") * F.lit(2.0 ** (BITS * j)) for j in (-3, -2, -1)), F.lit(0.0))
    value = (whole.try_cast("decimal(38,2)") + F.round(rest, 2).cast("decimal(4,2)")).try_cast("decimal(38,2)")
    return F.when(above, F.lit(None).cast("decimal(38,2)")).when(size["negative"], -value).otherwise(value)
