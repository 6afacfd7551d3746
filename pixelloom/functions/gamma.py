"""Gamma curves: exponents, tables of 8-bit samples, direct 16-bit forms, and the sRGB curve."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE, THRESHOLD, LIMIT = 100_000, 5_000, (1 << 31) - 1


def significant(exponent: int) -> bool:
    """Whether a fixed-point exponent differs from one by more than five per cent."""
    return abs(exponent - ONE) > THRESHOLD


def _rounded(x: float) -> int | None:
    n = math.floor(x + 0.5)
    return n if n <= LIMIT else None


def _power(base: Column, exponent: int | Column) -> Column:
    return F.pow(base, exponent * F.lit(1e-5) if isinstance(exponent, Column) else F.lit(exponent * 1e-5))


def if_significant(exponent: int | Column, v: Column, made: Column) -> Column:
    """A column of exponents decides row by row; a number was decided on before."""
    return F.when(F.abs(exponent - ONE) > THRESHOLD, made).otherwise(v) if isinstance(exponent, Column) else made


def snapped(exponent: int | Column) -> int | Column:
    """One if the exponent is too slight to matter."""
    return exponent if isinstance(exponent, Column) or significant(exponent) else ONE


def correction_exponent(file_gamma: int | Column, screen_gamma: int) -> int | Column | None:
    if isinstance(file_gamma, Column):
        return F.when(file_gamma > 0, F.floor(F.lit(1e15) / (file_gamma.cast("double") * float(screen_gamma)) + 0.5)).otherwise(ONE) if screen_gamma > 0 else None
    return _rounded(1e15 / (float(file_gamma) * float(screen_gamma))) if file_gamma > 0 and screen_gamma > 0 else None


def reciprocal_exponent(gamma: int | Column) -> int | Column | None:
    if isinstance(gamma, Column):
        return F.when(gamma > 0, F.floor(F.lit(1e10) / gamma.cast("double") + 0.5)).otherwise(ONE)
    return _rounded(1e10 / gamma) if gamma > 0 else None


def corrected(v: int, exponent: int | None, depth: int) -> int:
    """One sample through the exact curve; the ends are fixed points."""
    if exponent is None or not significant(exponent):
        return v
    top = 65535 if depth == 16 else 255
    v &= top
    return v if v in (0, top) else math.floor(top * (v / top) ** (exponent * 1e-5) + 0.5)


def table_8(exponent: int) -> list[int]:
    """All 256 outputs; the ends are fixed points, and exponent one is the identity."""
    if exponent == ONE:
        return list(range(256))
    g = exponent * 1e-5
    return [v if v in (0, 255) else math.floor(255 * (v / 255) ** g + 0.5) for v in range(256)]


def curve_8(exponent: int | Column) -> Callable[[Column], Column]:
    """A look-up in a constant array, which stays inside generated code; computed where the exponent is a column."""
    if isinstance(exponent, Column):
        made = lambda v: F.when((v == 0) | (v == 255), v).otherwise(F.floor(_power(v / 255, exponent) * 255 + 0.5))
        return lambda v: if_significant(exponent, v, made(v)).cast("long")
    if exponent == ONE:
        return lambda v: v
    table = F.expr(f"array({', '.join(f'{x}L' for x in table_8(exponent))})")
    return lambda v: F.get(table, v.cast("int"))


def curve_16(exponent: int | Column) -> Callable[[Column], Column]:
    """The exact 16-bit curve."""
    if isinstance(exponent, int) and exponent == ONE:
        return lambda v: v
    made = lambda v: F.when((v == 0) | (v == 65535), v).otherwise(F.floor(65535 * _power(v / 65535, exponent) + 0.5))
    return lambda v: if_significant(exponent, v, made(v))


def wide_shift(bits: int, narrowing: bool) -> int:
    """Low bits that a coarse 16-bit table leaves out: those beyond the significant ones, at most 8."""
    return min(8, max(16 - bits if 0 < bits < 16 else 0, 5 if narrowing else 0))


def curve_16_coarse(exponent: int | Column, shift: int) -> Callable[[Column], Column]:
    """A coarse table: the sample's high bits are rescaled to the table's range and corrected."""
    last, half = (1 << (16 - shift)) - 1, 1 << (15 - shift)
    plain = lambda v: F.floor((F.shiftright(v, shift) * 65535 + half) / last)
    bent = lambda v: F.floor(65535 * _power(F.shiftright(v, shift) / last, exponent) + 0.5)
    if isinstance(exponent, Column):
        return lambda v: if_significant(exponent, plain(v), bent(v))
    return bent if significant(exponent) else plain


def narrowing_bounds(exponent: int, shift: int) -> list[int]:
    """First index of a coarse table that no longer gives each of the 255 lower outputs.

    The midpoint between two outputs goes back through the rounded reciprocal exponent to an input, on the table's own scale.
    """
    inverse, last = math.floor(1e10 / exponent + 0.5) * 1e-5, (1 << (16 - shift)) - 1
    inputs = (math.floor(65535 * ((v * 257 + 128) / 65535) ** inverse + 0.5) for v in range(255))
    return [min((b * last + 32768) // 65535 + 1, last + 1) for b in inputs]


def curve_16_narrowing(exponent: int | Column, shift: int) -> Callable[[Column], Column]:
    """The table used when 16 bits will be cut to 8: only outputs that are multiples of 257.

    An output is the number of bounds at or below the index, so the range look-up is one constant array over the
    table's own inputs; with a column of exponents the number is found by halving, eight bounds a sample.
    """
    last = (1 << (16 - shift)) - 1
    if isinstance(exponent, Column):
        inverse = F.floor(F.lit(1e10) / exponent + 0.5) * F.lit(1e-5)
        places = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(8))])

        def bound(o: Column, power: Column) -> Column:
            b = F.floor(65535 * F.pow((o * 257 + 128) / 65535, power) + 0.5)
            return F.least(F.floor((b * last + 32768) / 65535) + 1, F.lit(last + 1))

        def look_up(v: Column) -> Column:
            known = F.struct(F.shiftright(v, shift).cast("long").alias("index"), inverse.alias("power"))
            count = lambda s: F.aggregate(places, F.lit(0).cast("long"), lambda o, step: F.when(bound(o + step - 1, s["power"]) <= s["index"], o + step).otherwise(o))
            return F.get(F.transform(F.array(known), count), F.lit(0)) * 257

        return look_up
    bounds, table, output = narrowing_bounds(exponent, shift), [], 0
    for index in range(1 << (16 - shift)):
        while output < 255 and index >= bounds[output]:
            output += 1
        table.append(output * 257)
    values = F.expr(f"array({', '.join(f'{x}L' for x in table)})")
    return lambda v: F.get(values, F.shiftright(v, shift).cast("int"))


def curve_small(exponent: int | Column, depth: int) -> Callable[[Column], Column]:
    """2- and 4-bit samples: replicated to 8 bits, corrected, cut back; 1-bit samples are left alone."""
    if depth == 1:
        return lambda v: v
    wide, curve = {2: 85, 4: 17}[depth], curve_8(exponent)
    return lambda v: F.shiftright(curve(v * wide), 8 - depth)


def srgb_to_linear(v: Column) -> Column:
    """8-bit sRGB to 16-bit linear by the IEC curve."""
    x = v / 255
    return F.floor(65535 * F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))) + 0.5)


def linear_to_srgb(v: Column) -> Column:
    """16-bit linear to 8-bit sRGB by the IEC curve."""
    x = v / 65535
    return F.floor(255 * F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055) + 0.5)
