"""Sample kernels as Column expressions: exact integers in BIGINT, one column per channel.

Every function maps columns to a column; ``depth`` is the bit depth of the samples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights in 1/32768, and what widens a sub-byte grey sample to 8 bits.
WEIGHTS = (6968, 23434, 2366)
WIDEN = {1: 255, 2: 85, 4: 17}


def top(depth: int) -> int:
    return (1 << depth) - 1


def _shift(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def gray_to_8(v: Column, depth: int) -> Column:
    return v * WIDEN[depth]


def key_alpha(samples: list[Column], key: list[int], depth: int) -> Column:
    """0 where all samples equal the transparent key (its low byte at 8 bits), else the greatest alpha."""
    same = F.lit(True)
    for s, k in zip(samples, key):
        low = k.bitwiseAND(F.lit(255)) if isinstance(k, Column) else k & 255
        same = same & (s == (low if depth == 8 else k))
    return F.when(same, 0).otherwise(top(depth)).cast("long")


def rgb_to_gray(r: Column, g: Column, b: Column, depth: int) -> Column:
    """Weighted sum of encoded samples: truncated at 8 bits, rounded at 16."""
    total = r * WEIGHTS[0] + g * WEIGHTS[1] + b * WEIGHTS[2]
    return _shift(total if depth == 8 else total + 16384, 15)


def rgb_to_gray_linear(r: Column, g: Column, b: Column, to_linear, from_linear, corrected) -> Column:
    """Weighted sum in linear light, always rounded; a pixel without colour takes the combined curve."""
    total = to_linear(r) * WEIGHTS[0] + to_linear(g) * WEIGHTS[1] + to_linear(b) * WEIGHTS[2] + 16384
    return F.when((r == g) & (r == b), corrected(r)).otherwise(from_linear(_shift(total, 15)))


def has_color(r: Column, g: Column, b: Column) -> Column:
    return (r != g) | (r != b)


def blend(front: Column, alpha: Column, back, depth: int) -> Column:
    """Composite in integers: the division by the greatest alpha is folded from the high part."""
    total = front * alpha + (F.lit(top(depth)) - alpha) * back + (1 << (depth - 1))
    return _shift(total + _shift(total, depth), depth)


def compose(front: Column, alpha: Column, screen: int, depth: int, curves=None, linear: int = 0) -> Column:
    """Over a background. ``curves``: (to_linear, from_linear, corrected) for blending in linear light."""
    if curves is None:
        return blend(front, alpha, F.lit(screen), depth)
    to_linear, from_linear, corrected = curves
    partial = from_linear(blend(to_linear(front), alpha, F.lit(linear), depth))
    return F.when(alpha == top(depth), corrected(front)).when(alpha == 0, screen).otherwise(partial).cast("long")


def premultiply(front: Column, alpha: Column, depth: int, curves=None, mode: str = "premultiplied") -> Column:
    """Alpha modes: ``premultiplied``, ``optimized`` (partial pixels stay linear) or ``broken``."""
    if curves is None:
        return blend(front, alpha, F.lit(0), depth)
    to_linear, from_linear, corrected = curves
    light = blend(to_linear(front), alpha, F.lit(0), depth)
    partial = light if mode == "optimized" else from_linear(light)
    return F.when(alpha == top(depth), corrected(front)).when(alpha == 0, 0).otherwise(partial).cast("long")


def compose_key(samples: list[Column], key: list[int], background: list[int], depth: int, corrected=None) -> list[Column]:
    """Pixels equal to the key become the background; others take the curve at 8 bits and stay at 16."""
    same = key_alpha(samples, key, depth) == 0
    other = [corrected(s) if corrected is not None and depth == 8 else s for s in samples]
    return [F.when(same, b).otherwise(o).cast("long") for b, o in zip(background, other)]


def scale_16(v: Column) -> Column:
    return F.floor((v + 128) / 257)


def strip_16(v: Column) -> Column:
    return _shift(v, 8)


def expand_16(v: Column) -> Column:
    return v * 257


def invert(v: Column, depth: int) -> Column:
    return F.lit(top(depth)) - v


def shift_down(v: Column, depth: int, significant: int) -> Column:
    return _shift(v, max(0, depth - significant))


def shift_up(v: Column, depth: int, significant: int) -> Column:
    """Bit replication: copies of the significant bits from the top down."""
    out, at = None, depth - significant
    while at > -significant:
        part = F.shiftleft(v, at) if at >= 0 else _shift(v, -at)
        out, at = part if out is None else out.bitwiseOR(part), at - significant
    return out.bitwiseAND(F.lit(top(depth)))


def swap_bytes(v: Column) -> Column:
    return v % 256 * 256 + _shift(v, 8)


def div51(v: Column) -> Column:
    """Nearest of six levels."""
    return _shift(v * 5 + 130, 8)


def cube_index(r: Column, g: Column, b: Column) -> Column:
    return (div51(r) * 6 + div51(g)) * 6 + div51(b)


def gray_alpha_index(g: Column, a: Column) -> Column:
    """Entry of the grey-and-alpha map: 231 greys, one clear entry, 4 x 6 partial ones."""
    return F.when(a > 229, _shift(g * 231 + 128, 8)).when(a < 26, 231).otherwise(div51(a) * 6 + div51(g) + 226).cast("long")


def rgba_cube_index(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Entry of the colour cube with coverage: 216 opaque, one clear, 27 half-covered ones."""
    half = lambda v, unit: F.when(v.bitwiseAND(F.lit(0x80)) != 0, unit).otherwise(0) + F.when(v.bitwiseAND(F.lit(0x40)) != 0, unit).otherwise(0)
    partial = F.lit(217) + half(r, 9) + half(g, 3) + half(b, 1)
    return F.when(a >= 196, cube_index(r, g, b)).when(a < 64, 216).otherwise(partial).cast("long")


def unpremultiply_16(c: Column, a: Column) -> Column:
    """Divide by coverage through a rounded reciprocal; full where the colour reaches the coverage."""
    safe = F.greatest(a, F.lit(1))
    inverse = F.floor((F.lit(65535 << 15) + _shift(a, 1)) / safe)
    return F.when(c >= a, 65535).otherwise(_shift(c * inverse + 16384, 15)).cast("long")


def alpha_to_8(a: Column) -> Column:
    return _shift(a * 255 + 32895, 16)


def row_bytes(width: Column, depth: Column) -> Column:
    return F.floor((width * depth + 7) / 8)


def color_cell(r: Column, g: Column, b: Column) -> Column:
    """Cell of the 32 x 32 x 32 look-up cube."""
    return F.shiftleft(_shift(r, 3), 10) + F.shiftleft(_shift(g, 3), 5) + _shift(b, 3)


def pack_swap(x: Column, per_byte: int) -> Column:
    """Position of a sample once each byte's samples are in reverse order."""
    return x - x % per_byte + (per_byte - 1) - x % per_byte


def pack(v: Column, depth: int) -> Column:
    """A sample of a byte on its way into a narrower one: one bit says whether there is anything, others keep the low bits."""
    return F.when(v != 0, 1).otherwise(0).cast("long") if depth == 1 else v.bitwiseAND(F.lit(top(depth)))


def narrow_premultiplied(c: Column, a: Column, to_srgb) -> Column:
    """A premultiplied 16-bit light by its coverage, as an 8-bit sample; full where the colour reaches the coverage or that is next to nothing."""
    a8 = alpha_to_8(a)
    inverse = F.floor((F.lit((65535 * 255) << 7) + _shift(a, 1)) / F.greatest(a, F.lit(1)))
    wide = F.when(a < 65407, _shift(c * F.when((a8 > 0) & (a8 < 255), inverse).otherwise(0) + 64, 7)).otherwise(c * 255)
    return F.when((c >= a) | (a < 128), 255).otherwise(to_srgb(wide / 255.0)).cast("long")
