"""Declarative reading: name the pixel format that is wanted, and the requests follow.

8-bit formats are sRGB; 16-bit formats are linear light, premultiplied where there is coverage.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gamma as curves
from .planner import Background, Plan, Settings, Shape, plan, resolve_background

SRGB, LINEAR = 220_000, 100_000
FILE_SRGB = 45_455


@dataclass(frozen=True)
class Format:
    color: bool = True
    alpha: bool = False
    linear: bool = False
    alpha_first: bool = False
    reversed: bool = False

    @property
    def channels(self) -> int:
        return (3 if self.color else 1) + self.alpha


# The names of formats.
FORMATS = {
    "gray": Format(False), "gray_alpha": Format(False, True), "alpha_gray": Format(False, True, alpha_first=True), "rgb": Format(), "bgr": Format(reversed=True), "rgba": Format(True, True), "argb": Format(True, True, alpha_first=True),
    "bgra": Format(True, True, reversed=True), "abgr": Format(True, True, alpha_first=True, reversed=True), "linear_gray": Format(False, linear=True), "linear_gray_alpha": Format(False, True, True), "linear_rgb": Format(linear=True), "linear_rgba": Format(True, True, True),
}


def describe(headers: DataFrame) -> DataFrame:
    """image_id, color, alpha, linear, colormap, entries of (image_id, bit_depth, color_type, transparent, n_palette)."""
    kind = F.col("color_type")
    indexed = kind == 3
    low = F.when(F.col("bit_depth") <= 8, F.expr("shiftleft(1, bit_depth)")).otherwise(256)
    return headers.select("image_id", kind.bitwiseAND(F.lit(2)).cast("boolean").alias("color"), (kind.bitwiseAND(F.lit(4)).cast("boolean") | F.col("transparent")).alias("alpha"), (F.col("bit_depth") == 16).alias("linear"), indexed.alias("colormap"), F.when(indexed, F.least("n_palette", F.lit(256))).when(kind == 0, low).otherwise(256).cast("long").alias("entries"))


def requests(start: Shape, transparent: bool, want: Format, file_gamma: int | Column = FILE_SRGB, background: tuple[int, int, int] | None = None) -> tuple[set[str], Settings]:
    """What a format asks of images of one shape."""
    covered = start.has_alpha or transparent
    asked = {"expand", "expand_transparency", "gamma", "expand_16" if want.linear else "scale_16"}
    screen = LINEAR if want.linear else SRGB
    s = Settings(file_gamma=file_gamma, screen_gamma=screen, filler=0xFFFF, filler_after=not want.alpha_first)
    if want.linear and covered:
        asked.add("alpha_mode")
        s = replace(s, alpha_mode="premultiplied")
    if want.color and not start.has_color:
        asked.add("gray_to_rgb")
    if not want.color and (start.has_color or start.indexed):
        asked.add("rgb_to_gray")
    if covered and not want.alpha:
        if want.linear or background is None:
            asked.add("strip_alpha")
        else:
            asked.add("compose")
            s = resolve_background(Background(*background, gray=background[1]), asked, start, s)
    if want.alpha and not covered:
        asked.add("add_alpha")
    if want.reversed:
        asked.add("bgr")
    if want.alpha_first and covered:
        asked.add("swap_alpha")
    return asked, s


def conversion(start: Shape, transparent: bool, want: str | Format, **options) -> Plan:
    fmt = FORMATS[want] if isinstance(want, str) else want
    asked, s = requests(start, transparent, fmt, **options)
    return plan(asked, start, transparent, s)


def cube_entries(spark) -> DataFrame:
    """idx, r, g, b of the 6 x 6 x 6 cube."""
    i = F.col("id")
    return spark.range(216).select(i.alias("idx"), (F.floor(i / 36) * 51).alias("r"), (F.floor(i / 6) % 6 * 51).alias("g"), (i % 6 * 51).alias("b"))


def gray_alpha_entries(spark) -> DataFrame:
    """idx, gray, alpha: 231 greys, one clear white, and 4 x 6 partial greys."""
    i, j = F.col("id"), F.col("id") - 232
    gray = F.when(i < 231, F.floor((i * 256 + 115) / 231)).when(i == 231, 255).otherwise(j % 6 * 51)
    alpha = F.when(i < 231, 255).when(i == 231, 0).otherwise((F.floor(j / 6) + 1) * 51)
    return spark.range(256).select(i.alias("idx"), gray.cast("long").alias("gray"), alpha.cast("long").alias("alpha"))


def rgba_entries(spark) -> DataFrame:
    """idx, r, g, b, a: the cube, one clear white, and 27 half-covered colours."""
    i, j = F.col("id"), F.col("id") - 217
    level = lambda x: F.get(F.array(F.lit(0), F.lit(127), F.lit(255)), x.cast("int"))
    part = {"r": (F.floor(i / 36) * 51, level(F.floor(j / 9))), "g": (F.floor(i / 6) % 6 * 51, level(F.floor(j / 3) % 3)), "b": (i % 6 * 51, level(j % 3))}
    cols = [F.when(i < 216, cube).when(i == 216, 255).otherwise(half).cast("long").alias(c) for c, (cube, half) in part.items()]
    return spark.range(244).select(i.alias("idx"), *cols, F.when(i < 216, 255).when(i == 216, 0).otherwise(128).cast("long").alias("a"))


def composite_on_buffer(v: Column, a: Column, d: Column, indexed: Column | bool = False) -> Column:
    """A sample of 8 bits over a client's sample ``d`` by its coverage.

    ``v`` is light of its own coverage, or, of an ``indexed`` image, an encoded sample: its palette was premultiplied and encoded again.
    """
    rest = F.lit(255) - a
    bytes_ = F.least(v + F.floor((rest * d + 127) / 255), F.lit(255))
    light = F.least(v * 65535 + rest * curves.srgb_to_linear(d), F.lit(255 * 65535))
    flag = F.lit(indexed) if isinstance(indexed, bool) else indexed
    return F.when(a == 0, d).when(a == 255, v).when(flag, bytes_).otherwise(curves.linear_to_srgb(light / 255)).cast("long")


def premultiplied_gray(c, a):
    """Grey samples of 16 bits by their coverage."""
    return F.floor((c * a + 32767) / 65535)


def on_black(light, a):
    """A 16-bit light on black by 8-bit coverage."""
    total = light * a * 257
    total = total + F.shiftright(total, 16)
    return F.shiftright(total + 32768, 16)

