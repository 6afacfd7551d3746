"""Colour-mapped output and input: which map an image is read into, the index of each pixel, and what the entries hold.

A map is a function of the entry's number, of the image's gamma and of a background, so entries are a projection of at most 256
rows an image, and indices one of its pixels. 8-bit entries are sRGB; 16-bit entries are light times their coverage. Alpha is the
last channel of an entry whatever the format says of its place, as it is for the reference's readers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gamma as curves
from ..functions import kernels as k
from .formats import SRGB, Format, on_black, premultiplied_gray
from .planner import Background, Settings, Shape, plan, resolve_background

NEEDED = "a background is needed to remove coverage"


@dataclass(frozen=True)
class Source:
    """Images of one kind: their pixels, one row an image in ``heads``, palettes, and what is wanted."""

    shape: Shape
    transparent: bool
    px: DataFrame
    heads: DataFrame
    palette: DataFrame
    fmt: Format
    background: tuple[int, int, int] | None
    gamma: Column
    key: tuple[Column, ...]
    bits: int

    def rows(self, asked: set[str], px: DataFrame | None = None, back: tuple | None = None, corrects: bool = True) -> DataFrame:
        """8-bit samples in sRGB (in the file's encoding without ``corrects``), over ``back`` if given."""
        asked = asked | {"scale_16"} | ({"gamma"} if corrects else set()) | ({"compose"} if back is not None else set())
        s = Settings(self.gamma if corrects else 0, SRGB if corrects else 0, key=self.key, sample_bits=self.bits, light=True)
        if back is not None:
            s = resolve_background(Background(*back, gray=back[1]), asked, self.shape, s)
        return plan(asked, self.shape, self.transparent, s).apply(self.px if px is None else px)

    def entries(self, n: int) -> DataFrame:
        """Each image's numbers from 0 below ``n``."""
        return self.heads.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


Made = tuple[DataFrame, DataFrame]
EXPAND = {"expand", "expand_transparency"}


class Correction:
    """What a file's gamma says about its own 8-bit samples, as columns: already sRGB, already light, or on a curve."""

    def __init__(self, gamma: Column) -> None:
        near = lambda g: F.abs(g - curves.ONE) <= curves.THRESHOLD
        self.linear = near(gamma)
        self.srgb = ~self.linear & near(F.floor((gamma * 11 + 2) / 5))
        self.exponent = F.floor(F.lit(1e10) / gamma.cast("double") + 0.5)

    def light(self, v: Column) -> Column:
        """16-bit light of an 8-bit sample."""
        wide = v * 257
        return F.when(self.srgb, curves.srgb_to_linear(v)).when(self.linear, wide).otherwise(bent_16(wide, self.exponent)).cast("long")

    def shown(self, v: Column) -> Column:
        """The sRGB byte of an 8-bit sample."""
        return F.when(self.srgb, v).otherwise(curves.linear_to_srgb(self.light(v))).cast("long")


def bent_16(v: Column, exponent: Column) -> Column:
    """A 16-bit sample through the exact curve, however slight."""
    return F.when((v <= 0) | (v >= 65535), v).otherwise(F.floor(65535 * F.pow(v / 65535, exponent * F.lit(1e-5)) + 0.5))


def _entry(fmt: Format, red: Column, green: Column, blue: Column, alpha: Column) -> list[Column]:
    """Channels of an entry, its colour as it is to be stored."""
    colour = ([blue, green, red] if fmt.reversed else [red, green, blue]) if fmt.color else [green]
    return [c.cast("long").alias(f"c{i}") for i, c in enumerate(colour + ([alpha] if fmt.alpha else []))]


def _fixed(fmt: Format, red: Column, green: Column, blue: Column, alpha: Column) -> list[Column]:
    """Channels of an entry that is named in sRGB bytes."""
    if not fmt.linear:
        return _entry(fmt, red, green, blue, alpha)
    wide = lambda v: F.when(alpha == 255, curves.srgb_to_linear(v)).otherwise(premultiplied_gray(curves.srgb_to_linear(v), alpha * 257))
    return _entry(fmt, wide(red), wide(green), wide(blue), alpha * 257)


def _ramp(src: Source) -> DataFrame:
    """256 greys that are their own numbers."""
    i = F.col("idx")
    return src.entries(256).select("image_id", "idx", *_fixed(src.fmt, i, i, i, F.lit(255)))


def _indices(rows: DataFrame, index: Column) -> DataFrame:
    return rows.select("image_id", "y", "x", index.cast("long").alias("idx"))


def gray(src: Source) -> Made:
    """Grey of up to 8 bits: samples are indices, and the map corrects them; one entry is the transparent value's."""
    n, fmt, c = 1 << src.shape.depth, src.fmt, Correction(src.gamma)
    v, clear = F.col("idx") * (255 // (n - 1)), (F.col("idx") == src.key[0]) if src.transparent else F.lit(False)
    if fmt.linear:
        light, zero = c.light(v), F.lit(0)
        level = F.when(clear, zero).otherwise(light)
        cols = _entry(fmt, level, level, level, F.when(clear, 0).otherwise(65535))
    else:
        back = (255, 255, 255) if fmt.alpha else src.background or (0, 0, 0)
        cols = _entry(fmt, *[F.when(clear, b).otherwise(c.shown(v)) for b in back], F.when(clear, 0).otherwise(255))
    return _indices(src.px, F.col("c0")), src.entries(n).select("image_id", "idx", *cols)


def wide_gray(src: Source) -> Made:
    """Grey of 16 bits: narrowing to an sRGB byte is the whole correction."""
    return _indices(src.rows(set()), F.col("c0")), _ramp(src)


def reduced_gray(src: Source) -> Made:
    """Colour averaged to grey. Coverage goes over one grey; where the file is not sRGB that happens in the file's own encoding, and the map corrects."""
    fmt = src.fmt
    asked = EXPAND | {"rgb_to_gray"}
    covered = src.shape.has_alpha or src.transparent
    if not covered:
        return _indices(src.rows(asked), F.col("c0")), _ramp(src)
    shade = 0 if fmt.linear else src.background[1]
    c = Correction(src.gamma)
    to_light = curves.srgb_to_linear(F.lit(shade)).cast("long")
    in_file = F.when(c.linear, to_light).otherwise(bent_16(to_light, src.gamma))
    at = F.floor((in_file * 255 + 32767) / 65535).cast("long")
    known = src.heads.withColumn("_shown", c.srgb).withColumn("_at", at)
    px = src.px.join(known.select("image_id", "_shown", "_at"), "image_id")
    as_shown = src.rows(asked, px.filter("_shown"), (shade,) * 3)
    as_filed = src.rows({"expand_transparency", "rgb_to_gray"}, px.filter("not _shown"), (F.col("_at"),) * 3, corrects=False)
    i, at = F.col("idx"), F.col("_at")
    named, level = (to_light, c.light(i)) if fmt.linear else (F.lit(shade), c.shown(i))
    plain = curves.srgb_to_linear(i) if fmt.linear else i
    shown = F.when(F.col("_shown"), plain).when(i == at, named).otherwise(level)
    entries = replace(src, heads=known).entries(256).select("image_id", "idx", *_entry(fmt, shown, shown, shown, F.lit(65535 if fmt.linear else 255)))
    return _indices(as_shown.unionByName(as_filed), F.col("c0")), entries


def palette(src: Source) -> Made:
    """An indexed image: its samples are indices into its own palette, corrected, averaged and blended entry by entry."""
    fmt, c = src.fmt, Correction(src.gamma)
    rgb, a = [F.col(n) for n in ("pr", "pg", "pb")], F.col("pa")
    if fmt.linear:
        light = [c.light(v) for v in rgb]
        if not fmt.alpha:
            light = [F.when((a > 0) & (a < 255), on_black(x, a)).otherwise(x) for x in light]
        if not fmt.color:
            mean = F.shiftright(light[0] * k.WEIGHTS[0] + light[1] * k.WEIGHTS[1] + light[2] * k.WEIGHTS[2] + 16384, 15)
            light = [F.when((light[0] == light[1]) & (light[1] == light[2]), light[1]).otherwise(mean)] * 3
        cols = _entry(fmt, *[F.when(a == 255, x).when(a == 0, 0).otherwise(premultiplied_gray(x, a * 257)) for x in light], a * 257)
    else:
        back = src.background or (0, 0, 0)
        over = [curves.linear_to_srgb((c.light(v) * a + curves.srgb_to_linear(F.lit(b)) * (255 - a)) / 255) for v, b in zip(rgb, back)]
        kept, blended = [c.shown(v) for v in rgb], over
        if not fmt.color:
            kept = [F.when((rgb[0] == rgb[1]) & (rgb[1] == rgb[2]), kept[1]).otherwise(_mean_shown([c.light(v) for v in rgb]))] * 3
            over = [curves.linear_to_srgb((c.light(v) * a + curves.srgb_to_linear(F.lit(back[1])) * (255 - a)) / 255) for v in rgb]
            blended = [F.when((over[0] == over[1]) & (over[1] == over[2]), over[1]).otherwise(_mean_shown([curves.srgb_to_linear(v) for v in over]))] * 3
        shown = kept if fmt.alpha or not src.transparent else [F.when(a == 255, x).when(a == 0, b).otherwise(y) for x, y, b in zip(kept, blended, back)]
        cols = _entry(fmt, *shown, a)
    entries = src.palette.join(src.heads, "image_id").filter("idx < 256").select("image_id", "idx", *cols)
    return _indices(src.px, F.col("c0")), entries


def _mean_shown(light: list[Column]) -> Column:
    """The sRGB byte of the weighted mean of three lights, rounded at 23 and again at 16 bits."""
    total = light[0] * k.WEIGHTS[0] + light[1] * k.WEIGHTS[1] + light[2] * k.WEIGHTS[2]
    return curves.linear_to_srgb(F.shiftright(F.shiftright(total + 128, 8) * 255 + 64, 7) / 255)


def gray_alpha(src: Source, blends: bool) -> Made:
    """Greys with coverage: 231 opaque levels, one clear entry, and 4 x 6 partial ones, which hold a blend if coverage goes."""
    rows = src.rows(EXPAND | ({"rgb_to_gray"} if src.shape.has_color else set()))
    i, j = F.col("idx"), F.col("idx") - 232
    solid, part, cover = F.floor((i * 256 + 115) / 231), j % 6 * 51, (F.floor(j / 6) + 1) * 51
    if not blends:
        level = F.when(i < 231, solid).when(i == 231, 255).otherwise(part)
        cols = _fixed(src.fmt, level, level, level, F.when(i < 231, 255).when(i == 231, 0).otherwise(cover))
    else:
        over = lambda b: curves.linear_to_srgb((curves.srgb_to_linear(part) * cover + curves.srgb_to_linear(F.lit(b)) * (255 - cover)) / 255)
        cols = _fixed(src.fmt, *[F.when(i < 231, solid).when(i == 231, b).otherwise(over(b)) for b in src.background], F.lit(255))
    return _indices(rows, k.gray_alpha_index(F.col("c0"), F.col("c1"))), src.entries(256).select("image_id", "idx", *cols)


def composed_gray(src: Source) -> Made:
    """Grey with coverage over one grey: the bytes that come out are indices."""
    shade = 0 if src.fmt.linear else src.background[1]
    return _indices(src.rows(EXPAND, back=(shade,) * 3), F.col("c0")), _ramp(src)


def _cube(i: Column) -> list[Column]:
    return [F.floor(i / 36) * 51, F.floor(i / 6) % 6 * 51, i % 6 * 51]


def cube(src: Source, back: tuple[int, int, int] | None = None) -> Made:
    """Colours without coverage, or over a colour of the cube: six levels a channel."""
    rows = src.rows(EXPAND, back=back)
    entries = src.entries(216).select("image_id", "idx", *_fixed(src.fmt, *_cube(F.col("idx")), F.lit(255)))
    return _indices(rows, k.cube_index(F.col("c0"), F.col("c1"), F.col("c2"))), entries


def cube_alpha(src: Source) -> Made:
    """Colours with coverage: the cube, an entry for what is clear, and 27 for what is half covered."""
    fmt, back = src.fmt, (0, 0, 0) if src.fmt.linear else src.background
    if not fmt.alpha and all(b % 51 == 0 for b in back):
        return cube(src, back)
    i, j = F.col("idx"), F.col("idx") - 217
    level = lambda x: F.get(F.array(F.lit(0), F.lit(127), F.lit(255)), x.cast("int"))
    half = [level(F.floor(j / 9)), level(F.floor(j / 3) % 3), level(j % 3)]
    if not fmt.alpha:
        half = [curves.linear_to_srgb((curves.srgb_to_linear(h) * 128 + curves.srgb_to_linear(F.lit(b)) * 127) / 255) for h, b in zip(half, back)]
    clear = (255, 255, 255) if fmt.alpha else back
    colour = [F.when(i < 216, c).when(i == 216, b).otherwise(h) for c, b, h in zip(_cube(i), clear, half)]
    alpha = F.when(i < 216, 255).when(i == 216, 0).otherwise(128)
    entries = src.entries(244).select("image_id", "idx", *_fixed(fmt, *colour, alpha))
    return _indices(src.rows(EXPAND), k.rgba_cube_index(*[F.col(f"c{n}") for n in range(4)])), entries


def reader(shape: Shape, transparent: bool, fmt: Format, background: tuple[int, int, int] | None) -> Callable[[Source], Made]:
    """How images of a kind are read into a map of a format; ValueError where coverage has nothing to settle into."""
    covered = shape.has_alpha or transparent
    settled = fmt.alpha or fmt.linear or background is not None or not covered
    if not settled:
        raise ValueError(NEEDED)
    if shape.indexed:
        return palette
    if not shape.has_color and not shape.has_alpha:
        if shape.depth == 16 and transparent:
            raise ValueError("a transparent 16-bit grey has no entry of its own")
        return gray if shape.depth <= 8 else wide_gray
    if not shape.has_color:
        if fmt.alpha:
            return lambda src: gray_alpha(src, False)
        one_shade = fmt.linear or not fmt.color or len(set(background)) == 1
        return composed_gray if one_shade else lambda src: gray_alpha(src, True)
    if not fmt.color:
        return (lambda src: gray_alpha(src, False)) if covered and fmt.alpha else reduced_gray
    return cube_alpha if covered else cube


def palettes_for_writing(entries: DataFrame, fmt: Format) -> DataFrame:
    """image_id, depth, entries (red, green, blue), alpha up to the last entry that is not opaque, from maps (image_id, idx, c0, ...).

    16-bit entries are light times their coverage and become sRGB bytes beside their coverage.
    """
    at = [F.col(f"c{i}").cast("long") for i in range(fmt.channels)]
    alpha = (at.pop(0 if fmt.alpha_first else -1)) if fmt.alpha else F.lit(65535 if fmt.linear else 255).cast("long")
    colour = (at[::-1] if fmt.reversed else at) if fmt.color else at * 3
    if fmt.linear and fmt.alpha:
        colour = [k.narrow_premultiplied(c, alpha, curves.linear_to_srgb) for c in colour]
    elif fmt.linear:
        colour = [curves.linear_to_srgb(c).cast("long") for c in colour]
    cover = k.alpha_to_8(alpha) if fmt.linear else alpha
    row = F.struct("idx", F.array(*[c.cast("int") for c in colour]).alias("rgb"), cover.cast("int").alias("a"))
    maps = entries.filter("idx < 256").groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    n, covers = F.size("rows"), F.transform("rows", lambda r: r["a"])
    last = F.coalesce(F.array_max(F.filter(F.transform(covers, lambda a, i: F.when(a < 255, i + 1)), lambda i: i.isNotNull())), F.lit(0))
    depth = F.when(n > 16, 8).when(n > 4, 4).when(n > 2, 2).otherwise(1)
    return maps.select("image_id", depth.alias("depth"), F.transform("rows", lambda r: r["rgb"]).alias("entries"), F.slice(covers, F.lit(1), last).alias("alpha"))
