"""The whole read and write in one call: files in, pixels or colour-map indices of a named format out, and back."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import colormaps, writing
from .plans.formats import FILE_SRGB, FORMATS, LINEAR, requests
from .plans.planner import Settings, Shape, plan
from .sources import images
from .sources.codec import CHANNELS
from .streaming.shared import shared_dir

#: What images of one branch share; all else that a plan depends on (gamma, transparent key) is a column.
KIND = ("color_type", "bit_depth", "transparent", "sample_bits")


def decoded(files: DataFrame) -> DataFrame:
    """``typed_rows`` of all files, decoded once and written by kind: at most 15 pairs of colour type and depth, each with or without transparency, and up to 16 counts of significant bits."""
    path = f"{shared_dir(files.sparkSession)}/decoded-{uuid.uuid4().hex}"
    rows = images.relation(files, "typed_rows").withColumn("sample_bits", F.when(F.col("bit_depth") == 16, F.col("sample_bits")).otherwise(0))
    rows.write.partitionBy(*KIND).parquet(path)
    return files.sparkSession.read.schema(rows.schema).parquet(path)


def palettes_of(files: DataFrame) -> DataFrame:
    """image_id, idx, pr, pg, pb, pa."""
    return images.relation(files, "palette").select("image_id", F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("long").alias(f"p{c}") for c in "rgba"])


def _kinds(files: DataFrame, assumed):
    """shape, transparent, sample_bits, pixels and one row an image of each kind; ``_gamma`` is an image's own gamma or ``assumed(shape)``, ``_key`` its transparent key."""
    rows = decoded(files)
    for color, depth, transparent, bits in sorted(map(tuple, rows.select(*KIND).distinct().collect())):
        shape = Shape(1, depth, color, CHANNELS[color])
        own = rows.filter(f"color_type = {color} and bit_depth = {depth} and transparent = {str(transparent).lower()} and sample_bits = {bits}")
        own = own.withColumn("_gamma", F.when(F.col("gamma") > 0, F.col("gamma")).otherwise(assumed(shape)).cast("long")).withColumn("_key", F.col("key"))
        px = images.explode_rows(own, "_key", "_gamma").select("image_id", "y", "x", *[f"c{i}" for i in range(shape.channels)], "_key", "_gamma")
        yield shape, transparent, bits, px, own.filter("y = 0").select("image_id", "_key", "_gamma")


def _by_kind(files: DataFrame, assumed, make) -> DataFrame:
    """Union over kinds of ``make(shape, transparent, sample_bits)``'s plan over that kind's pixels; each branch reads its own partition."""
    pal, parts = palettes_of(files), []
    for shape, transparent, bits, px, heads in _kinds(files, assumed):
        # an indexed image's colours, and so its gamma, are the palette's
        parts.append(make(shape, transparent, bits).apply(px, pal.join(heads.select("image_id", "_gamma"), "image_id") if shape.indexed else None))
    if not parts:
        return images.pixels(files).select("image_id", "y", "x", "c0")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def assumed_gamma(wide_is_srgb: bool):
    """The gamma of files without one: light for 16-bit samples unless they are taken to be sRGB, sRGB for others."""
    return lambda shape: LINEAR if shape.depth == 16 and not wide_is_srgb else FILE_SRGB


def _key():
    return tuple(F.get("_key", F.lit(i)).cast("long") for i in range(3))


def read_as(files: DataFrame, want: str, background: tuple[int, int, int] | None = None, wide_is_srgb: bool = True) -> DataFrame:
    """Pixels (image_id, y, x, c0, ...) of (image_id, content) in one of ``FORMATS``.

    ``wide_is_srgb``: 16-bit files without a gamma are taken to be sRGB; otherwise to be light. An 8-bit format without alpha needs a ``background`` to
    show where images are not opaque; without one those pixels come back as they are under their coverage, so blend them with ``read_over``.
    """

    def make(shape: Shape, transparent: bool, bits: int):
        asked, s = requests(shape, transparent, FORMATS[want], F.col("_gamma"), background)
        return plan(asked, shape, transparent, replace(s, key=_key(), sample_bits=bits, light=True))

    return _by_kind(files, assumed_gamma(wide_is_srgb), make)


def read_over(files: DataFrame, want: str, buffer: DataFrame, wide_is_srgb: bool = True) -> DataFrame:
    """Pixels of an 8-bit format without alpha, over a client's own pixels ``buffer`` (image_id, y, x and the format's channels c0, ...)."""
    from .plans.formats import composite_on_buffer

    fmt = FORMATS[want]
    if fmt.alpha or fmt.linear or not fmt.color:
        raise ValueError("an 8-bit colour format without alpha is wanted")
    channels = [f"c{i}" for i in range(fmt.channels)]

    def make(shape: Shape, transparent: bool, bits: int):
        asked, s = requests(shape, transparent, replace(fmt, alpha=True), F.col("_gamma"))
        if shape.has_alpha or transparent:
            asked, s = asked | {"alpha_mode"}, replace(s, alpha_mode="optimized")
        return plan(asked, shape, transparent, replace(s, key=_key(), sample_bits=bits, light=True))

    px = _by_kind(files, assumed_gamma(wide_is_srgb), make).withColumnRenamed(f"c{fmt.channels}", "a")
    px = px.join(decoded_indexed(files), "image_id", "left")
    over = buffer.select(F.col("image_id").cast("string").alias("image_id"), "y", "x", *[F.col(c).alias(f"d{c}") for c in channels])
    both = px.join(over, ["image_id", "y", "x"])
    return both.select("image_id", "y", "x", *[composite_on_buffer(F.col(c), F.col("a"), F.col(f"d{c}"), F.coalesce("indexed", F.lit(False))).alias(c) for c in channels])


def decoded_indexed(files: DataFrame) -> DataFrame:
    """image_id, indexed of each file with a header."""
    return images.relation(files, "headers").select("image_id", (F.col("color_type") == 3).alias("indexed"))


def read_with(files: DataFrame, asked: set[str], settings: Settings = Settings()) -> DataFrame:
    """Pixels after any set of requests; an image's own gamma is used where it has one."""

    def make(shape: Shape, transparent: bool, bits: int):
        s = replace(settings, file_gamma=F.col("_gamma")) if "gamma" in asked else settings
        return plan(asked, shape, transparent, replace(s, key=_key(), sample_bits=s.sample_bits or bits, light=True))

    return _by_kind(files, lambda shape: settings.file_gamma, make)


def read_indexed(files: DataFrame, want: str, background: tuple[int, int, int] | None = None, wide_is_srgb: bool = True) -> tuple[DataFrame, DataFrame]:
    """Indices (image_id, y, x, idx) and colour maps (image_id, idx, c0, ...) of all images, the maps' entries in one of ``FORMATS``.

    Indexed and narrow grey images keep their samples as indices; others are sorted into fixed maps. Removing coverage at 8 bits needs a ``background``.
    """
    pal, indices, entries = palettes_of(files), [], []
    for shape, transparent, bits, px, heads in _kinds(files, assumed_gamma(wide_is_srgb)):
        reader = colormaps.reader(shape, transparent, FORMATS[want], background)
        made = reader(colormaps.Source(shape, transparent, px, heads, pal, FORMATS[want], background, F.col("_gamma"), _key(), bits))
        indices.append(made[0])
        entries.append(made[1])
    if not indices:
        empty = images.pixels(files).select("image_id", "y", "x", F.col("c0").cast("long").alias("idx"))
        return empty, empty.select("image_id", "idx", F.col("idx").alias("c0"))
    # entries are numbered out of one row an image, which Spark's estimate of their size leaves out: never broadcast them by it
    return reduce(DataFrame.unionByName, indices), reduce(DataFrame.unionByName, entries).hint("merge")


def write_as(px: DataFrame, width: int | None, columns: list[str], linear: bool = False, alpha_first: bool = False, reversed_: bool = False, **options) -> DataFrame:
    """Files (image_id, content) of pixels: one to four columns in the order grey or colour, then alpha, unless another order is named."""
    color = {1: 0, 2: 4, 3: 2, 4: 6}[len(columns)]
    options.setdefault("metadata", {"gAMA": 100_000} if linear else {"gAMA": FILE_SRGB, "sRGB": 0})
    asked = ({"swap_alpha"} if alpha_first and color & 4 else set()) | ({"bgr"} if reversed_ and color & 2 else set())
    return write_with(px, columns, Shape(width or 1, 16 if linear else 8, color, len(columns)), asked, width=width, **options)


def write_with(px: DataFrame, columns: list[str], file: Shape, asked: set[str], settings: Settings = Settings(), width: int | None = None, **options) -> DataFrame:
    """Files of the shape ``file`` from samples as a client has them, taken through the write requests ``asked``."""
    made = writing.plan_write(asked, file, settings).apply(px.select("image_id", "y", "x", *columns))
    return images.encode_images(made, width, [c for c in made.columns if c not in ("image_id", "y", "x")], file.depth, file.color, **options)


def write_indexed(px: DataFrame, entries: DataFrame, want: str, interlaced: bool = False, **options) -> DataFrame:
    """Indexed files of indices (image_id, y, x, idx) and each image's colour map (image_id, idx, c0, ...) in one of ``FORMATS``.

    The depth of a file follows from the number of entries in its map, whatever its rows use, so images are written by depth.
    """
    options.setdefault("metadata", {"sRGB": 0})
    maps = colormaps.palettes_for_writing(entries, FORMATS[want])
    sized = px.join(maps.select("image_id", "depth"), "image_id")
    parts = [images.encode_images(sized.filter(f"depth = {d}"), None, ["idx"], d, 3, interlaced, palettes=maps, **options) for d in (1, 2, 4, 8)]
    return reduce(DataFrame.unionByName, parts)
