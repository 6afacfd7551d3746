"""Registered queries over image relations, each beside its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import gamma as gm
from .functions import kernels as k
from .functions import metadata as md
from .operators import geometry, palettes, prediction
from .plans import formats
from .plans.planner import Settings, Shape, plan
from .plans.writing import plan_write

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PX = "WITH " + fixtures.PIXELS_SQL
PAL = PX + ", " + fixtures.PALETTE_SQL

TO, FROM, BOTH = 220_000, 45_455, 90_000
KEY8, KEY16 = 12, 12 * 256 + 40
BACK, BACK_LINEAR = 180, 90


def _register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _pixels(name: str, cols: dict[str, Callable[[], Column]], sql: dict[str, str], where: str = "px") -> None:
    """A projection of the pixel relation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = fixtures.pixels(spark, sf_dir)
        made = [c().cast("long").alias(n) for n, c in cols.items()]
        return px.select("image_id", "y", "x", *made)

    exprs = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in sql.items())
    _register(name, run, f"{PX} SELECT image_id, y, x, {exprs} FROM {where}")


def col(c: str) -> Column:
    return F.col(c)


RGB, RGB16 = ("r", "g", "b"), ("r16", "g16", "b16")


# SQL forms, written apart from the Column forms.
def _blend8(f: str, a: str, b: str) -> str:
    t = f"(({f}) * {a} + ({b}) * (255 - {a}) + 128)"
    return f"(({t} + {t} // 256) // 256)"


def _blend16(f: str, a: str, b: str) -> str:
    t = f"(({f}) * {a} + ({b}) * (65535 - {a}) + 32768)"
    return f"(({t} + {t} // 65536) // 65536)"


def _lut8(v: str, exponent: int) -> str:
    return f"CASE WHEN ({v}) IN (0, 255) THEN ({v}) ELSE CAST(floor(255 * pow(({v}) / 255.0::DOUBLE, {exponent * 1e-5!r}::DOUBLE) + 0.5) AS BIGINT) END"


def _lut16(v: str, exponent: int) -> str:
    return f"CASE WHEN ({v}) IN (0, 65535) THEN ({v}) ELSE CAST(floor(65535 * pow(({v}) / 65535.0::DOUBLE, {exponent * 1e-5!r}::DOUBLE) + 0.5) AS BIGINT) END"


def _gray(r: str, g: str, b: str, half: int) -> str:
    return f"(({r}) * 6968 + ({g}) * 23434 + ({b}) * 2366 + {half}) // 32768"


def _composed(f: str, a: str, top: int, depth: int, linear: int, screen: int, broken: bool = True) -> str:
    lut, blend = (_lut8, _blend8) if depth == 8 else (_lut16, _blend16)
    light = blend(lut(f, TO), a, str(linear))
    return f"CASE WHEN {a} = {top} THEN {lut(f, BOTH)} WHEN {a} = 0 THEN {screen} ELSE {lut(light, FROM) if broken else light} END"




def _curves(depth: int):
    make = gm.curve_8 if depth == 8 else gm.curve_16
    return make(TO), make(FROM), make(BOTH)


def _each(f: Callable[[Column], Column], names=RGB) -> dict:
    return {n: (lambda n=n: f(col(n))) for n in names}


def _each_sql(f: Callable[[str], str], names=RGB) -> dict[str, str]:
    return {n: f(n) for n in names}


# --- flagship: grey levels per image --------------------------------------------------------------------------------


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "r", "g", "b")
    gray = plan({"rgb_to_gray"}, Shape(8, 8, 2, 3)).apply(px)
    return gray.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c0").alias("total"), F.min("c0").alias("least"), F.max("c0").alias("most"))


_register("rgb_to_gray_8", _flagship, f"{PX} SELECT image_id, count(*) AS n, CAST(sum({_gray('r', 'g', 'b', 0)}) AS BIGINT) AS total, CAST(min({_gray('r', 'g', 'b', 0)}) AS BIGINT) AS least, CAST(max({_gray('r', 'g', 'b', 0)}) AS BIGINT) AS most FROM px GROUP BY image_id")

# --- sample kernels -------------------------------------------------------------------------------------------------

_pixels("gray_to_8", {f"d{d}": (lambda d=d: k.gray_to_8(col("v") % (1 << d), d)) for d in (1, 2, 4)}, {"d1": "v % 2 * 255", "d2": "v % 4 * 85", "d4": "v % 16 * 17"})
_pixels("trns_to_alpha", {"a8": lambda: k.key_alpha([col("v")], [KEY8 + 256], 8), "a16": lambda: k.key_alpha([col("v16")], [KEY16], 16), "rgb": lambda: k.key_alpha([col("r") % 4, col("g") % 4, col("b") % 4], [1, 2, 3], 8)},
        {"a8": f"CASE WHEN v = {KEY8} THEN 0 ELSE 255 END", "a16": f"CASE WHEN v16 = {KEY16} THEN 0 ELSE 65535 END", "rgb": "CASE WHEN r % 4 = 1 AND g % 4 = 2 AND b % 4 = 3 THEN 0 ELSE 255 END"})
_pixels("rgb_to_gray_16", {"gray": lambda: k.rgb_to_gray(*map(col, RGB16), 16)}, {"gray": _gray(*RGB16, 16384)})
_pixels("rgb_to_gray_linear", {"gray": lambda: k.rgb_to_gray_linear(*map(col, RGB), *_curves(8)), "gray16": lambda: k.rgb_to_gray_linear(*map(col, RGB16), *_curves(16))},
        {"gray": f"CASE WHEN r = g AND r = b THEN {_lut8('r', BOTH)} ELSE {_lut8(_gray(*(_lut8(c, TO) for c in RGB), 16384), FROM)} END",
         "gray16": f"CASE WHEN r16 = g16 AND r16 = b16 THEN {_lut16('r16', BOTH)} ELSE {_lut16(_gray(*(_lut16(c, TO) for c in RGB16), 16384), FROM)} END"})
_pixels("compose_8", _each(lambda c: k.compose(c, col("a"), BACK, 8)), _each_sql(lambda c: _blend8(c, "a", str(BACK))))
_pixels("compose_16", _each(lambda c: k.compose(c, col("a16"), BACK * 257, 16), RGB16), _each_sql(lambda c: _blend16(c, "a16", str(BACK * 257)), RGB16))
_ALPHA3 = "(CASE WHEN a % 5 = 0 THEN 0 WHEN a % 5 = 1 THEN 255 ELSE a END)"


def _alpha3() -> Column:
    """An alpha channel with many full and many clear pixels."""
    return F.when(col("a") % 5 == 0, 0).when(col("a") % 5 == 1, 255).otherwise(col("a"))


_pixels("compose_gamma", _each(lambda c: k.compose(c, _alpha3(), BACK, 8, _curves(8), BACK_LINEAR)), _each_sql(lambda c: _composed(c, _ALPHA3, 255, 8, BACK_LINEAR, BACK)))
_pixels("compose_gamma_16", _each(lambda c: k.compose(c, _alpha3() * 257, BACK * 257, 16, _curves(16), BACK_LINEAR * 257), RGB16), _each_sql(lambda c: _composed(c, f"({_ALPHA3} * 257)", 65535, 16, BACK_LINEAR * 257, BACK * 257), RGB16))
_pixels("premultiply_8", _each(lambda c: k.premultiply(c, col("a"), 8)) | {"gamma": lambda: k.premultiply(col("r"), _alpha3(), 8, _curves(8))}, _each_sql(lambda c: _blend8(c, "a", "0")) | {"gamma": _composed("r", _ALPHA3, 255, 8, 0, 0)})
_pixels("premultiply_16", _each(lambda c: k.premultiply(c, col("a16"), 16), RGB16), _each_sql(lambda c: _blend16(c, "a16", "0"), RGB16))
_pixels("alpha_optimized", _each(lambda c: k.premultiply(c, _alpha3(), 8, _curves(8), "optimized")), _each_sql(lambda c: _composed(c, _ALPHA3, 255, 8, 0, 0, False)))
_pixels("alpha_broken", _each(lambda c: k.premultiply(c, _alpha3(), 8, _curves(8), "broken")) | {"a": lambda: gm.curve_8(FROM)(_alpha3())}, _each_sql(lambda c: _composed(c, _ALPHA3, 255, 8, 0, 0)) | {"a": _lut8(_ALPHA3, FROM)})
_pixels("compose_transparent_color", {"g8": lambda: k.compose_key([col("v")], [KEY8], [77], 8, gm.curve_8(BOTH))[0], "g16": lambda: k.compose_key([col("v16")], [KEY16], [77 * 257], 16, gm.curve_16(BOTH))[0]},
        {"g8": f"CASE WHEN v = {KEY8} THEN 77 ELSE {_lut8('v', BOTH)} END", "g16": f"CASE WHEN v16 = {KEY16} THEN {77 * 257} ELSE v16 END"})
_pixels("gamma_8", {f"e{e}": (lambda e=e: gm.curve_8(e)(col("v"))) for e in (45_455, 100_000, 220_000, 25_000)}, {f"e{e}": "v" if e == 100_000 else _lut8("v", e) for e in (45_455, 100_000, 220_000, 25_000)})
_pixels("gamma_16", {f"e{e}": (lambda e=e: gm.curve_16(e)(col("v16"))) for e in (45_455, 220_000)}, {f"e{e}": _lut16("v16", e) for e in (45_455, 220_000)})
_pixels("gamma_16_coarse", {"s5": lambda: gm.curve_16_coarse(FROM, 5)(col("v16")), "s8": lambda: gm.curve_16_coarse(FROM, 8)(col("v16")), "flat": lambda: gm.curve_16_coarse(101_000, 5)(col("v16"))},
        {"s5": f"floor(65535 * pow((v16 // 32) / 2047.0::DOUBLE, {FROM * 1e-5!r}::DOUBLE) + 0.5)", "s8": f"floor(65535 * pow((v16 // 256) / 255.0::DOUBLE, {FROM * 1e-5!r}::DOUBLE) + 0.5)", "flat": "((v16 // 32) * 65535 + 1024) // 2047"})
_pixels("gamma_subbyte", {f"d{d}": (lambda d=d: gm.curve_small(FROM, d)(col("v") % (1 << d))) for d in (1, 2, 4)}, {"d1": "v % 2", "d2": f"({_lut8('v % 4 * 85', FROM)}) // 64", "d4": f"({_lut8('v % 16 * 17', FROM)}) // 16"})
_pixels("scale_16", {"v": lambda: k.scale_16(col("v16"))}, {"v": "(v16 + 128) // 257"})
_pixels("strip_16", {"v": lambda: k.strip_16(col("v16"))}, {"v": "v16 // 256"})
_pixels("expand_16", {"v": lambda: k.expand_16(col("v"))}, {"v": "v * 257"})
_pixels("invert_mono", {"v": lambda: k.invert(col("v"), 8), "v16": lambda: k.invert(col("v16"), 16), "v2": lambda: k.invert(col("v") % 4, 2)}, {"v": "255 - v", "v16": "65535 - v16", "v2": "3 - v % 4"})
_pixels("invert_alpha", {"a": lambda: k.invert(col("a"), 8), "a16": lambda: k.invert(col("a16"), 16)}, {"a": "255 - a", "a16": "65535 - a16"})
_pixels("shift_read", {"r": lambda: k.shift_down(col("r"), 8, 5), "g": lambda: k.shift_down(col("g"), 8, 6), "v16": lambda: k.shift_down(col("v16"), 16, 11), "full": lambda: k.shift_down(col("b"), 8, 9)}, {"r": "r // 8", "g": "g // 4", "v16": "v16 // 32", "full": "b"})
_pixels("shift_write", {"s5": lambda: k.shift_up(col("v") % 32, 8, 5), "s3": lambda: k.shift_up(col("v") % 8, 8, 3), "s1": lambda: k.shift_up(col("v") % 2, 8, 1), "w11": lambda: k.shift_up(col("v16") % 2048, 16, 11)},
        {"s5": "v % 32 * 8 + v % 32 // 4", "s3": "v % 8 * 32 + v % 8 * 4 + v % 8 // 2", "s1": "v % 2 * 255", "w11": "v16 % 2048 * 32 + v16 % 2048 // 64"})
_pixels("swap_bytes", {"v": lambda: k.swap_bytes(col("v16"))}, {"v": "v16 % 256 * 256 + v16 // 256"})
_pixels("div51", {"level": lambda: k.div51(col("v"))}, {"level": "(5 * v + 130) // 256"})
_pixels("color_cube", {"idx": lambda: k.cube_index(*map(col, RGB))}, {"idx": "((5 * r + 130) // 256 * 6 + (5 * g + 130) // 256) * 6 + (5 * b + 130) // 256"})
_pixels("gray_alpha_map", {"idx": lambda: k.gray_alpha_index(col("v"), col("a"))}, {"idx": "CASE WHEN a > 229 THEN (231 * v + 128) // 256 WHEN a < 26 THEN 231 ELSE 226 + 6 * ((5 * a + 130) // 256) + (5 * v + 130) // 256 END"})
_half = lambda c, u: f"(({c} // 128) % 2 + ({c} // 64) % 2) * {u}"
_pixels("rgba_map", {"idx": lambda: k.rgba_cube_index(*map(col, "rgba"))},
        {"idx": f"CASE WHEN a >= 196 THEN ((5 * r + 130) // 256 * 6 + (5 * g + 130) // 256) * 6 + (5 * b + 130) // 256 WHEN a < 64 THEN 216 ELSE 217 + {_half('r', 9)} + {_half('g', 3)} + {_half('b', 1)} END"})
_pixels("unpremultiply_16", _each(lambda c: k.unpremultiply_16(c, col("a16")), RGB16), _each_sql(lambda c: f"CASE WHEN {c} >= a16 THEN 65535 ELSE ({c} * ((65535 * 32768 + a16 // 2) // greatest(a16, 1)) + 16384) // 32768 END", RGB16))


_S = lambda x: f"floor(255 * (CASE WHEN ({x}) <= 0.0031308 THEN ({x}) * 12.92 ELSE pow({x}, {1 / 2.4!r}::DOUBLE) * 1.055 - 0.055 END) + 0.5)"
_WIDE = "(CASE WHEN a16 < 65407 THEN (r16 * (CASE WHEN (a16 * 255 + 32895) // 65536 BETWEEN 1 AND 254 THEN (65535 * 255 * 128 + a16 // 2) // greatest(a16, 1) ELSE 0 END) + 64) // 128 ELSE r16 * 255 END)"
_pixels("narrow_to_8", {"a": lambda: k.alpha_to_8(col("a16")), "r": lambda: k.narrow_premultiplied(col("r16"), col("a16"), gm.linear_to_srgb)}, {"a": "(a16 * 255 + 32895) // 65536", "r": f"CASE WHEN r16 >= a16 OR a16 < 128 THEN 255 ELSE {_S(f'({_WIDE} / 255.0::DOUBLE / 65535.0::DOUBLE)')} END"})
_pixels("srgb_to_linear", {"v": lambda: gm.srgb_to_linear(col("v"))}, {"v": "floor(65535 * (CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END) + 0.5)"})
_pixels("linear_to_srgb", {"v": lambda: gm.linear_to_srgb(col("v16"))}, {"v": _S("(v16 / 65535.0::DOUBLE)")})


# --- plans: whole requests through the planner ----------------------------------------------------------------------


def _planned(name: str, asked: set[str], shape: Shape, cols: list[str], sql: list[str], transparent: bool = False, settings: Settings = Settings(), palette: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", *cols)
        out = plan(asked, shape, transparent, settings).apply(px, fixtures.palette(spark) if palette else None)
        return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])

    exprs = ", ".join(f"CAST({e} AS BIGINT) AS c{i}" for i, e in enumerate(sql))
    source = f"{PAL} SELECT image_id, y, x, {exprs} FROM px LEFT JOIN pal ON pal.idx = px.{cols[0]}" if palette else f"{PX} SELECT image_id, y, x, {exprs} FROM px"
    _register(name, run, source)


RGB8, RGBA8, GRAY8 = Shape(8, 8, 2, 3), Shape(8, 8, 6, 4), Shape(8, 8, 0, 1)
_planned("expand_palette", {"expand"}, Shape(8, 8, 3, 1), ["over"], ["coalesce(pr, 0)", "coalesce(pg, 0)", "coalesce(pb, 0)", "coalesce(pa, 255)"], True, palette=True)
_planned("gray_to_rgb", {"gray_to_rgb"}, GRAY8, ["v"], ["v", "v", "v"])
_planned("bgr", {"bgr"}, RGB8, ["r", "g", "b"], ["b", "g", "r"])
_planned("strip_alpha", {"strip_alpha"}, RGBA8, ["r", "g", "b", "a"], ["r", "g", "b"])
_planned("swap_alpha", {"swap_alpha"}, RGBA8, ["r", "g", "b", "a"], ["a", "r", "g", "b"])
_planned("filler_before", {"filler"}, RGB8, ["r", "g", "b"], ["7", "r", "g", "b"], settings=Settings(filler=7 + 512, filler_after=False))
_planned("filler_after", {"filler", "bgr"}, RGB8, ["r", "g", "b"], ["b", "g", "r", "255"])
_planned("add_alpha", {"add_alpha", "swap_alpha"}, GRAY8, ["v"], ["v", "128"], settings=Settings(filler=128))
_planned("unpack", {"packing"}, Shape(8, 4, 0, 1), ["idx"], ["idx"])
_planned("user_transform", {"user_transform", "invert_mono"}, GRAY8, ["v"], ["(255 - v) * 3 % 256", "y * 8 + x"], settings=Settings(user=lambda live: {"v": live["v"] * 3 % 256, "p": F.col("y") * 8 + F.col("x")}))
_planned("planned_pipeline", {"expand", "rgb_to_gray", "scale_16", "invert_mono", "filler"}, Shape(8, 16, 2, 3), ["r16", "g16", "b16"],
         [f"255 - ({_gray(*RGB16, 16384)} + 128) // 257", f"CASE WHEN r16 = {KEY16} AND g16 = 1 AND b16 = 2 THEN 0 ELSE 255 END"], True, Settings(key=(KEY16, 1, 2)))
_planned("planned_compose", {"compose", "gamma"}, RGB8, ["r", "g", "b"],
         [f"CASE WHEN r = {KEY8} AND g = 3 AND b = 4 THEN {BACK} ELSE {_lut8(c, 50_000)} END" for c in RGB], True, Settings(45_455, 440_000 // 10 * 10, (BACK,) * 3, (BACK_LINEAR,) * 3, (KEY8, 3, 4)))


def _written(name: str, asked: set[str], file: Shape, cols: list[str], sql: list[str], settings: Settings = Settings(), x: str = "x") -> None:
    """Samples as a client has them, through a write plan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = fixtures.pixels(spark, sf_dir).withColumn("small", F.col("v16") % 2048)
        out = plan_write(asked, file, settings).apply(px.select("image_id", "y", "x", *cols))
        names = {f"c{i}": n for i, n in enumerate(NAMED.get(name, ()))}
        return out.select(*[F.col(c).cast("long").alias(names.get(c, c)) for c in out.columns])

    exprs = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in zip(NAMED.get(name, [f"c{i}" for i in range(9)]), sql))
    _register(name, run, f"{PX} SELECT image_id, y, {x} AS x, {exprs} FROM px")


NAMED = {"user_transform_write": ["v"]}
_written("strip_filler", {"filler"}, RGB8, ["r", "g", "b", "a"], ["r", "g", "b"])
_written("strip_filler_before", {"filler", "bgr"}, RGB8, ["a", "r", "g", "b"], ["b", "g", "r"], Settings(filler_after=False))
_written("user_transform_write", {"user_transform", "invert_mono"}, GRAY8, ["v"], ["255 - v * 2 % 256"], Settings(user=lambda live: {i: c * 2 % 256 for i, c in live.items()}))
_written("write_plan_rgba", {"swap_alpha", "invert_alpha", "bgr", "filler", "packing"}, RGBA8, ["a", "r", "g", "b"], ["b", "g", "r", "255 - a"])
_written("write_plan_wide", {"shift", "swap_bytes", "invert_mono"}, Shape(8, 16, 0, 1), ["small"],
         ["65535 - ((v16 % 2048 * 32 + v16 % 2048 // 64) % 256 * 256 + (v16 % 2048 * 32 + v16 % 2048 // 64) // 256)"], Settings(significant=(11,)))
_written("write_plan_packed", {"packing", "pack_swap", "invert_mono"}, Shape(8, 4, 0, 1), ["v"], ["15 - v % 16"])
_written("write_plan_swapped", {"pack_swap", "invert_mono"}, Shape(8, 4, 0, 1), ["idx"], ["15 - idx"], x="x // 2 * 2 + 1 - x % 2")

# --- look-up tables -------------------------------------------------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("id")
    return spark.range(256).select(v.alias("v"), gm.curve_8(FROM)(v).alias("lut8"), gm.curve_16(TO)(v * 257).cast("long").alias("lut16"), gm.srgb_to_linear(v).cast("long").alias("linear"))


_register("gamma_tables", _tables, f"SELECT v, CAST({_lut8('v', FROM)} AS BIGINT) AS lut8, CAST({_lut16('v * 257', TO)} AS BIGINT) AS lut16, CAST(floor(65535 * (CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END) + 0.5) AS BIGINT) AS linear FROM range(256) AS t(v)")


def _exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f, s, gm.correction_exponent(f, s), gm.reciprocal_exponent(f), gm.reciprocal_exponent(s)) for f in (0, 45_455, 55_556, 100_000, 220_000) for s in (0, 3, 100_000, 180_000, 220_000)]
    return spark.createDataFrame(rows, "file long, screen long, correction long, to_linear long, from_linear long").fillna(-1)


_register("gamma_exponents", _exponents, "WITH f AS (SELECT unnest([0, 45455, 55556, 100000, 220000]) AS file), s AS (SELECT unnest([0, 3, 100000, 180000, 220000]) AS screen) SELECT CAST(file AS BIGINT) AS file, CAST(screen AS BIGINT) AS screen, CASE WHEN file > 0 AND screen > 0 AND round(1e15 / (CAST(file AS DOUBLE) * screen)) <= 2147483647 THEN CAST(round(1e15 / (CAST(file AS DOUBLE) * screen)) AS BIGINT) ELSE -1 END AS correction, CASE WHEN file > 0 THEN CAST(round(1e10 / file) AS BIGINT) ELSE -1 END AS to_linear, CASE WHEN screen > 0 AND round(1e10 / screen) <= 2147483647 THEN CAST(round(1e10 / screen) AS BIGINT) ELSE -1 END AS from_linear FROM f, s")
_register("gray_palette", lambda spark, d: spark.range(256).select(F.col("id").alias("idx"), F.explode(F.array(*[F.struct(F.lit(dep).cast("long").alias("depth"), F.lit(m).cast("long").alias("m")) for dep, m in ((1, 255), (2, 85), (4, 17), (8, 1))])).alias("s")).filter("idx < shiftleft(1, cast(s.depth as int))").select("idx", F.col("s.depth").alias("depth"), (F.col("idx") * F.col("s.m")).alias("gray")),
          "SELECT idx, CAST(depth AS BIGINT) AS depth, idx * m AS gray FROM range(256) AS t(idx), (VALUES (1, 255, 2), (2, 85, 4), (4, 17, 16), (8, 1, 256)) AS d(depth, m, n) WHERE idx < n")


def _background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background colour on the scale of the blend: expanded from the image's depth, or moved with a depth change."""
    px = fixtures.pixels(spark, sf_dir)
    v = F.col("v")
    return px.select("image_id", "y", "x", (v % 4 * 85).alias("from2"), (v % 16 * 17).alias("from4"), (v * 257).alias("widened"), F.floor((F.col("v16") * 255 + 32767) / 65535).alias("narrowed"), gm.curve_8(FROM)(v).alias("screen"), gm.curve_8(TO)(v).alias("linear"))


_register("background_resolution", _background, f"{PX} SELECT image_id, y, x, v % 4 * 85 AS from2, v % 16 * 17 AS from4, v * 257 AS widened, (v16 * 255 + 32767) // 65535 AS narrowed, CAST({_lut8('v', FROM)} AS BIGINT) AS screen, CAST({_lut8('v', TO)} AS BIGINT) AS linear FROM px")

# --- palettes -------------------------------------------------------------------------------------------------------


def _palette_side(name: str, f: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    """A kernel over the palette's few rows, then one broadcast look-up."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pal = fixtures.palette(spark).select("idx", *[f(F.col(c)).cast("long").alias(c) for c in ("pr", "pg", "pb")], "pa")
        out = palettes.expand(fixtures.pixels(spark, sf_dir), pal, "idx")
        return out.select("image_id", "y", "x", "pr", "pg", "pb")

    exprs = ", ".join(f"CAST({sql(c)} AS BIGINT) AS {c}" for c in ("pr", "pg", "pb"))
    _register(name, run, f"{PAL} SELECT image_id, y, x, {exprs} FROM px JOIN pal USING (idx)")


_palette_side("gamma_palette", lambda c: gm.curve_8(FROM)(c), lambda c: _lut8(c, FROM))
_palette_side("compose_palette", lambda c: k.compose(c, F.col("pa"), BACK, 8), lambda c: _blend8(c, "pa", str(BACK)))
_palette_side("premultiply_palette", lambda c: F.floor((c * F.col("pa") + 127) / 255), lambda c: f"({c} * pa + 127) // 255")
_register("palette_overrun", lambda spark, d: palettes.overruns(fixtures.pixels(spark, d), fixtures.palette(spark), "over").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("over").alias("most")), f'{PX} SELECT image_id, count(*) AS n, max("over") AS most FROM px WHERE "over" > 15 GROUP BY image_id')
_register("max_palette_index", lambda spark, d: fixtures.pixels(spark, d).groupBy("image_id").agg(F.max("over").alias("palette_max")), f'{PX} SELECT image_id, max("over") AS palette_max FROM px GROUP BY image_id')
_register("palette_histogram", lambda spark, d: palettes.histogram(fixtures.pixels(spark, d), "idx"), f"{PX} SELECT image_id, idx, count(*) AS freq FROM px GROUP BY image_id, idx")
_register("color_seen", lambda spark, d: fixtures.pixels(spark, d).groupBy("image_id", "y").agg(F.bool_or(k.has_color(F.col("r") % 2, F.col("g") % 2, F.col("b") % 2)).alias("saw_color")), f"{PX} SELECT image_id, y, bool_or(r % 2 <> g % 2 OR r % 2 <> b % 2) AS saw_color FROM px GROUP BY image_id, y")
_register("quantize_lookup", lambda spark, d: palettes.quantize(fixtures.pixels(spark, d), fixtures.palette(spark)).select("image_id", "y", "x", "qidx"),
          f"{PAL}, d AS (SELECT image_id, y, x, idx2, abs(r // 8 - pr // 8) AS dr, abs(g // 8 - pg // 8) AS dg, abs(b // 8 - pb // 8) AS db FROM px, (SELECT idx AS idx2, pr, pg, pb FROM pal)), m AS (SELECT *, greatest(dr, dg, db) + dr + dg + db AS dist FROM d) SELECT image_id, y, x, arg_min(idx2, dist * 1000 + idx2) AS qidx FROM m GROUP BY ALL")


def _reduced(by_frequency: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = palettes.histogram(fixtures.pixels(spark, sf_dir), "idx")
        images = used.select("image_id").distinct()
        whole = images.crossJoin(F.broadcast(fixtures.palette(spark)))  # 16 entries
        pal = whole.join(used, ["image_id", "idx"], "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
        return palettes.reduce_palettes(pal.select("image_id", "idx", "pr", "pg", "pb", "freq"), 6, by_frequency)

    return run


_register("quantize_by_frequency", _reduced(True))
_register("quantize_nearest_pair", _reduced(False))

# --- packing and geometry -------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fixtures.pixels(spark, sf_dir)
    sums = [F.sum(F.shiftleft(F.col("v") % (1 << d), 0) * F.pow(F.lit(2), F.lit(8 - d) - F.col("x") % (8 // d) * d).cast("long")).alias(f"d{d}") for d in (4,)]
    four = px.groupBy("image_id", "y", F.floor(F.col("x") / 2).alias("byte")).agg(*sums)
    one = px.groupBy("image_id", "y").agg(F.sum(F.when(F.col("v") != 0, 1).otherwise(0) * F.pow(F.lit(2), F.lit(7) - F.col("x")).cast("long")).alias("d1"))
    return four.join(one, ["image_id", "y"]).select("image_id", "y", "byte", "d4", "d1")


_register("pack", _packed, f"{PX}, f AS (SELECT image_id, y, x // 2 AS byte, CAST(sum(v % 16 * (CASE WHEN x % 2 = 0 THEN 16 ELSE 1 END)) AS BIGINT) AS d4 FROM px GROUP BY ALL), o AS (SELECT image_id, y, CAST(sum(CASE WHEN v <> 0 THEN CAST(pow(2, 7 - x) AS BIGINT) ELSE 0 END) AS BIGINT) AS d1 FROM px GROUP BY ALL) SELECT * FROM f JOIN o USING (image_id, y)")
_register("packswap", lambda spark, d: fixtures.pixels(spark, d).select("image_id", "y", *[k.pack_swap(F.col("x"), n).alias(f"x{n}") for n in (2, 4, 8)], (F.col("v") % 2).alias("v")), f"{PX} SELECT image_id, y, x // 2 * 2 + 1 - x % 2 AS x2, x // 4 * 4 + 3 - x % 4 AS x4, 7 - x AS x8, v % 2 AS v FROM px")


def _row_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    unused = F.lit(255) - geometry.unused_bits(F.col("p_size"))
    return part.select("p_partkey", *[k.row_bytes(F.col("p_size"), F.lit(b)).alias(f"b{b}") for b in (1, 2, 4, 24, 64)], unused.alias("mask"))


_register("row_bytes", _row_bytes, "SELECT p_partkey, " + ", ".join(f"CAST((p_size * {b} + 7) // 8 AS BIGINT) AS b{b}" for b in (1, 2, 4, 24, 64)) + ", CAST(255 * CAST(pow(2, (8 - p_size % 8) % 8) AS BIGINT) % 256 AS BIGINT) AS mask FROM part")
_register("adam7_sizes", lambda spark, d: geometry.pass_sizes(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"), F.col("p_size").cast("long").alias("width"), (F.col("p_partkey") % 11 + 1).alias("height"))),
          "WITH a(pass, x0, y0, dx, dy) AS (VALUES (0,0,0,8,8),(1,4,0,8,8),(2,0,4,4,8),(3,2,0,4,4),(4,0,2,2,4),(5,1,0,2,2),(6,0,1,1,2)), h AS (SELECT p_partkey AS image_id, CAST(p_size AS BIGINT) AS width, p_partkey % 11 + 1 AS height FROM part), s AS (SELECT image_id, width, height, CAST(pass AS BIGINT) AS pass, greatest(0, CAST(ceil((width - x0) / dx::DOUBLE) AS BIGINT)) AS pass_width, greatest(0, CAST(ceil((height - y0) / dy::DOUBLE) AS BIGINT)) AS pass_height FROM h, a) SELECT * FROM s WHERE pass_width > 0 AND pass_height > 0")
_PASS_SQL = "CASE WHEN y % 8 = 0 AND x % 8 = 0 THEN 0 WHEN y % 8 = 0 AND x % 8 = 4 THEN 1 WHEN y % 8 = 4 AND x % 4 = 0 THEN 2 WHEN y % 4 = 0 AND x % 4 = 2 THEN 3 WHEN y % 4 = 2 AND x % 2 = 0 THEN 4 WHEN y % 2 = 0 THEN 5 ELSE 6 END"
_register("interlace", lambda spark, d: geometry.interlace(fixtures.pixels(spark, d).select("image_id", "y", "x", "v")),
          f"{PX}, p AS (SELECT image_id, y, x, v, CAST({_PASS_SQL} AS BIGINT) AS pass FROM px) SELECT *, CASE pass WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN x // 4 WHEN 3 THEN (x - 2) // 4 WHEN 4 THEN x // 2 WHEN 5 THEN (x - 1) // 2 ELSE x END AS pass_x, CASE pass WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN (y - 4) // 8 WHEN 3 THEN y // 4 WHEN 4 THEN (y - 2) // 4 WHEN 5 THEN y // 2 ELSE (y - 1) // 2 END AS pass_y FROM p")
_register("deinterlace_roundtrip", lambda spark, d: geometry.deinterlace(geometry.interlace(fixtures.pixels(spark, d).select("image_id", "y", "x", "v")).drop("x", "y")).select("image_id", "y", "x", "v"), f"{PX} SELECT image_id, y, x, v FROM px")
_register("block_display", lambda spark, d: geometry.block_display(geometry.interlace(fixtures.pixels(spark, d).select("image_id", "y", "x", "v")), 3, 8, 8),
          f"{PX} SELECT a.image_id, a.y, a.x, b.v FROM px a JOIN px b ON a.image_id = b.image_id AND b.y = a.y // 4 * 4 AND b.x = a.x // 2 * 2")
def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passes up to the fifth, and the sixth on top of them."""
    px = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", "v", geometry.pass_of(F.col("x"), F.col("y")).alias("pass"))
    return geometry.combine(px.filter("pass <= 4"), px.filter("pass = 5"))


_register("combine_row", _combined, f"{PX} SELECT image_id, y, x, v FROM px WHERE {_PASS_SQL} <= 5")

# --- prediction -----------------------------------------------------------------------------------------------------


def _bytes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pixels(spark, sf_dir).select("image_id", F.lit(0).cast("long").alias("pass"), F.col("y").alias("row"), F.col("x").alias("byte"), "v")


_NEAR = ", n AS (SELECT image_id, y AS row, x AS byte, v, coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS b FROM px), m AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY image_id, byte ORDER BY row), 0) AS c FROM n), e AS (SELECT image_id, row, byte, v AS f0, (v - a + 256) % 256 AS f1, (v - b + 256) % 256 AS f2, (v - (a + b) // 2 + 256) % 256 AS f3, (v - (CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END) + 256) % 256 AS f4 FROM m)"
for _k, _name in enumerate(prediction.FILTERS):
    _register(f"filter_{_name}", (lambda kind: lambda spark, d: prediction.neighbours(_bytes_of(spark, d)).select("image_id", "row", "byte", prediction.encoded(kind).alias("f")))(_k), f"{PX}{_NEAR} SELECT image_id, row, byte, f{_k} AS f FROM e")
_COST = _NEAR + ", w AS (SELECT image_id, row, " + ", ".join(f"CAST(sum(least(f{i}, 256 - f{i})) AS BIGINT) AS c{i}" for i in range(5)) + " FROM e GROUP BY ALL), k AS (SELECT image_id, 0::BIGINT AS pass, row, unnest([0, 1, 2, 3, 4]::BIGINT[]) AS filter, unnest([c0, c1, c2, c3, c4]) AS cost FROM w)"
_register("filter_cost", lambda spark, d: prediction.costs(_bytes_of(spark, d)), f"{PX}{_COST} SELECT * FROM k")
_register("filter_select", lambda spark, d: prediction.chosen(_bytes_of(spark, d)), f"{PX}{_COST} SELECT image_id, pass, row, arg_min(filter, cost * 8 + filter) AS filter, min(cost) AS cost FROM k GROUP BY ALL")
_register("undo_sub_up", lambda spark, d: (lambda near: prediction.undo_sub(near.withColumn("v", prediction.encoded(1))).select("image_id", "row", "byte", "v").unionByName(prediction.undo_up(near.withColumn("v", prediction.encoded(2))).select("image_id", "row", "byte", "v")))(prediction.neighbours(_bytes_of(spark, d))),
          f"{PX} SELECT image_id, y AS row, x AS byte, v FROM px UNION ALL SELECT image_id, y, x, v FROM px")


def _defiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filtered by windows, undone one image at a time where every row depends on the last."""
    import numpy as np

    from .sources.codec import unfilter

    near, best = prediction.neighbours(_bytes_of(spark, sf_dir)), prediction.chosen(_bytes_of(spark, sf_dir)).select("image_id", "pass", "row", "filter")
    picked = F.get(F.array(*[prediction.encoded(i) for i in range(5)]), F.col("filter").cast("int"))
    coded = near.join(best, ["image_id", "pass", "row"]).select("image_id", "row", "byte", "filter", picked.alias("f"))

    def undo(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "byte"])
        n = frame["row"].nunique()
        rows = unfilter(frame["filter"].to_numpy().reshape(n, -1)[:, 0], frame["f"].to_numpy(np.uint8).reshape(n, -1), 1)
        return frame[["image_id", "row", "byte"]].assign(v=rows.ravel().astype(np.int64))

    return coded.groupBy("image_id").applyInPandas(undo, "image_id long, row long, byte long, v long")


_register("defilter_roundtrip", _defiltered, f"{PX} SELECT image_id, y AS row, x AS byte, v FROM px")

# --- files ----------------------------------------------------------------------------------------------------------


def _encoded(spark: SparkSession, sf_dir: str, kind: str = "rgba", only: Column | None = None, **options) -> DataFrame:
    from .sources.images import encode_images

    px, cols, color = fixtures.pixels(spark, sf_dir), list(kind), {"v": 0, "rgb": 2, "rgba": 6}[kind]
    px = px if only is None else px.filter(only)
    return encode_images(px.select("image_id", "y", "x", *cols), 8, cols, 8, color, **options)


def _codec(kind: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sources.images import pixels

        px = pixels(_encoded(spark, sf_dir, kind, **options))
        return px.select(*[F.col(c).cast("long").alias(n) for c, n in zip(("image_id", "y", "x", "c0", "c1", "c2", "c3"), ("image_id", "y", "x", *kind))])

    return run


_register("codec_roundtrip", _codec("rgba"), f"{PX} SELECT image_id, y, x, r, g, b, a FROM px")
_register("codec_roundtrip_interlaced", _codec("rgb", interlaced=True), f"{PX} SELECT image_id, y, x, r, g, b FROM px")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.images import relation

    h = relation(_encoded(spark, sf_dir), "headers")
    return h.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("long").alias(c) for c in ("width", "height", "bit_depth", "color_type", "channels", "pixel_depth", "row_bytes", "filter_stride")])


_register("headers", _headers, "SELECT CAST(vec_id AS BIGINT) AS image_id, 8::BIGINT AS width, 8::BIGINT AS height, 8::BIGINT AS bit_depth, 6::BIGINT AS color_type, 4::BIGINT AS channels, 32::BIGINT AS pixel_depth, 32::BIGINT AS row_bytes, 4::BIGINT AS filter_stride FROM embeddings")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk names and places, with the checksum recomputed by the built-in function."""
    from .sources.images import relation

    c = relation(_encoded(spark, sf_dir), "chunks")
    same = F.crc32(F.concat(F.encode("name", "US-ASCII"), F.col("payload"))) == F.col("crc")
    return c.select(F.col("image_id").cast("long").alias("image_id"), F.col("seq").cast("long").alias("seq"), "name", F.col("location").cast("long").alias("location"), (same & F.col("crc_ok")).alias("crc_ok"))


_register("chunks", _chunks, "SELECT CAST(vec_id AS BIGINT) AS image_id, seq, name, location, true AS crc_ok FROM embeddings, (VALUES (0::BIGINT, 'IHDR', 1::BIGINT), (1, 'IDAT', 8), (2, 'IEND', 8)) AS c(seq, name, location)")
_register("crc", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.crc32(F.concat(F.lit(b"tEXt"), F.encode("text", "UTF-8"))).alias("crc")))


def _text(mode: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts written as chunks and read again."""
        import pyarrow as pa

        from .sources import codec
        from .sources.images import relation

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("keyword"), F.regexp_replace("text", "[^\\x09-\\x7e]", "").alias("latin"), "text")
        good = docs.filter(md.valid_keyword(F.col("keyword")) & F.col("text").isNotNull()).select("doc_id", "keyword", F.col("text" if mode > 0 else "latin").alias("text"))
        head = codec.MAGIC + codec.chunk("IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0]))

        def write(batches):
            for batch in batches:
                made = [head + codec.text_chunk(mode, w, t, "xx", "k") for w, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["image_id", "content"])

        back = relation(good.mapInArrow(write, "image_id long, content binary"), "text")
        return back.select(F.col("image_id").cast("long").alias("doc_id"), F.col("compression").cast("long").alias("compression"), "keyword", "text")

    return run


_LATIN = r"regexp_replace(text, '[^\x09-\x7e]', '', 'g')"
for _name, _mode in (("text_roundtrip", -1), ("ztxt_roundtrip", 0), ("itxt_roundtrip", 1), ("itxt_compressed_roundtrip", 2)):
    _register(_name, _text(_mode), f"SELECT doc_id, {_mode}::BIGINT AS compression, lang AS keyword, {'text' if _mode > 0 else _LATIN} AS text FROM documents WHERE strlen(lang) BETWEEN 1 AND 79 AND text IS NOT NULL")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of files with one byte changed, a place a file; no damage fails the job."""
    from .sources.images import relation

    at = F.col("image_id") % F.length("content") + 1
    broken = F.concat(F.expr("substring(content, 1, cast(image_id % length(content) as int))"), F.lit(b"\x00"), F.expr("substring(content, cast(image_id % length(content) + 2 as int), length(content))"))
    return relation(_encoded(spark, sf_dir).select("image_id", F.when(at > 0, broken).alias("content")), "diagnostics")


_register("diagnostics", _damaged)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written into files and read back as values."""
    import numpy as np
    import pyarrow as pa

    from .sources import codec
    from .sources.images import relation

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("s"))
    one = np.zeros((1, 1, 3), np.int32)

    def write(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            made = [codec.encode(one, 8, 2, metadata={"gAMA": n + 1, "pHYs": [s, n % 100, 1], "oFFs": [-s, n, 0], "tIME": [2000 + s, n % 12 + 1, n % 28 + 1, n % 24, n % 60, s], "sRGB": n % 4}) for n, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["image_id", "content"])

    back = relation(part.mapInArrow(write, "image_id long, content binary"), "metadata")
    return back.select(F.col("image_id").cast("long").alias("p_partkey"), "name", "value")


_register("metadata_roundtrip", _metadata, "SELECT p_partkey, name, CASE name WHEN 'gAMA' THEN CAST(p_partkey + 1 AS VARCHAR) WHEN 'sRGB' THEN CAST(p_partkey % 4 AS VARCHAR) WHEN 'pHYs' THEN '[' || p_size || ', ' || p_partkey % 100 || ', 1]' WHEN 'oFFs' THEN '[' || -p_size || ', ' || p_partkey || ', 0]' ELSE '[' || 2000 + p_size || ', ' || p_partkey % 12 + 1 || ', ' || p_partkey % 28 + 1 || ', ' || p_partkey % 24 || ', ' || p_partkey % 60 || ', ' || p_size || ']' END AS value FROM part, (SELECT unnest(['gAMA', 'sRGB', 'pHYs', 'oFFs', 'tIME']) AS name)")


def _more_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other kinds of metadata, with values of each part."""
    import numpy as np
    import pyarrow as pa

    from .sources import codec
    from .sources.images import relation

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("s"), "p_brand")
    one = np.zeros((1, 1, 4), np.int32)

    def write(batches):
        for batch in batches:
            made = []
            for n, s, brand in zip(*(batch.column(i).to_pylist() for i in range(3))):
                made.append(codec.encode(one, 8, 6, metadata={
                    "cHRM": [n + i for i in range(8)], "cICP": [n % 256, s, 0, 1], "cLLI": [n, s], "mDCV": [*range(s, s + 8), n, s], "sBIT": {"red": n % 8 + 1, "green": 2, "blue": 3, "alpha": 4},
                    "bKGD": {"red": s, "green": 0, "blue": n % 256}, "sCAL": {"unit": 1, "width": f"{s}.5", "height": str(n)}, "eXIf": bytes([s, n % 256]), "pCAL": {"purpose": brand, "x0": -s, "x1": n, "equation": 0, "unit": "m", "parameters": [str(s), "2"]},
                    "iCCP": {"name": brand, "profile": bytes(128) + b"\0\0\0\2" + bytes([s])}, "sPLT": [{"name": brand, "depth": 8, "entries": [[s, 1, 2, 3, 4]]}]}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["image_id", "content"])

    back = relation(part.mapInArrow(write, "image_id long, content binary"), "metadata")
    return back.select(F.col("image_id").cast("long").alias("p_partkey"), "name", "value")


_MORE = {
    "cHRM": "'[' || concat_ws(', ', n, n + 1, n + 2, n + 3, n + 4, n + 5, n + 6, n + 7) || ']'", "cICP": "'[' || concat_ws(', ', n % 256, s, 0, 1) || ']'", "cLLI": "'[' || concat_ws(', ', n, s) || ']'",
    "mDCV": "'[' || concat_ws(', ', s, s + 1, s + 2, s + 3, s + 4, s + 5, s + 6, s + 7, n, s) || ']'", "sBIT": """'{"red": ' || n % 8 + 1 || ', "green": 2, "blue": 3, "gray": 0, "alpha": 4}'""",
    "bKGD": """'{"index": 0, "red": ' || s || ', "green": 0, "blue": ' || n % 256 || ', "gray": 0}'""", "sCAL": """'{"unit": 1, "width": "' || s || '.5", "height": "' || n || '"}'""",
    "eXIf": """'"' || lower(lpad(to_hex(s), 2, '0')) || lower(lpad(to_hex(n % 256), 2, '0')) || '"'""", "pCAL": """'{"purpose": "' || p_brand || '", "x0": ' || -s || ', "x1": ' || n || ', "equation": 0, "unit": "m", "parameters": ["' || s || '", "2"]}'""",
    "iCCP": """'{"name": "' || p_brand || '", "profile": "' || repeat('00', 128) || '00000002' || lower(lpad(to_hex(s), 2, '0')) || '"}'""", "sPLT": """'[{"name": "' || p_brand || '", "depth": 8, "entries": [[' || s || ', 1, 2, 3, 4]]}]'""",
}
_register("metadata_more", _more_metadata, f"WITH p AS (SELECT p_partkey, p_partkey AS n, CAST(p_size AS BIGINT) AS s, p_brand FROM part) SELECT p_partkey, name, CASE name {' '.join(f'WHEN {k!r} THEN {v}' for k, v in _MORE.items())} END AS value FROM p, (SELECT unnest({list(_MORE)}) AS name)")


def _read_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of grey, RGB and RGBA images read as one format, each kind by its own plan."""
    import uuid

    from . import api
    from .streaming.shared import shared_dir

    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    for n, k in enumerate(("v", "rgb", "rgba")):
        _encoded(spark, sf_dir, k, only=F.col("image_id") % 3 == n).write.mode("append").parquet(root)
    out = api.read_as(spark.read.schema("image_id long, content binary").parquet(root), "bgra")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "y", "x", "c0", "c1", "c2", "c3")])


_register("read_as", _read_as, f"{PX} SELECT image_id, y, x, CASE WHEN image_id % 3 = 0 THEN v ELSE b END AS c0, CASE WHEN image_id % 3 = 0 THEN v ELSE g END AS c1, CASE WHEN image_id % 3 = 0 THEN v ELSE r END AS c2, CASE WHEN image_id % 3 = 2 THEN a ELSE 255 END AS c3 FROM px")


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/part.parquet")
    v = F.col("p_partkey")
    found = md.header_problems(v % 7, v % 5 * 300_000, F.get(F.array(*map(F.lit, (1, 2, 3, 4, 8, 16))), (v % 6).cast("int")), v % 8, F.when(v % 13 == 0, 1).otherwise(0), F.when(v % 17 == 0, 1).otherwise(0), v % 3)
    return li.select("p_partkey", F.concat_ws("|", found).alias("problems"))


_PROBLEMS = [("w = 0", "Image width is zero in IHDR"), ("h = 0", "Image height is zero in IHDR"), ("w > 1000000 OR h > 1000000", "Invalid image size in IHDR"), ("d NOT IN (1, 2, 4, 8, 16)", "Invalid bit depth in IHDR"), ("c NOT IN (0, 2, 3, 4, 6)", "Invalid color type in IHDR"),
             ("c IN (0, 2, 3, 4, 6) AND NOT (c = 0 AND d IN (1, 2, 4, 8, 16) OR c = 3 AND d IN (1, 2, 4, 8) OR c IN (2, 4, 6) AND d IN (8, 16))", "Invalid color type/bit depth combination in IHDR"), ("cm <> 0", "Unknown compression method in IHDR"), ("fm <> 0", "Unknown filter method in IHDR"), ("im > 1", "Unknown interlace method in IHDR")]
_register("header_problems", _problems, "WITH h AS (SELECT p_partkey, p_partkey % 7 AS w, p_partkey % 5 * 300000 AS h, [1, 2, 3, 4, 8, 16][p_partkey % 6 + 1] AS d, p_partkey % 8 AS c, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS cm, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS fm, p_partkey % 3 AS im FROM part) SELECT p_partkey, concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _PROBLEMS) + ") AS problems FROM h")
_NAMES = ("IHDR", "gAMA", "tEXt", "zTXt", "vpAg", "prVt", "SAFe", "abCD")
_register("chunk_flags", lambda spark, d: spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", *md.chunk_flags(F.col("name"))),
          f"SELECT name, ascii(name) & 32 <> 0 AS ancillary, ascii(substr(name, 2, 1)) & 32 <> 0 AS private, ascii(substr(name, 3, 1)) & 32 <> 0 AS reserved, ascii(substr(name, 4, 1)) & 32 <> 0 AS safe_to_copy FROM (SELECT unnest({list(_NAMES)}) AS name)")
_register("signature", lambda spark, d: _encoded(spark, d, "v").select("image_id", (F.substring("content", 1, 8) == F.lit(b"\x89PNG\r\n\x1a\n")).alias("good"), (F.expr("substring(content, 3, 3)") == F.lit(b"NG\r")).alias("part")), "SELECT CAST(vec_id AS BIGINT) AS image_id, true AS good, true AS part FROM embeddings")
_register("unknown_policy", lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", md.unknown_kept(F.col("p_partkey") % 4, F.floor(F.col("p_partkey") / 4) % 4, F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0).alias("kept")),
          "WITH p AS (SELECT p_partkey, p_partkey % 4 AS named, p_partkey // 4 % 4 AS standard FROM part), q AS (SELECT p_partkey, CASE WHEN named <> 0 THEN named ELSE standard END AS policy FROM p) SELECT p_partkey, CASE policy WHEN 1 THEN false WHEN 3 THEN true WHEN 2 THEN p_partkey % 2 = 0 ELSE p_partkey % 3 = 0 END AS kept FROM q")


def _crc_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wrong checksum leads to, by chunk kind and action."""
    p, n = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    critical, ok, quiet = n % 3 == 0, n % 2 == 0, n % 5 == 0
    return p.select("p_partkey", F.when(ok, "use").when(critical, "error").when(quiet, "use").otherwise("discard").alias("outcome"), (~ok & ~critical & ~quiet).alias("warns"))


_register("crc_policy", _crc_policy, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'use' WHEN p_partkey % 3 = 0 THEN 'error' WHEN p_partkey % 5 = 0 THEN 'use' ELSE 'discard' END AS outcome, p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS warns FROM part")


def _sbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant bits spread over channels by colour type: grey mirrored, a missing alpha is the full depth."""
    p, n = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    color = F.get(F.array(*map(F.lit, (0, 2, 3, 4, 6))), (n % 5).cast("int"))
    gray, alpha = color.isin(0, 4), color.isin(4, 6)
    one = n % 8 + 1
    return p.select("p_partkey", one.alias("red"), F.when(gray, one).otherwise((n + 1) % 8 + 1).alias("green"), F.when(gray, one).otherwise((n + 2) % 8 + 1).alias("blue"), F.when(gray, one).otherwise(0).cast("long").alias("gray"), F.when(alpha, (n + 3) % 8 + 1).otherwise(8).cast("long").alias("alpha"))


_register("sbit_fill", _sbit, "WITH p AS (SELECT p_partkey, [0, 2, 3, 4, 6][p_partkey % 5 + 1] AS c FROM part) SELECT p_partkey, p_partkey % 8 + 1 AS red, CASE WHEN c IN (0, 4) THEN p_partkey % 8 + 1 ELSE (p_partkey + 1) % 8 + 1 END AS green, CASE WHEN c IN (0, 4) THEN p_partkey % 8 + 1 ELSE (p_partkey + 2) % 8 + 1 END AS blue, CASE WHEN c IN (0, 4) THEN p_partkey % 8 + 1 ELSE 0 END AS gray, CASE WHEN c IN (4, 6) THEN (p_partkey + 3) % 8 + 1 ELSE 8 END AS alpha FROM p")
_register("bkgd_resolve", lambda spark, d: palettes.expand(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 20).alias("bg")), fixtures.palette(spark), "bg").filter("bg < 16").select("p_partkey", "bg", "pr", "pg", "pb"), f"WITH {fixtures.PALETTE_SQL} SELECT p_partkey, idx AS bg, pr, pg, pb FROM part JOIN pal ON idx = p_partkey % 20")

# --- scalar functions -----------------------------------------------------------------------------------------------

_register("rfc1123", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", md.rfc1123(F.col("ts")).alias("text")), "SELECT event_id, strftime(ts, '%-d %b %Y %H:%M:%S') || ' +0000' AS text FROM events")


def _stored_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select("event_id", md.rfc1123_fields(n % 3000, n % 14, n % 33, n % 25, n % 61, n % 62).alias("text"))


_register("rfc1123_fields", _stored_time, "WITH t AS (SELECT event_id, event_id % 3000 AS y, event_id % 14 AS mo, event_id % 33 AS d, event_id % 25 AS h, event_id % 61 AS mi, event_id % 62 AS s FROM events) SELECT event_id, CASE WHEN mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND h <= 23 AND mi <= 59 AND s <= 60 THEN d || ' ' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][mo] || ' ' || lpad(CAST(y AS VARCHAR), 4, '0') || ' ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') || ' +0000' END AS text FROM t")
_register("time_fields", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", *[F.col("ts").cast("timestamp").alias("t")]).select("event_id", *[getattr(F, f)("t").cast("long").alias(f) for f in ("year", "month", "dayofmonth", "hour", "minute", "second")]), "SELECT event_id, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS dayofmonth, CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, CAST(second(ts) AS BIGINT) AS second FROM events")


def _part(name: str, cols: dict[str, Callable[[], Column]], sql: str) -> None:
    _register(name, lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *[c().alias(n) for n, c in cols.items()]), f"SELECT p_partkey, {sql} FROM part")


_part("dpi", {"dpi": lambda: md.dots_per_inch(F.col("p_size") * 79, (F.col("p_partkey") % 2).cast("int")), "ppm": lambda: md.pixels_per_metre(F.col("p_size").cast("long"), F.col("p_partkey") % 50, F.lit(1))}, "CASE WHEN p_partkey % 2 = 1 THEN CAST(floor(p_size * 79 * 0.0254::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS dpi, CASE WHEN p_size = p_partkey % 50 THEN CAST(p_size AS BIGINT) ELSE 0 END AS ppm")
_part("aspect_ratio", {"ratio": lambda: md.aspect_ratio(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"))}, "CASE WHEN p_partkey % 7 > 0 AND p_size > 0 THEN CAST(p_partkey % 7 AS DOUBLE) / CAST(p_size AS DOUBLE) ELSE 0.0::DOUBLE END AS ratio")
_part("offset_inches", {"inches": lambda: md.offset_inches((F.col("p_partkey") * 25400).cast("double"))}, "CAST(p_partkey * 25400 AS DOUBLE) * 0.00003937::DOUBLE AS inches")
_part("fixed_to_text", {"text": lambda: md.fixed_to_text(F.floor(F.col("p_retailprice") * 1000).cast("long") - 1_000_000), "short": lambda: md.fixed_to_text(F.col("p_size") * 2500)},
      "CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN abs(v) % 100000 = 0 THEN CAST(abs(v) // 100000 AS VARCHAR) ELSE (CASE WHEN abs(v) < 100000 THEN '' ELSE CAST(abs(v) // 100000 AS VARCHAR) END) || '.' || rtrim(lpad(CAST(abs(v) % 100000 AS VARCHAR), 5, '0'), '0') END AS text, CASE WHEN s % 100000 = 0 THEN CAST(s // 100000 AS VARCHAR) ELSE (CASE WHEN s < 100000 THEN '' ELSE CAST(s // 100000 AS VARCHAR) END) || '.' || rtrim(lpad(CAST(s % 100000 AS VARCHAR), 5, '0'), '0') END AS short")
ORACLE_SQL["fixed_to_text"] = ORACLE_SQL["fixed_to_text"].replace("FROM part", "FROM (SELECT *, CAST(floor(p_retailprice * 1000) AS BIGINT) - 1000000 AS v, CAST(p_size AS BIGINT) * 2500 AS s FROM part)")
_NUMBERS = ("1", "+2.5", "-3", ".5", "5.", ".", "", "1e5", "1E-3", "1e", "2.5.1", "0x1", " 1", "1 ", "+", "+.e1", "9.99e+12")
_register("number_grammar", lambda spark, d: spark.createDataFrame([(n,) for n in _NUMBERS], "text string").select("text", md.is_number(F.col("text")).alias("good")), f"SELECT text, regexp_full_match(text, '\\+?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS good FROM (SELECT unnest({list(_NUMBERS)}) AS text)")
# A value beyond 32 bits takes two words.
_words = lambda b: md.uint(b, 0, 4) * (1 << 32) + md.uint(b, 4, 4)
_part("big_endian", {"u32": lambda: _words(md.uint_bytes(F.col("p_partkey") * 7919, 8)), "u16": lambda: md.uint(md.uint_bytes(F.col("p_partkey") % 65536, 2), 0, 2), "signed": lambda: md.int32(md.uint_bytes(F.col("p_partkey") * 1_000_003 % (1 << 32), 4), 0)}, "p_partkey * 7919 AS u32, p_partkey % 65536 AS u16, CASE WHEN p_partkey * 1000003 % 4294967296 > 2147483648 THEN p_partkey * 1000003 % 4294967296 - 4294967296 ELSE p_partkey * 1000003 % 4294967296 END AS signed")
_XY = {"wx": 0.3127, "wy": 0.329, "rx": 0.64, "ry": 0.33, "gx": 0.3, "gy": 0.6, "bx": 0.15, "by": 0.06}


def _xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and back again, in millionths."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    xy = {n: F.lit(v) + (F.col("p_size") / 10000.0 if n == "wx" else F.lit(0.0)) for n, v in _XY.items()}
    xyz = md.xyz_of_chromaticities(xy)
    back = md.chromaticities_of_xyz(xyz)
    near = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    return p.select("p_partkey", near(xyz["r_x"] + xyz["g_x"] + xyz["b_x"]).alias("sum_x"), near(xyz["r_y"] + xyz["g_y"] + xyz["b_y"]).alias("sum_y"), *[near(back[n]).alias(n) for n in ("wx", "wy", "rx", "ry", "gx", "by")])


_register("chromaticity_xyz", _xyz, "SELECT p_partkey, CAST(floor((0.3127::DOUBLE + p_size / 10000.0::DOUBLE) / 0.329::DOUBLE * 1e6 + 0.5) AS BIGINT) AS sum_x, 1000000::BIGINT AS sum_y, CAST(floor((0.3127::DOUBLE + p_size / 10000.0::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS wx, 329000::BIGINT AS wy, 640000::BIGINT AS rx, 330000::BIGINT AS ry, 300000::BIGINT AS gx, 60000::BIGINT AS by FROM part")


# --- formats and colour maps ----------------------------------------------------------------------------------------


def _converted(name: str, want: str, shape: Shape, cols: list[str], sql: list[str], **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = formats.conversion(shape, False, want, **options).apply(fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", *cols))
        return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])

    _register(name, run, f"{PX} SELECT image_id, y, x, {', '.join(f'CAST({e} AS BIGINT) AS c{i}' for i, e in enumerate(sql))} FROM px")


_converted("format_bgra", "bgra", RGB8, ["r", "g", "b"], ["b", "g", "r", "255"])
_converted("format_argb_16", "argb", Shape(8, 16, 6, 4), ["r16", "g16", "b16", "a16"], [f"({c} + 128) // 257" for c in ("a16", *RGB16)])
_converted("format_gray", "gray", RGB8, ["r", "g", "b"], [_gray("r", "g", "b", 0)])
_converted("format_rgb_on_background", "rgb", RGBA8, ["r", "g", "b", "a"], [_blend8(c, "a", str(b)) for c, b in zip(RGB, (10, 20, 30))], background=(10, 20, 30))
_converted("format_linear_rgb", "linear_rgb", RGB8, ["r", "g", "b"], [f"({_lut8(c, 219_998)}) * 257" for c in RGB])
_register("describe", lambda spark, d: formats.describe(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("image_id"), F.get(F.array(*map(F.lit, (1, 2, 4, 8, 16))), (F.col("p_partkey") % 5).cast("int")).alias("bit_depth"), F.get(F.array(*map(F.lit, (0, 2, 3, 4, 6))), (F.col("p_partkey") % 7 % 5).cast("int")).alias("color_type"), (F.col("p_partkey") % 3 == 0).alias("transparent"), (F.col("p_partkey") % 300).alias("n_palette"))),
          "WITH h AS (SELECT p_partkey AS image_id, [1, 2, 4, 8, 16][p_partkey % 5 + 1] AS depth, [0, 2, 3, 4, 6][p_partkey % 7 % 5 + 1] AS kind, p_partkey % 3 = 0 AS t, p_partkey % 300 AS n FROM part) SELECT image_id, kind IN (2, 3, 6) AS color, kind IN (4, 6) OR t AS alpha, depth = 16 AS linear, kind = 3 AS colormap, CAST(CASE WHEN kind = 3 THEN least(n, 256) WHEN kind = 0 AND depth <= 8 THEN CAST(pow(2, depth) AS BIGINT) ELSE 256 END AS BIGINT) AS entries FROM h")
_register("color_cube_entries", lambda spark, d: formats.cube_entries(spark), "SELECT i AS idx, i // 36 * 51 AS r, i // 6 % 6 * 51 AS g, i % 6 * 51 AS b FROM range(216) AS t(i)")
_register("gray_alpha_entries", lambda spark, d: formats.gray_alpha_entries(spark), "SELECT i AS idx, CASE WHEN i < 231 THEN (i * 256 + 115) // 231 WHEN i = 231 THEN 255 ELSE (i - 232) % 6 * 51 END AS gray, CASE WHEN i < 231 THEN 255 WHEN i = 231 THEN 0 ELSE ((i - 232) // 6 + 1) * 51 END AS alpha FROM range(256) AS t(i)")
_register("rgba_entries", lambda spark, d: formats.rgba_entries(spark), "WITH t AS (SELECT i, i - 217 AS j, [0, 127, 255] AS l FROM range(244) AS t(i)) SELECT i AS idx, CASE WHEN i < 216 THEN i // 36 * 51 WHEN i = 216 THEN 255 ELSE CAST(l[CAST(j // 9 AS BIGINT) + 1] AS BIGINT) END AS r, CASE WHEN i < 216 THEN i // 6 % 6 * 51 WHEN i = 216 THEN 255 ELSE CAST(l[CAST(j // 3 % 3 AS BIGINT) + 1] AS BIGINT) END AS g, CASE WHEN i < 216 THEN i % 6 * 51 WHEN i = 216 THEN 255 ELSE CAST(l[CAST(j % 3 AS BIGINT) + 1] AS BIGINT) END AS b, CASE WHEN i < 216 THEN 255 WHEN i = 216 THEN 0 ELSE 128 END AS a FROM t")


def _buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fixtures.pixels(spark, sf_dir)
    v = F.floor(F.col("v") * _alpha3() / 255)
    return px.select("image_id", "y", "x", formats.composite_on_buffer(v, _alpha3(), F.col("g"), indexed=True).alias("v"), _alpha3().cast("long").alias("a"))


_register("composite_on_buffer", _buffered, f"{PX}, f AS (SELECT image_id, y, x, v * {_ALPHA3} // 255 AS v, {_ALPHA3} AS a, g AS d FROM px) SELECT image_id, y, x, CASE WHEN a = 0 THEN d WHEN a = 255 THEN v ELSE v + ((255 - a) * d + 127) // 255 END AS v, CAST(a AS BIGINT) AS a FROM f")
_pixels("premultiplied_gray_16", {"v": lambda: formats.premultiplied_gray(col("v16"), col("a16")), "black": lambda: formats.on_black(col("v16"), col("a"))},
        {"v": "(v16 * a16 + 32767) // 65535", "black": "(v16 * a * 257 + v16 * a * 257 // 65536 + 32768) // 65536"})
_BOUNDS = {e: gm.narrowing_bounds(e, 5) for e in (FROM, TO)}
_pixels("gamma_16_narrowing", {f"e{e}": (lambda e=e: gm.curve_16_narrowing(e, 5)(col("v16"))) for e in (FROM, TO)}, {f"e{e}": f"257 * len(list_filter({b}, lambda z: z <= v16 // 32))" for e, b in _BOUNDS.items()})
_TEXT = "CASE WHEN v >= 100000 THEN '1' ELSE rtrim(CAST(v AS VARCHAR), '0') END"
_part("double_to_text", {"text": lambda: md.double_to_text(F.col("p_retailprice") * 1000 - 1_000_000), "tiny": lambda: md.double_to_text(F.col("p_size") / 1_000_000)},
      "CASE WHEN t.x < 0 THEN '-' ELSE '' END || CASE WHEN length(t.plain) <= length(t.power) THEN t.plain ELSE t.power END AS text, CASE WHEN length(s.plain) <= length(s.power) THEN s.plain ELSE s.power END AS tiny")


def _text_sql(x: str) -> str:
    """The same text by DuckDB expressions over one value."""
    at = "CASE WHEN {e} >= 4 THEN m / pow(10.0::DOUBLE, ({e} - 4)::DOUBLE) ELSE m * pow(10.0::DOUBLE, (4 - {e})::DOUBLE) END"
    return (
        f"SELECT p_partkey, x, CASE WHEN e < 0 THEN '.' || repeat('0', CAST(-e - 1 AS INT)) || d WHEN e + 1 >= length(d) THEN d || repeat('0', CAST(e + 1 - length(d) AS INT)) ELSE substr(d, 1, e + 1) || '.' || substr(d, e + 2) END AS plain, d || 'E' || CAST(e - length(d) + 1 AS VARCHAR) AS power "
        f"FROM (SELECT p_partkey, x, {_TEXT} AS d, CASE WHEN v >= 100000 THEN low + 1 ELSE low END AS e FROM (SELECT *, CAST(floor(({at.format(e='low')}) + 0.5) AS BIGINT) AS v FROM (SELECT *, CASE WHEN ({at.format(e='g')}) < 10000 THEN g - 1 WHEN ({at.format(e='g')}) >= 100000 THEN g + 1 ELSE g END AS low FROM (SELECT *, CAST(floor(log10(m)) AS INT) AS g FROM (SELECT p_partkey, {x} AS x, abs({x}) AS m FROM part)))))"
    )


ORACLE_SQL["double_to_text"] = ORACLE_SQL["double_to_text"].replace("SELECT p_partkey,", "SELECT t.p_partkey,").replace("FROM part", f"FROM ({_text_sql('(p_retailprice * 1000 - 1000000)')}) t JOIN ({_text_sql('(p_size / 1000000.0::DOUBLE)')}) s ON t.p_partkey = s.p_partkey")


# --- streaming ------------------------------------------------------------------------------------------------------


def _progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut into slices, delivered as a stream of several batches, decoded as they are completed."""
    import uuid

    from .streaming.progressive import progressive_rows
    from .streaming.shared import shared_dir

    root = f"{shared_dir(spark)}/progressive-{uuid.uuid4().hex}"
    cut = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 100).cast("int"))
    slices = _encoded(spark, sf_dir, "v").select("image_id", "content", F.explode(cut).alias("seq"))
    slices = slices.select("image_id", F.col("seq").cast("int").alias("seq"), F.expr("substring(content, seq * 100 + 1, 100)").alias("bytes"))
    slices.withColumn("late", F.col("seq") % 2).repartition(4, "late").drop("late").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("image_id long, seq int, bytes binary").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = progressive_rows(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    done = spark.read.schema("image_id long, y int, samples array<int>, message string").parquet(f"{root}/out")
    return done.select("image_id", F.col("y").cast("long").alias("y"), F.posexplode("samples").alias("x", "v")).select("image_id", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


_register("progressive_rows", _progressive, f"{PX} SELECT image_id, y, x, v FROM px")


def _pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of interlaced files, pushed in slices of 100 bytes."""
    from .streaming.progressive import slice_events

    cut = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 100).cast("int"))
    slices = _encoded(spark, sf_dir, "v", interlaced=True).select("image_id", "content", F.explode(cut).alias("seq"))
    return slice_events(slices.select("image_id", F.col("seq").cast("int").alias("seq"), F.expr("substring(content, seq * 100 + 1, 100)").alias("bytes")))


def _pushed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pushed(spark, sf_dir).filter("kind = 'row'").select("image_id", F.col("pass").cast("long").alias("pass"), F.col("pass_row").cast("long").alias("pass_y"), F.posexplode("samples").alias("pass_x", "v"))
    out = geometry.deinterlace(rows.withColumn("pass_x", F.col("pass_x").cast("long")))
    return out.select("image_id", "pass", "y", "x", F.col("v").cast("long").alias("v"))


_register("push_rows", _pushed_rows, f"{PX} SELECT image_id, CAST({_PASS_SQL} AS BIGINT) AS pass, y, x, v FROM px")
_register("push_passes", lambda spark, d: _pushed(spark, d).filter("kind in ('pass_end', 'end', 'header')").groupBy("image_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("pass_row").cast("long").alias("rows")),
          "SELECT CAST(vec_id AS BIGINT) AS image_id, kind, n, rows FROM embeddings, (VALUES ('header', 1::BIGINT, 0::BIGINT), ('pass_end', 7, 15), ('end', 1, 0)) AS e(kind, n, rows)")


# --- files of many kinds, read as one format ------------------------------------------------------------------------


def _stored(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    """Files of several encoders, written once."""
    import uuid

    from .streaming.shared import shared_dir

    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    for p in parts:
        p.write.mode("append").parquet(root)
    return spark.read.schema("image_id long, content binary").parquet(root)


GENERATED = [(7 * i % 256, 13 * i % 256, 29 * i % 256) for i in range(16)]
GENERATED_ALPHA = [32 * i for i in range(8)]


def _indexed_files(spark: SparkSession, sf_dir: str, only: Column | None = None, **options) -> DataFrame:
    from .sources.images import encode_images

    px = fixtures.pixels(spark, sf_dir)
    px = px if only is None else px.filter(only)
    return encode_images(px.select("image_id", "y", "x", "idx"), None, ["idx"], 4, 3, palette=GENERATED, alpha=GENERATED_ALPHA, **options)


def _plain_files(spark: SparkSession, sf_dir: str, cols: list[str], depth: int, color: int, only: Column | None = None, **options) -> DataFrame:
    from .sources.images import encode_images

    px = fixtures.pixels(spark, sf_dir)
    px = px if only is None else px.filter(only)
    return encode_images(px.select("image_id", "y", "x", *cols), None, cols, depth, color, **options)


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])


def _read(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _register(name, lambda spark, d: _longs(make(spark, d)), sql)


def _read_files(name: str, files: Callable[[SparkSession, str], DataFrame], want: str, exprs: list[str], source: str = "px JOIN pal USING (idx)", **options) -> None:
    from . import api

    cols = ", ".join(f"CAST({e} AS BIGINT) AS c{i}" for i, e in enumerate(exprs))
    _read(name, lambda spark, d: api.read_as(files(spark, d), want, **options), f"{PAL} SELECT image_id, y, x, {cols} FROM {source}")


PRGB = ("pr", "pg", "pb")
_LIGHT_FILE = {"metadata": {"gAMA": 100_000}}
_premultiplied = lambda c: f"257 * (CASE WHEN pa = 255 THEN {_lut8(c, 219_998)} WHEN pa = 0 THEN 0 ELSE {_blend8(_lut8(c, 219_998), 'pa', '0')} END)"
_read_files("read_as_indexed", _indexed_files, "rgba", [*PRGB, "pa"])
_read_files("read_as_indexed_gamma", lambda s, d: _indexed_files(s, d, **_LIGHT_FILE), "rgba", [*(_lut8(c, 45_455) for c in PRGB), "pa"])
_read_files("read_as_linear", _indexed_files, "linear_rgba", [*map(_premultiplied, PRGB), "pa * 257"])
_read_files("read_as_indexed_on_background", lambda s, d: _indexed_files(s, d, **_LIGHT_FILE), "rgb", [
    f"CASE WHEN pa = 255 THEN {_lut8(c, 45_455)} WHEN pa = 0 THEN {b} ELSE {_lut8(_blend8(c, 'pa', f'({_lut8(str(b), 220_000)})'), 45_455)} END" for c, b in zip(PRGB, (10, 20, 30))], background=(10, 20, 30))


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed, RGB and 16-bit grey files; the first and the last say that they hold light."""
    n = F.col("image_id") % 3
    return _stored(spark, _indexed_files(spark, sf_dir, n == 0, **_LIGHT_FILE), _plain_files(spark, sf_dir, ["r", "g", "b"], 8, 2, n == 1), _plain_files(spark, sf_dir, ["v16"], 16, 0, n == 2, metadata={"gAMA": 100_000, "sBIT": {"gray": 16}}))


#: The 255 bounds at which 16-bit light, cut by 5 bits, changes its sRGB-like byte.
_EDGES = "[least(CAST(floor(65535 * pow((b * 257 + 128) / 65535.0::DOUBLE, 2.19998::DOUBLE) + 0.5) AS BIGINT) * 2047 + 32768, 2047 * 65535 + 65534) // 65535 + 1 for b in range(255)]"
_read_files("read_as_mixed", _mixed_files, "rgb", [
    f"CASE image_id % 3 WHEN 0 THEN {_lut8(p, 45_455)} WHEN 1 THEN {c} ELSE len(list_filter({_EDGES}, lambda z: z <= v16 // 32)) END" for p, c in zip(PRGB, RGB)])
ORACLE_SQL["read_as_mixed"] = ORACLE_SQL["read_as_mixed"].replace(_EDGES, "edges").replace("FROM px JOIN", f"FROM (SELECT {_EDGES} AS edges) AS e, px JOIN")
_read_files("read_as_16", lambda s, d: _plain_files(s, d, ["r16", "g16", "b16"], 16, 2), "rgb", [f"({c} + 128) // 257" for c in RGB16], "px")
_read_files("read_as_16_light", lambda s, d: _plain_files(s, d, ["r16", "g16", "b16"], 16, 2), "rgb", [f"len(list_filter(edges, lambda z: z <= {c} // 32))" for c in RGB16], f"(SELECT {_EDGES} AS edges) AS e, px", wide_is_srgb=False)


def _read_with_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import api

    return api.read_with(_indexed_files(spark, sf_dir, metadata={"gAMA": 70_000}), {"expand", "gamma", "filler"}, Settings(file_gamma=45_455, screen_gamma=100_000))


_read("read_with_gamma_indexed", _read_with_gamma, f"{PAL} SELECT image_id, y, x, {', '.join(f'CAST({_lut8(c, 142_857)} AS BIGINT) AS c{i}' for i, c in enumerate(PRGB))}, pa AS c3 FROM px JOIN pal USING (idx)")


def _over_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import api

    buffer = fixtures.pixels(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("c0"), F.col("g").alias("c1"), F.col("b").alias("c2"))
    return api.read_over(_plain_files(spark, sf_dir, ["v", "a"], 8, 4, metadata={"gAMA": 100_000}), "rgb", buffer)


_SRGB_LIGHT = lambda v: f"floor(65535 * (CASE WHEN ({v}) / 255.0::DOUBLE <= 0.04045 THEN ({v}) / 255.0::DOUBLE / 12.92 ELSE pow((({v}) / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END) + 0.5)"
_read("read_over_buffer", _over_buffer, f"{PX} SELECT image_id, y, x, " + ", ".join(
    f"CAST(CASE WHEN a = 0 THEN {c} WHEN a = 255 THEN {_lut8('v', 45_455)} ELSE {_S(f'(least({_blend8(chr(118), chr(97), chr(48))} * 65535 + (255 - a) * {_SRGB_LIGHT(c)}, 255 * 65535) / 255.0::DOUBLE / 65535.0::DOUBLE)')} END AS BIGINT) AS c{i}" for i, c in enumerate(RGB)) + " FROM px")

# --- colour maps ----------------------------------------------------------------------------------------------------


def _mapped(name: str, files: Callable[[SparkSession, str], DataFrame], want: str, index: str, exprs: list[str], source: str = "px", **options) -> None:
    """Each pixel's index beside the entry that its image's map has for it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import api

        indices, entries = api.read_indexed(files(spark, sf_dir), want, **options)
        return _longs(indices.join(entries, ["image_id", "idx"]).select("image_id", "y", "x", "idx", *[f"c{i}" for i in range(len(exprs))]))

    cols = ", ".join(f"CAST({e} AS BIGINT) AS c{i}" for i, e in enumerate(exprs))
    inner = f"SELECT *, CAST({index} AS BIGINT) AS entry FROM {source}"
    _register(name, run, f"{PAL} SELECT image_id, y, x, entry AS idx, {cols} FROM ({inner})")


_light_of = lambda v: _S(f"(({v}) * 257 / 65535.0::DOUBLE)")
_div51 = lambda c: f"((5 * {c} + 130) // 256)"
_CUBE = f"({_div51('r')} * 6 + {_div51('g')}) * 6 + {_div51('b')}"
_mapped("colormap_gray", lambda s, d: _plain_files(s, d, ["idx"], 4, 0, **_LIGHT_FILE), "rgba", "idx", [_light_of("entry * 17")] * 3 + ["255"])
_mapped("colormap_gray_key", lambda s, d: _plain_files(s, d, ["idx"], 4, 0, key=(5,)), "rgb", "idx", [f"CASE WHEN entry = 5 THEN {b} ELSE entry * 17 END" for b in (10, 20, 30)], background=(10, 20, 30))
_mapped("colormap_gray_16", lambda s, d: _plain_files(s, d, ["v16"], 16, 0), "linear_gray", "(v16 + 128) // 257", [_SRGB_LIGHT("entry")])
_mapped("colormap_rgb_to_gray", lambda s, d: _plain_files(s, d, ["r", "g", "b"], 8, 2), "gray", f"CASE WHEN r = g AND r = b THEN r ELSE {_lut8(_gray(*(_lut8(c, 219_998) for c in RGB), 16384), 45_455)} END", ["entry"])
_AT = f"CAST(floor(({_SRGB_LIGHT('20')} * 255 + 32767) / 65535) AS BIGINT)"
_mapped("colormap_rgba_to_gray", lambda s, d: _plain_files(s, d, ["r", "g", "b", "a"], 8, 6, **_LIGHT_FILE), "gray", _blend8(_gray("r", "g", "b", 0), "a", _AT), [f"CASE WHEN entry = {_AT} THEN 20 ELSE {_light_of('entry')} END"], background=(10, 20, 30))
_mapped("colormap_palette", lambda s, d: _indexed_files(s, d, **_LIGHT_FILE), "bgra", "idx", [*(_light_of(c) for c in ("pb", "pg", "pr")), "pa"], "px JOIN pal USING (idx)")
_mapped("colormap_palette_on_background", _indexed_files, "rgb", "idx", [
    f"CASE WHEN pa = 255 THEN {c} WHEN pa = 0 THEN {b} ELSE {_S(f'(({_SRGB_LIGHT(c)} * pa + {_SRGB_LIGHT(str(b))} * (255 - pa)) / 255.0::DOUBLE / 65535.0::DOUBLE)')} END" for c, b in zip(PRGB, (10, 20, 30))], "px JOIN pal USING (idx)", background=(10, 20, 30))
_GA = "CASE WHEN a > 229 THEN (231 * v + 128) // 256 WHEN a < 26 THEN 231 ELSE 226 + 6 * ((5 * a + 130) // 256) + (5 * v + 130) // 256 END"
_mapped("colormap_gray_alpha", lambda s, d: _plain_files(s, d, ["v", "a"], 8, 4), "gray_alpha", _GA, ["CASE WHEN entry < 231 THEN (entry * 256 + 115) // 231 WHEN entry = 231 THEN 255 ELSE (entry - 232) % 6 * 51 END", "CASE WHEN entry < 231 THEN 255 WHEN entry = 231 THEN 0 ELSE ((entry - 232) // 6 + 1) * 51 END"])
_mapped("colormap_gray_alpha_composed", lambda s, d: _plain_files(s, d, ["v", "a"], 8, 4), "gray", f"CASE WHEN a = 255 THEN v WHEN a = 0 THEN 20 ELSE {_lut8(_blend8(_lut8('v', 219_998), 'a', '(' + _lut8('20', 220_000) + ')'), 45_455)} END", ["entry"], background=(10, 20, 30))
_mapped("colormap_rgb", lambda s, d: _plain_files(s, d, ["r", "g", "b"], 8, 2), "bgr", _CUBE, ["entry % 6 * 51", "entry // 6 % 6 * 51", "entry // 36 * 51"])
_mapped("colormap_rgba", lambda s, d: _plain_files(s, d, ["r", "g", "b", "a"], 8, 6), "rgba", f"CASE WHEN a >= 196 THEN {_CUBE} WHEN a < 64 THEN 216 ELSE 217 + {_half('r', 9)} + {_half('g', 3)} + {_half('b', 1)} END", [
    *(f"CASE WHEN entry < 216 THEN entry // {w} % 6 * 51 WHEN entry = 216 THEN 255 ELSE [0, 127, 255][CAST((entry - 217) // {u} % 3 + 1 AS BIGINT)] END" for w, u in ((36, 9), (6, 3), (1, 1))), "CASE WHEN entry < 216 THEN 255 WHEN entry = 216 THEN 0 ELSE 128 END"])


def _mapped_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices and a map a format holds, written as indexed files and read as RGBA."""
    from . import api

    px = fixtures.pixels(spark, sf_dir)
    pal = fixtures.palette(spark)
    entries = px.select("image_id", "idx").distinct().select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("idx"))
    entries = entries.join(F.broadcast(pal), "idx").select("image_id", "idx", F.col("pa").alias("c0"), F.col("pb").alias("c1"), F.col("pg").alias("c2"), F.col("pr").alias("c3"))
    return api.read_as(api.write_indexed(px.select("image_id", "y", "x", "idx"), entries, "abgr"), "rgba")


_read("colormap_write", _mapped_write, f"{PAL} SELECT image_id, y, x, pr AS c0, pg AS c1, pb AS c2, pa AS c3 FROM px JOIN pal USING (idx)")
