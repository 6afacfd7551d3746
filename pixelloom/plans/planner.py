"""Requests to an ordered, schema-checked list of steps, before any row is read.

A step is a row of ``STEPS``: when it is wanted, for which shapes it acts, and the shape it leaves. The table's order is the
canonical one, so the order of requests never matters. ``Plan.apply`` turns the steps into column expressions. An indexed image's
colours are in its palette, so what corrects or blends colours runs there, over at most 256 rows an image, before any look-up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gamma as curves
from ..functions import kernels as k
from ..operators import palettes

REQUESTS = frozenset(
    "expand expand_transparency expand_gray strip_alpha gray_to_rgb strip_16 scale_16 expand_16 packing pack_swap bgr swap_bytes swap_alpha invert_alpha invert_mono "
    "filler add_alpha shift gamma rgb_to_gray compose alpha_mode quantize user_transform".split()
)


@dataclass(frozen=True)
class Shape:
    """The schema of rows at one point of a plan. ``channels`` may exceed the colour type's: a filler is not alpha."""

    width: int
    depth: int
    color: int
    channels: int

    @property
    def indexed(self) -> bool:
        return self.color == 3

    @property
    def has_color(self) -> bool:
        return bool(self.color & 2)

    @property
    def has_alpha(self) -> bool:
        return bool(self.color & 4)

    @property
    def row_bytes(self) -> int:
        return (self.width * self.channels * self.depth + 7) // 8


@dataclass(frozen=True)
class Settings:
    """Parameters of requests. Gammas are in 1/100000; colours are samples of the image's own depth.

    ``file_gamma`` and ``key`` may be columns, so that one plan serves images that differ in them. ``sample_bits`` are the significant bits of
    16-bit samples (0: all), ``quantize_map`` is where an indexed image's old indices go. ``light``: averaging and blending go through linear
    light wherever a gamma matters by itself, even if file and screen cancel out; otherwise only where the whole correction matters.
    """

    file_gamma: int | Column = 0
    screen_gamma: int = 0
    background: tuple[int, ...] = (0, 0, 0)
    background_linear: tuple[int, ...] = (0, 0, 0)
    key: tuple[int | Column, ...] = (0, 0, 0)
    sample_bits: int = 0
    light: bool = False
    quantize_map: tuple[int, ...] = ()
    alpha_mode: str = "png"
    significant: tuple[int, ...] = (8, 8, 8, 8)
    filler: int = 255
    filler_after: bool = True
    quantize_palette: tuple[tuple[int, int, int], ...] = ()
    user: Callable[[dict[str, Column]], dict[str, Column]] | None = None


@dataclass(frozen=True)
class _Context:
    asked: frozenset
    start: Shape
    transparent: bool
    s: Settings

    @property
    def composes(self) -> bool:
        return "compose" in self.asked and (self.start.has_alpha or self.transparent)

    @property
    def arranges(self) -> bool:
        return "alpha_mode" in self.asked and self.s.alpha_mode != "png" and not self.composes and (self.start.has_alpha or self.transparent)

    @property
    def premultiplies(self) -> bool:
        return self.arranges and not self.start.indexed and (self.start.has_alpha or "expand_transparency" in self.asked)

    @property
    def keys_only(self) -> bool:
        st = self.start
        return self.arranges and not st.indexed and not st.has_alpha and self.transparent and "expand_transparency" not in self.asked and st.depth >= 8

    @property
    def gamma_is_owned(self) -> bool:
        """Another step takes over the curve, even where that step turns out to do nothing."""
        return "rgb_to_gray" in self.asked or self.composes or self.premultiplies or self.keys_only or (self.arranges and self.start.indexed)

    @property
    def exponent(self) -> int | Column | None:
        return curves.correction_exponent(self.s.file_gamma, self.s.screen_gamma)

    @property
    def corrects(self) -> bool:
        """Whether a correction may be in force: a column of gammas decides row by row."""
        return "gamma" in self.asked and self.exponent is not None and (isinstance(self.exponent, Column) or curves.significant(self.exponent))

    @property
    def narrows(self) -> bool:
        return self.start.depth == 16 and bool({"scale_16", "strip_16"} & self.asked)

    @property
    def coarse(self) -> int:
        """Low bits that 16-bit curves leave out."""
        return curves.wide_shift(self.s.sample_bits, self.narrows) if self.start.depth == 16 else 0


def resolve(asked: set[str] | frozenset, start: Shape, transparent: bool) -> frozenset:
    """Requests implied by others are added, and contradicted ones go."""
    unknown = set(asked) - REQUESTS
    if unknown:
        raise ValueError(f"unknown requests: {sorted(unknown)}")
    a, low_gray = set(asked), start.color == 0 and start.depth < 8
    if "expand" in a:
        a |= ({"expand_transparency"} if start.indexed else set()) | ({"expand_gray"} if low_gray else set())
    if "expand_transparency" in a and start.indexed:
        a.add("expand")
    if not transparent and not start.indexed:
        a.discard("expand_transparency")
    if "compose" in a and transparent and not start.indexed:
        a |= {"expand", "expand_transparency"}
    if "rgb_to_gray" in a and start.indexed:
        a.add("expand")
    if "gray_to_rgb" in a and low_gray:
        a.add("expand_gray")
    if "scale_16" in a:
        a.discard("strip_16")
    if "expand_16" in a and start.depth < 16:
        a.discard("swap_bytes")
    return frozenset(a)


Guard = Callable[[Shape], bool]
_wide: Guard = lambda s: s.depth >= 8
_never_pruned: Guard = lambda s: True


@dataclass(frozen=True)
class Step:
    name: str
    wanted: Callable[[_Context], bool]
    acts: Guard = _never_pruned
    after: Callable[[Shape, _Context], Shape] = lambda s, c: s


def _asks(name: str) -> Callable[[_Context], bool]:
    return lambda c: name in c.asked


def _without_alpha(s: Shape, c: _Context) -> Shape:
    return replace(s, color=s.color & ~4, channels=s.channels - 1)


#: The canonical order. Steps that reshape are dropped where their guard fails.
STEPS: tuple[Step, ...] = (
    Step("expand_palette", lambda c: "expand" in c.asked and c.start.indexed, lambda s: s.indexed, lambda s, c: replace(s, color=6 if c.transparent else 2, channels=4 if c.transparent else 3, depth=8)),
    Step("expand_gray", _asks("expand_gray"), lambda s: s.color == 0 and s.depth < 8, lambda s, c: replace(s, depth=8)),
    Step("expand_transparency", lambda c: "expand_transparency" in c.asked and not c.start.indexed and c.transparent, lambda s: not s.has_alpha and not s.indexed and s.depth >= 8, lambda s, c: replace(s, color=s.color | 4, channels=s.channels + 1)),
    Step("rgb_to_gray", _asks("rgb_to_gray"), lambda s: s.has_color and not s.indexed and s.depth >= 8, lambda s, c: replace(s, color=s.color & ~2, channels=2 if s.has_alpha else 1)),
    Step("gray_to_rgb", _asks("gray_to_rgb"), lambda s: not s.has_color and s.depth >= 8, lambda s, c: replace(s, color=s.color | 2, channels=4 if s.has_alpha else 3)),
    Step("compose", lambda c: c.composes, lambda s: s.has_alpha and s.depth >= 8, _without_alpha),
    Step("alpha_mode", lambda c: c.premultiplies),
    Step("compose_key", lambda c: c.keys_only),
    Step("encode_alpha", lambda c: c.arranges and c.start.indexed and c.s.alpha_mode == "broken" and "expand" in c.asked and c.transparent),
    Step("strip_alpha", _asks("strip_alpha"), lambda s: s.has_alpha and s.depth >= 8, _without_alpha),
    Step("gamma", lambda c: "gamma" in c.asked and not c.start.indexed and not c.gamma_is_owned and c.corrects),
    Step("scale_16", _asks("scale_16"), lambda s: s.depth == 16, lambda s, c: replace(s, depth=8)),
    Step("strip_16", _asks("strip_16"), lambda s: s.depth == 16, lambda s, c: replace(s, depth=8)),
    Step("quantize", _asks("quantize"), _never_pruned, lambda s, c: replace(s, color=3, channels=1) if c.s.quantize_palette and s.depth == 8 and s.color in (2, 6) else s),
    Step("expand_16", _asks("expand_16"), lambda s: s.depth == 8, lambda s, c: replace(s, depth=16)),
    Step("invert_mono", _asks("invert_mono")),
    Step("invert_alpha", _asks("invert_alpha")),
    Step("shift", _asks("shift")),
    Step("packing", _asks("packing"), lambda s: s.depth < 8, lambda s, c: replace(s, depth=8)),
    Step("bgr", _asks("bgr")),
    Step("pack_swap", _asks("pack_swap")),
    Step("swap_alpha", _asks("swap_alpha")),
    Step("filler", lambda c: bool({"filler", "add_alpha"} & c.asked), lambda s: s.depth >= 8 and not s.has_alpha and not s.indexed and s.channels < 4, lambda s, c: replace(s, channels=s.channels + 1, color=s.color | 4 if "add_alpha" in c.asked else s.color)),
    Step("swap_bytes", _asks("swap_bytes")),
    Step("user_transform", _asks("user_transform")),
)


def valid_shift(significant: tuple[int, ...], start: Shape) -> bool:
    """Each significant depth that the image's own colour type needs is in range, even for an indexed image."""
    n = (3 if start.indexed or start.has_color else 1) + start.has_alpha
    return len(significant) >= n and all(1 <= v <= start.depth for v in significant[:n])


@dataclass(frozen=True)
class Plan:
    """Steps with the shape in front of each, and the resulting shape."""

    steps: tuple[tuple[str, Shape], ...]
    start: Shape
    shape: Shape
    context: _Context
    max_row_bytes: int = field(default=0)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.steps)

    @property
    def consumes_transparency(self) -> bool:
        c = self.context
        return c.transparent and ("expand" in c.asked or "strip_alpha" in c.asked or "expand_transparency" in self.names)

    def apply(self, px: DataFrame, palette: DataFrame | None = None) -> DataFrame:
        """``px`` (image_id, y, x and the samples in colour order: v or idx, or r, g, b, and a) after all steps.

        One projection over the scan, and a broadcast join only where a palette is looked up. Samples come back in order as
        c0, c1, ...; a position changed by ``pack_swap`` comes back in x.
        """
        given = [c for c in px.columns[3:] if not c.startswith("_")]
        cols = dict(zip("i" if self.start.indexed else "rgb" if self.start.has_color else "v", given)) | ({"a": given[-1]} if self.start.has_alpha else {})
        df, live = px, {name: F.col(c).cast("long") for name, c in cols.items()}
        if self.start.indexed and palette is not None:
            palette = self.palette_side(palette)
        apart = isinstance(self.context.s.file_gamma, Column)  # curves are then long expressions: each step gets a projection of its own
        for at, (name, shape) in enumerate(self.steps):
            df, live = _expressions(name, shape, self.context, df, live, palette)
            if apart:
                df = df.withColumns({f"_{at}{n}": c for n, c in live.items()})
                live = {n: F.col(f"_{at}{n}") for n in live}
        return df.select("image_id", "y", "x", *[c.alias(f"c{i}") for i, c in enumerate(live.values())])

    def palette_side(self, palette: DataFrame) -> DataFrame:
        """``palette`` (idx, pr, pg, pb, pa and other columns) as the requests leave it: corrected, and blended over black or the background.

        Compositing consumes the coverage; premultiplying keeps it. Rows of an indexed image are not touched.
        """
        c, names = self.context, ("pr", "pg", "pb")
        live = {n: F.col(n).cast("long") for n in (*names, "pa")}
        if c.corrects and not c.gamma_is_owned:
            live |= {n: curves.curve_8(c.exponent)(live[n]) for n in names}
        if c.transparent and (c.arranges or c.composes):
            t, zero = _curves(c, 8), (0, 0, 0)
            back, light = (c.s.background, c.s.background_linear) if c.composes else (zero, zero)
            live |= {n: k.compose(live[n], live["pa"], back[min(i, len(back) - 1)], 8, t, light[min(i, len(light) - 1)]) for i, n in enumerate(names)}
            if c.composes:
                live["pa"] = F.lit(255).cast("long")
        return palette.select(*[live[n].cast("long").alias(n) if n in live else F.col(n) for n in palette.columns if not n.startswith("_")])


def _colors(live: dict) -> list[str]:
    return [c for c in live if c in ("r", "g", "b", "v")]


def _curves(c: _Context, depth: int):
    """to-linear, from-linear and combined curves, each the identity where its own exponent is too slight; None where none is in force."""
    to, out = curves.reciprocal_exponent(c.s.file_gamma), curves.reciprocal_exponent(c.s.screen_gamma)
    if "gamma" not in c.asked or to is None or out is None:
        return None
    both = curves.ONE if c.exponent is None else c.exponent
    if not any(isinstance(e, Column) or curves.significant(e) for e in ((to, out, both) if c.s.light else (both,))):
        return None
    if isinstance(both, Column) and not c.s.light:  # row by row
        to, out = (F.when(F.abs(both - curves.ONE) > curves.THRESHOLD, e).otherwise(curves.ONE) for e in (to, F.lit(out)))
    if depth == 8:
        return tuple(curves.curve_8(curves.snapped(e)) for e in (to, out, both))
    leg = lambda e: curves.curve_16_coarse(e, c.coarse) if c.coarse else curves.curve_16(curves.snapped(e))
    return leg(to), leg(out), _wide(c, both)


def _wide(c: _Context, exponent: int | Column):
    """The whole correction of 16-bit samples: straight to multiples of 257 if they will be cut to 8 bits, coarse if bits are missing, else exact."""
    if not c.coarse:
        return curves.curve_16(curves.snapped(exponent))
    return (curves.curve_16_narrowing if c.narrows else curves.curve_16_coarse)(exponent, c.coarse)


def _expressions(name: str, s: Shape, c: _Context, df: DataFrame, live: dict, palette: DataFrame | None):
    """``df`` and its samples after a step at shape ``s``."""
    p = c.s
    per_color = lambda f: live | {n: f(live[n], i) for i, n in enumerate(_colors(live))}
    if name == "expand_palette":
        df = palettes.expand(df.withColumn("__i", live["i"]), palette, "__i", by_image="image_id" in palette.columns)
        live = {"r": F.col("pr"), "g": F.col("pg"), "b": F.col("pb")} | ({"a": F.col("pa")} if c.transparent else {})
    elif name == "expand_gray":
        live = {"v": k.gray_to_8(live["v"], s.depth)}
    elif name == "expand_transparency":
        live = live | {"a": k.key_alpha([live[n] for n in _colors(live)], list(p.key), s.depth)}
    elif name == "rgb_to_gray":
        t = _curves(c, s.depth)
        v = k.rgb_to_gray_linear(live["r"], live["g"], live["b"], *t) if t else k.rgb_to_gray(live["r"], live["g"], live["b"], s.depth)
        live = {"v": v} | ({"a": live["a"]} if "a" in live else {})
    elif name == "gray_to_rgb":
        live = {n: live["v"] for n in "rgb"} | ({"a": live["a"]} if "a" in live else {})
    elif name == "compose" and c.start.indexed:  # done in the palette
        live = {n: x for n, x in live.items() if n != "a"}
    elif name == "compose":
        t, a = _curves(c, s.depth), live["a"]
        live = {n: k.compose(live[n], a, p.background[i], s.depth, t, p.background_linear[i]) for i, n in enumerate(_colors(live))}
    elif name == "alpha_mode" and s.has_alpha and s.depth >= 8:
        t, a = _curves(c, s.depth), live["a"]
        live = per_color(lambda x, i: k.premultiply(x, a, s.depth, t, p.alpha_mode))
        if p.alpha_mode == "broken" and t:
            live["a"] = t[1](a)
    elif name == "compose_key":
        t = _curves(c, s.depth)
        names = _colors(live)
        live = dict(zip(names, k.compose_key([live[n] for n in names], list(p.key), [0] * len(names), s.depth, t[2] if t else None)))
    elif name == "encode_alpha" and "a" in live and (t := _curves(c, 8)):
        live = live | {"a": t[1](live["a"])}
    elif name == "strip_alpha":
        live = {n: x for n, x in live.items() if n != "a"}
    elif name == "gamma":
        f = _wide(c, c.exponent) if s.depth == 16 else curves.curve_8(c.exponent) if s.depth == 8 else curves.curve_small(c.exponent, s.depth)
        live = per_color(lambda x, i: curves.if_significant(c.exponent, x, f(x)))
    elif name in ("scale_16", "strip_16", "expand_16"):
        live = {n: getattr(k, name)(x) for n, x in live.items()}
    elif name == "quantize" and p.quantize_palette and s.depth == 8 and s.color in (2, 6):
        spark = df.sparkSession
        entries = spark.createDataFrame([(i, *e) for i, e in enumerate(p.quantize_palette)], "idx long, pr long, pg long, pb long")
        df = df.withColumn("__cell", k.color_cell(live["r"], live["g"], live["b"]))
        table = palettes.nearest_entries(spark.range(1 << 15).select(F.col("id").alias("cell")), entries).select(F.col("cell").alias("__cell"), F.col("idx").alias("__q"))
        df, live = df.join(F.broadcast(table), "__cell"), {"i": F.col("__q")}
    elif name == "quantize" and p.quantize_map and s.depth == 8 and s.indexed:
        goes = F.expr(f"array({', '.join(f'{int(x)}L' for x in p.quantize_map)})")
        live = {"i": F.coalesce(F.get(goes, live["i"].cast("int")), live["i"])}
    elif name == "invert_mono" and not s.has_color:
        live = per_color(lambda x, i: k.invert(x, s.depth))
    elif name == "invert_alpha" and s.has_alpha and s.depth >= 8:
        live = live | {"a": k.invert(live["a"], s.depth)}
    elif name == "shift" and not s.indexed:
        bits = p.significant
        live = {n: k.shift_down(x, s.depth, bits[3] if n == "a" and len(bits) > 3 else bits[min(i, 2)]) for i, (n, x) in enumerate(live.items())}
    elif name == "bgr" and s.has_color and not s.indexed and s.depth >= 8:
        live = dict(zip([*"bgr", *[n for n in live if n not in "rgb"]], [live["b"], live["g"], live["r"], *[x for n, x in live.items() if n not in "rgb"]]))
    elif name == "pack_swap" and s.depth < 8:
        df = df.withColumn("x", k.pack_swap(F.col("x"), 8 // s.depth))
    elif name == "swap_alpha" and s.has_alpha and s.depth >= 8:
        live = {"a": live["a"]} | {n: x for n, x in live.items() if n != "a"}
    elif name == "filler":
        value = {"f": F.lit(p.filler & 255 if s.depth == 8 else p.filler).cast("long")}
        live = live | value if p.filler_after else value | live
    elif name == "swap_bytes" and s.depth == 16:
        live = {n: k.swap_bytes(x) for n, x in live.items()}
    elif name == "user_transform" and p.user:
        live = p.user(live)
    return df, live


def plan(asked: set[str], start: Shape, transparent: bool = False, settings: Settings = Settings()) -> Plan:
    """The steps for a set of requests on images of one shape."""
    if "shift" in asked and not valid_shift(settings.significant, start):
        raise ValueError("invalid shift values")
    c = _Context(resolve(asked, start, transparent), start, transparent, settings)
    shape, steps, widest = start, [], start.row_bytes
    for step in STEPS:
        if step.wanted(c) and step.acts(shape):
            steps.append((step.name, shape))
            shape = step.after(shape, c)
            widest = max(widest, shape.row_bytes)
    return Plan(tuple(steps), start, shape, c, widest)


@dataclass(frozen=True)
class Background:
    """A background as a client names it: in the file's own terms (``in_file``: a palette index, or the file's sub-byte scale) or the output's.

    ``space`` says which gamma its samples are in: ``screen``, ``file``, or ``own`` with ``gamma``.
    """

    red: int = 0
    green: int = 0
    blue: int = 0
    gray: int = 0
    index: int = 0
    in_file: bool = False
    space: str = "screen"
    gamma: int = 0


def resolve_background(b: Background, asked: set[str], start: Shape, s: Settings, palette: list[tuple[int, int, int]] = ()) -> Settings:
    """``s`` with the background on the blend's scale, as shown and as light, in the order of the blended row's channels."""
    value = {"red": b.red, "green": b.green, "blue": b.blue, "gray": b.gray}
    if b.in_file:
        if start.indexed and b.index < len(palette):
            red, green, blue = palette[b.index]
            value = {"red": red, "green": green, "blue": blue, "gray": red}
        elif not start.indexed and start.depth < 8:
            value = dict.fromkeys(value, b.gray * 255 // k.top(start.depth))
    elif "compose" in asked and start.depth == 16 and {"scale_16", "strip_16"} & set(asked):
        value = {n: v * 257 & 0xFFFF for n, v in value.items()}
    elif "compose" in asked and start.depth != 16 and "expand_16" in asked:
        value = {n: (v * 255 + 32767) // 65535 for n, v in value.items()}
    shown = light = value
    if (isinstance(s.file_gamma, Column) or s.file_gamma > 0) and s.screen_gamma > 0:
        if isinstance(s.file_gamma, Column) and b.space == "file":
            raise ValueError("images that differ in gamma have no one background in the file's own terms")
        gamma = s.file_gamma if b.space == "file" else b.gamma
        to_light, to_screen = (s.screen_gamma, curves.ONE) if b.space == "screen" else (curves.reciprocal_exponent(gamma), curves.correction_exponent(gamma, s.screen_gamma))
        shown, light = ({n: curves.corrected(v, e, start.depth) for n, v in value.items()} for e in (to_screen, to_light))
    blended = next((x for n, x in plan(asked, start, True, s).steps if n == "compose"), None)
    names = ("red", "green", "blue") if start.indexed or (blended or start).has_color else ("gray",)
    return replace(s, background=tuple(shown[n] for n in names), background_linear=tuple(light[n] for n in names))
