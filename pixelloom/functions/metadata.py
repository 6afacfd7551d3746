"""Scalar functions over metadata fields: units, text forms of numbers, times, chromaticities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the grammar of a number written as text.
NUMBER = r"^\+?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def dots_per_inch(per_metre: Column, unit: Column) -> Column:
    return F.when(unit == 1, F.floor(per_metre * 0.0254 + 0.5)).otherwise(0).cast("long")


def pixels_per_metre(x: Column, y: Column, unit: Column) -> Column:
    """The common density, 0 if the axes differ or the unit is unknown."""
    return F.when((unit == 1) & (x == y), x).otherwise(0).cast("long")


def aspect_ratio(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), y / F.nullif(x, F.lit(0))).otherwise(F.lit(0.0))


def offset_inches(micrometres: Column) -> Column:
    return micrometres * 0.00003937


def rfc1123(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def rfc1123_fields(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """The text of a stored time, NULL unless every field is in range; a second may be 60."""
    months = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    good = (y <= 9999) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 60)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(good, F.concat_ws(" ", d.cast("string"), F.get(months, (mo - 1).cast("int")), F.lpad(y.cast("string"), 4, "0"), F.concat_ws(":", two(h), two(mi), two(s)), F.lit("+0000")))


def fixed_to_text(v: Column) -> Column:
    """A value in 1/100000 as text without trailing zeros."""
    m = F.abs(v)
    whole, part = F.floor(m / 100000).cast("string"), F.lpad((m % 100000).cast("string"), 5, "0")
    text = F.when(m % 100000 == 0, whole).otherwise(F.concat(F.when(m < 100000, "").otherwise(whole), F.lit("."), F.rtrim(part, F.lit("0"))))
    return F.concat(F.when(v < 0, "-").otherwise(""), text)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def double_to_text(v: Column) -> Column:
    """At most five significant digits, plain or with an exponent, whichever is shorter (plain on ties)."""
    m = F.abs(v)
    scaled = lambda e: F.when(e >= 4, m / F.pow(F.lit(10.0), (e - 4).cast("double"))).otherwise(m * F.pow(F.lit(10.0), (F.lit(4) - e).cast("double")))
    near = F.floor(F.log10(F.nullif(m, F.lit(0.0)))).cast("int")
    exact = lambda g: _let(scaled(g), lambda x: F.when(x < 10000, g - 1).when(x >= 100000, g + 1).otherwise(g))
    pair = lambda e: _let(F.floor(scaled(e) + 0.5).cast("long"), lambda n: F.when(n >= 100000, F.struct(F.lit("1").alias("d"), (e + 1).alias("e"))).otherwise(F.struct(F.rtrim(n.cast("string"), F.lit("0")).alias("d"), e.alias("e"))))

    def spelled(p: Column) -> Column:
        d, e, n = p["d"], p["e"], F.length(p["d"])
        zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)))
        whole = F.concat(d, zeros(e + 1 - n))
        mixed = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))
        plain = F.when(e < 0, F.concat(F.lit("."), zeros(-e - 1), d)).when(e + 1 >= n, whole).otherwise(mixed)
        return _let(F.struct(plain.alias("a"), F.concat(d, F.lit("E"), (e - n + 1).cast("string")).alias("b")), lambda t: F.when(F.length(t["a"]) <= F.length(t["b"]), t["a"]).otherwise(t["b"]))

    text = _let(_let(_let(near, exact), pair), spelled)
    return F.when(v == 0, "0").otherwise(F.concat(F.when(v < 0, "-").otherwise(""), text))


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def valid_keyword(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).between(1, 79), F.lit(False))


def chunk_flags(name: Column) -> list[Column]:
    """ancillary, private, reserved, safe_to_copy: bit 5 of each letter."""
    bit = lambda i: F.ascii(F.substring(name, i, 1)).bitwiseAND(F.lit(32)) != 0
    return [bit(i).alias(n) for i, n in enumerate(("ancillary", "private", "reserved", "safe_to_copy"), 1)]


def header_problems(width, height, depth, color, compression, filtering, interlace) -> Column:
    """All problems of a header, in order, as an array of messages."""
    pairs = ((color == 0) & depth.isin(1, 2, 4, 8, 16)) | ((color == 3) & depth.isin(1, 2, 4, 8)) | (color.isin(2, 4, 6) & depth.isin(8, 16))
    known = color.isin(0, 2, 3, 4, 6)
    rules = [
        (width == 0, "Image width is zero in IHDR"),
        (height == 0, "Image height is zero in IHDR"),
        ((width > 1_000_000) | (height > 1_000_000), "Invalid image size in IHDR"),
        (~depth.isin(1, 2, 4, 8, 16), "Invalid bit depth in IHDR"),
        (~known, "Invalid color type in IHDR"),
        (known & ~pairs, "Invalid color type/bit depth combination in IHDR"),
        (compression != 0, "Unknown compression method in IHDR"),
        (filtering != 0, "Unknown filter method in IHDR"),
        (interlace > 1, "Unknown interlace method in IHDR"),
    ]
    return F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))


def unknown_kept(named: Column, default: Column, safe: Column, handled: Column) -> Column:
    """Policy: 0 as default, 1 never, 2 if safe to copy, 3 always; a named policy goes first."""
    policy = F.when(F.coalesce(named, F.lit(0)) != 0, named).otherwise(default)
    return F.when(policy == 1, False).when(policy == 3, True).when(policy == 2, safe).otherwise(handled)


def xyz_of_chromaticities(xy: dict[str, Column]) -> dict[str, Column]:
    """XYZ of red, green and blue primaries scaled so that they sum to the white point of luminance one.

    ``xy``: wx, wy, rx, ry, gx, gy, bx, by as doubles. Cramer's rule over three unknown luminance sums.
    """
    x = {c: xy[f"{c}x"] for c in "rgbw"}
    y = {c: xy[f"{c}y"] for c in "rgbw"}
    z = {c: F.lit(1.0) - x[c] - y[c] for c in "rgbw"}
    white = (x["w"] / y["w"], F.lit(1.0), z["w"] / y["w"])
    col = {c: (x[c], y[c], z[c]) for c in "rgb"} | {"w": white}

    def det(a: str, b: str, c: str) -> Column:
        p, q, s = col[a], col[b], col[c]
        return p[0] * (q[1] * s[2] - s[1] * q[2]) - q[0] * (p[1] * s[2] - s[1] * p[2]) + s[0] * (p[1] * q[2] - q[1] * p[2])

    whole = det("r", "g", "b")
    scale = {"r": det("w", "g", "b") / whole, "g": det("r", "w", "b") / whole, "b": det("r", "g", "w") / whole}
    return {f"{c}_{n}": col[c][k] * scale[c] for c in "rgb" for k, n in enumerate("xyz")}


def chromaticities_of_xyz(xyz: dict[str, Column]) -> dict[str, Column]:
    """x and y of the primaries, and of their sum, the white point."""
    out, sums = {}, [F.lit(0.0)] * 3
    for c in "rgb":
        parts = [xyz[f"{c}_{n}"] for n in "xyz"]
        total = parts[0] + parts[1] + parts[2]
        out |= {f"{c}x": parts[0] / total, f"{c}y": parts[1] / total}
        sums = [s + p for s, p in zip(sums, parts)]
    total = sums[0] + sums[1] + sums[2]
    return out | {"wx": sums[0] / total, "wy": sums[1] / total}


def uint(payload: Column, start: int, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes from ``start`` (0-based)."""
    return F.conv(F.hex(F.substring(payload, start + 1, n)), 16, 10).cast("long")


def int32(payload: Column, start: int) -> Column:
    u = uint(payload, start, 4)
    return F.when(u == 1 << 31, 0).when(u > 1 << 31, u - (1 << 32)).otherwise(u)


def uint_bytes(v: Column, n: int) -> Column:
    """The low ``n`` big-endian bytes of an integer (8 hold any); one below zero is taken by its bits."""
    return F.unhex(F.substring(F.lpad(F.hex(v), 16, "0"), 17 - 2 * n, 2 * n))
