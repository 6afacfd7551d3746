"""The byte format: chunks, compressed scanlines, prediction filters, interlacing. Plain Python over one image.

Used inside Arrow tasks, one image a record. Damage never raises: it becomes diagnostics, and a fatal one gives no samples.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: x0, y0, dx, dy, block width, block height of the seven passes.
PASSES = ((0, 0, 8, 8, 8, 8), (4, 0, 8, 8, 4, 8), (0, 4, 4, 8, 4, 4), (2, 0, 4, 4, 2, 4), (0, 2, 2, 4, 2, 2), (1, 0, 2, 2, 1, 2), (0, 1, 1, 2, 1, 1))
MAX_SIDE, MAX_ANCILLARY = 1_000_000, 8_000_000
CALIBRATION_PARAMETERS = (2, 3, 3, 4)


@dataclass
class Chunk:
    seq: int
    offset: int
    name: str
    payload: bytes
    crc: int
    crc_ok: bool
    location: int = 0
    #: Used although its checksum is wrong.
    used: bool = False

    @property
    def critical(self) -> bool:
        return self.name[0].isupper()


@dataclass
class Image:
    header: dict | None = None
    chunks: list[Chunk] = field(default_factory=list)
    palette: list[tuple[int, int, int]] = field(default_factory=list)
    alpha: list[int] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    text: list[tuple] = field(default_factory=list)
    unknown: list[tuple[str, bytes, int]] = field(default_factory=list)
    samples: np.ndarray | None = None
    filters: list[tuple[int, int, int]] = field(default_factory=list)
    diagnostics: list[tuple[str, str, str]] = field(default_factory=list)
    #: General and named policies for unknown chunks, and who handles them.
    policy: tuple = ("always", {}, None)

    def note(self, severity: str, message: str, chunk: str = "") -> None:
        self.diagnostics.append((severity, chunk, message))

    @property
    def fatal(self) -> bool:
        return any(s == "error" for s, _, _ in self.diagnostics)


def same_signature(content: bytes, start: int = 0, count: int = 8) -> bool:
    """Whether ``count`` bytes of a file from ``start`` on are the signature's; nothing is equal if nothing is compared."""
    count = min(count, 8 - start)
    return 0 <= start <= 7 and count > 0 and content[start : start + count] == MAGIC[start : start + count]


def expected_bytes(head: dict) -> int:
    """Inflated bytes of a whole image: each row of each pass with its filter byte."""
    return sum(h * ((w * head["pixel_depth"] + 7) // 8 + 1) for _, w, h in pass_sizes(head["width"], head["height"], head["interlaced"]))


def lex(content: bytes, image: Image) -> list[Chunk]:
    """Chunks in file order, with locations 1 before the palette, 2 after it, 8 after the image data."""
    if content[:8] != MAGIC:
        image.note("error", "PNG file corrupted by ASCII conversion" if content[:4] == MAGIC[:4] else "Not a PNG file")
        return []
    at, place = 8, 1
    while at < len(content):
        if at + 8 > len(content):
            image.note("error", "Read Error")
            break
        n, name = struct.unpack_from(">I4s", content, at)
        if n >> 31:
            image.note("error", "PNG unsigned integer out of range")
            break
        if not name.isalpha() or not name.isascii():
            image.note("error", "invalid chunk type")
            break
        if at + 12 + n > len(content):
            image.note("error", "Read Error", name.decode())
            break
        payload = content[at + 8 : at + 8 + n]
        (crc,) = struct.unpack_from(">I", content, at + 8 + n)
        name = name.decode()
        place = 8 if name == "IDAT" else 2 if name == "PLTE" and place < 2 else place
        image.chunks.append(Chunk(len(image.chunks), at, name, payload, crc, zlib.crc32(name.encode() + payload) == crc, place))
        at += 12 + n
        if name == "IEND":
            break
    return image.chunks


def parse_header(payload: bytes, image: Image) -> dict | None:
    if len(payload) != 13:
        image.note("error", "Invalid IHDR chunk", "IHDR")
        return None
    w, h, depth, color, compression, filtering, interlace = struct.unpack(">IIBBBBB", payload)
    found = [m for bad, m in (
        (w == 0, "Image width is zero in IHDR"), (h == 0, "Image height is zero in IHDR"), (max(w, h) > MAX_SIDE, "Invalid image size in IHDR"), (depth not in DEPTHS[0], "Invalid bit depth in IHDR"),
        (color not in CHANNELS, "Invalid color type in IHDR"), (color in CHANNELS and depth not in DEPTHS[color], "Invalid color type/bit depth combination in IHDR"),
        (compression != 0, "Unknown compression method in IHDR"), (filtering != 0, "Unknown filter method in IHDR"), (interlace > 1, "Unknown interlace method in IHDR"),
    ) if bad]
    for m in found:
        image.note("warning", m, "IHDR")
    if found:
        image.note("error", "Invalid IHDR data", "IHDR")
        return None
    channels = CHANNELS[color]
    bits = channels * depth
    return {"width": w, "height": h, "bit_depth": depth, "color_type": color, "interlaced": bool(interlace), "channels": channels, "pixel_depth": bits, "row_bytes": (w * bits + 7) // 8, "filter_stride": max(1, bits // 8)}


def pass_sizes(width: int, height: int, interlaced: bool) -> list[tuple[int, int, int]]:
    """pass, width, height of the passes that are present; pass 0 is the only one without interlacing."""
    if not interlaced:
        return [(0, width, height)]
    size = lambda n, start, step: max(0, (n - start + step - 1) // step)
    all_ = [(k, size(width, x0, dx), size(height, y0, dy)) for k, (x0, y0, dx, dy, _, _) in enumerate(PASSES)]
    return [p for p in all_ if p[1] and p[2]]


def _unfilter_loop(kinds: np.ndarray, rows: np.ndarray, stride: int, above: np.ndarray | None = None) -> np.ndarray:
    out, above = np.zeros_like(rows), [0] * rows.shape[1] if above is None else above.tolist()
    for y, kind in enumerate(kinds.tolist()):
        line = rows[y].tolist()
        for i, v in enumerate(line):
            a, b, c = (line[i - stride], above[i], above[i - stride]) if i >= stride else (0, above[i], 0)
            line[i] = (v + _predict(kind, a, b, c)) & 255
        out[y], above = line, line
    return out


def _predict(kind: int, a: int, b: int, c: int) -> int:
    if kind == 4:
        p = a + b - c
        near = min(abs(p - a), abs(p - b), abs(p - c))
        return a if abs(p - a) == near else b if abs(p - b) == near else c
    return (0, a, b, (a + b) >> 1)[kind]


def unfilter(kinds: np.ndarray, rows: np.ndarray, stride: int) -> np.ndarray:
    """Undo prediction; the row above the first is zero.

    Runs of rows of one kind are undone together: looking left or up is a running sum over the run. Where both matter, a few rows are undone byte
    by byte, and many by a wave front over the diagonals, on which all pixels depend on finished ones only.
    """
    height, width = rows.shape
    if height * width <= 4096:
        return _unfilter_loop(kinds, rows, stride)
    n = -(-width // stride)
    out = np.zeros((height, n * stride), np.uint8)
    out[:, :width] = rows
    edges = [0, *(np.flatnonzero(np.diff(np.minimum(kinds, 3))) + 1).tolist(), height]
    runs = [(a, b, int(min(kinds[a], 3))) for a, b in zip(edges, edges[1:])]
    both = [(a, b) for a, b, kind in runs if kind == 3]
    step = lambda a, b: min((b - a) * width, WAVE_COST * (b - a + n))
    if both and sum(step(a, b) for a, b in both) > step(both[0][0], both[-1][1]):  # one wave over all that lies between
        first, last = both[0][0], both[-1][1]
        runs = [r for r in runs if r[1] <= first] + [(first, last, 3)] + [r for r in runs if r[0] >= last]
    above = np.zeros(n * stride, np.uint8)
    for low, high, kind in runs:
        part = out[low:high]
        if kind == 1:
            pixels = part.reshape(len(part), n, stride)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind == 3 and len(part) * width <= WAVE_COST * (len(part) + n):
            part[:] = _unfilter_loop(kinds[low:high], part, stride, above)
        elif kind == 3:
            part[:] = _wave(kinds[low:high], part.reshape(len(part), n, stride), above.reshape(n, stride)).reshape(part.shape)
        above = out[high - 1]
    return out[:, :width]


#: A diagonal of the wave front costs about as much as so many bytes one by one.
WAVE_COST = 100


def _wave(kinds: np.ndarray, source: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of any predictions below the row ``above``."""
    height, n, stride = source.shape
    out = np.zeros((height + 1, n + 1, stride), np.int16)
    out[0, 1:] = above
    source, present = source.astype(np.int16), set(kinds.tolist())
    for t in range(height + n - 1):
        y = np.arange(max(0, t - n + 1), min(height - 1, t) + 1)
        x = t - y
        a, b = out[y + 1, x], out[y, x + 1]
        guesses = {0: 0, 1: a, 2: b, 3: (a + b) >> 1 if 3 in present else 0}
        if 4 in present:
            c = out[y, x]
            da, db = b - c, a - c  # how far the estimate a + b - c is from a and from b
            pa, pb, pc = np.abs(da), np.abs(db), np.abs(da + db)
            guesses[4] = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        if len(present) == 1:
            guess = guesses[next(iter(present))]
        else:
            k = kinds[y][:, None]
            guess = np.select([k == p for p in present], [guesses[p] for p in present], 0)
        out[y + 1, x + 1] = (source[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unpack(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Bytes of rows to samples (height, width, channels)."""
    if depth == 16:
        pairs = rows.reshape(len(rows), width, channels, 2).astype(np.int32)
        return pairs[..., 0] << 8 | pairs[..., 1]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, 1, depth)
        return (bits.astype(np.int32) << np.arange(depth)[::-1]).sum(axis=3)
    return rows.reshape(len(rows), width, channels).astype(np.int32)


def pack(samples: np.ndarray, depth: int) -> np.ndarray:
    """Samples (height, width, channels) to bytes of rows; unused bits are zero."""
    h, w, c = samples.shape
    if depth == 16:
        return np.ascontiguousarray(samples.astype(">u2")).view(np.uint8).reshape(h, w * c * 2)
    if depth < 8:
        bits = (samples >> np.arange(depth)[::-1]) & 1
        return np.packbits(bits.reshape(h, w * depth).astype(np.uint8), axis=1)
    return samples.reshape(h, w * c).astype(np.uint8)


def scanlines(image: Image) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """pass, filter kinds, unfiltered rows, from the joined image data."""
    head = image.header
    sizes = pass_sizes(head["width"], head["height"], head["interlaced"])
    spans = [(k, w, h, (w * head["pixel_depth"] + 7) // 8) for k, w, h in sizes]
    total = expected_bytes(head)
    engine = zlib.decompressobj()
    try:
        data = engine.decompress(b"".join(c.payload for c in image.chunks if c.name == "IDAT" and (c.crc_ok or c.used)), total)
    except zlib.error as e:
        image.note("error", f"IDAT: {e}", "IDAT")
        return []
    if len(data) < total:
        image.note("error", "Not enough image data", "IDAT")
        return []
    if engine.unconsumed_tail or engine.unused_data:
        image.note("warning", "Extra compressed data", "IDAT")
    out, at = [], 0
    for k, _, h, n in spans:
        block = np.frombuffer(data, np.uint8, h * (n + 1), at).reshape(h, n + 1)
        at += h * (n + 1)
        if (block[:, 0] > 4).any():
            image.note("error", "bad adaptive filter value", "IDAT")
            return []
        out.append((k, block[:, 0], unfilter(block[:, 0], block[:, 1:], head["filter_stride"])))
    return out


#: What may be done with a chunk whose checksum is wrong: for critical ones, and for others.
CRC_ACTIONS = {"critical": ("error", "warn_use", "quiet_use"), "ancillary": ("warn_discard", "error", "warn_use", "quiet_use")}
#: Which unknown chunks are kept: all, none, or those that are safe to copy.
KEEP = ("always", "never", "if_safe")


def kept_unknown(name: str, keep: str, named: dict[str, str]) -> bool:
    """A policy for the chunk's name goes before the general one; a chunk is safe to copy if its last letter is small."""
    policy = named.get(name, keep)
    return policy == "always" or policy == "if_safe" and name[3].islower()


def decode(content: bytes | None, pixels: bool = True, quiet_crc: bool = False, critical_crc: str = "error", ancillary_crc: str = "warn_discard", keep: str = "always", keep_named: dict[str, str] | None = None, handler=None) -> Image:
    """Everything in a file.

    ``critical_crc`` and ``ancillary_crc`` are ``CRC_ACTIONS`` (``quiet_crc`` uses ancillary chunks whose checksum is wrong, with a warning).
    ``keep`` and ``keep_named`` are policies of ``KEEP`` for unknown chunks. ``handler(name, payload)`` sees each of those first: a true answer takes the chunk,
    None or False leaves it to the policy, an exception becomes a warning.
    """
    image = Image()
    if critical_crc not in CRC_ACTIONS["critical"] or ancillary_crc not in CRC_ACTIONS["ancillary"] or {keep, *(keep_named or {}).values()} - set(KEEP):
        raise ValueError("unknown policy")
    image.policy = keep, keep_named or {}, handler
    lex(content or b"", image)
    seen_end = image.fatal
    for c in image.chunks:
        if not c.crc_ok:
            action = critical_crc if c.critical else "warn_use" if quiet_crc and ancillary_crc == "warn_discard" else ancillary_crc
            if action != "quiet_use":
                image.note("error" if action == "error" else "warning", "CRC error", c.name)
            if action == "error":
                break
            if action == "warn_discard":
                continue
            c.used = True
        if c.seq == 0 and c.name != "IHDR":
            image.note("error", "missing IHDR", c.name)
            break
        if c.name == "IHDR":
            if image.header is not None:
                image.note("error", "out of place", "IHDR")
                break
            image.header = parse_header(c.payload, image)
            if image.header is None:
                break
        elif c.name == "IEND":
            seen_end = True
        elif c.name != "IDAT":
            known = len(image.diagnostics)
            _parse_optional(c, image)
            if any(d[0] == "error" for d in image.diagnostics[known:]):
                break
    if not image.fatal and not any(c.name == "IDAT" for c in image.chunks):
        image.note("error", "missing IDAT")
    if not image.fatal and not seen_end:
        image.note("error", "Read Error")
    if not image.fatal and image.header["color_type"] == 3 and not image.palette:
        image.note("error", "Missing PLTE before IDAT")
    if pixels and not image.fatal:
        head = image.header
        passes = scanlines(image)
        if not image.fatal:  # only now is there as much data as the header claims
            samples = np.zeros((head["height"], head["width"], head["channels"]), np.int32)
            for k, kinds, rows in passes:
                image.filters += [(k, y, int(f)) for y, f in enumerate(kinds)]
                x0, y0, dx, dy = PASSES[k][:4] if head["interlaced"] else (0, 0, 1, 1)
                w = len(range(x0, head["width"], dx))
                samples[y0::dy, x0::dx] = unpack(rows, w, head["channels"], head["bit_depth"])
            image.samples = samples
            if head["color_type"] == 3 and samples.max(initial=0) >= len(image.palette):
                image.note("warning", "Read palette index exceeding num_palette", "IDAT")
    return image


def inflate(data: bytes) -> bytes:
    """Inflated ancillary data, to a fixed ceiling."""
    engine = zlib.decompressobj()
    out = engine.decompress(data, MAX_ANCILLARY)
    if engine.unconsumed_tail or not engine.eof:
        raise ValueError("bad compressed data")
    return out


def _keyword(data: bytes) -> tuple[str, bytes]:
    word, mark, rest = data.partition(b"\0")
    if not mark or not 1 <= len(word) <= 79:
        raise ValueError("bad keyword")
    return word.decode("latin-1"), rest


def _exactly(data: bytes, n: int) -> bytes:
    if len(data) != n:
        raise ValueError("invalid")
    return data


def _color16(image: Image, p: bytes) -> dict:
    """The colour of a background or a transparent key, by colour type."""
    color = image.header["color_type"]
    if color in (2, 6):
        r, g, b = struct.unpack(">HHH", _exactly(p, 6))
        return {"index": 0, "red": r, "green": g, "blue": b, "gray": 0}
    (v,) = struct.unpack(">H", _exactly(p, 2))
    return {"index": 0, "red": v, "green": v, "blue": v, "gray": v}


def _parse(name: str, p: bytes, image: Image):
    """The value of a metadata chunk; ValueError if it is malformed."""
    head, color = image.header, image.header["color_type"]
    if name == "gAMA":
        return struct.unpack(">i", _exactly(p, 4))[0]
    if name == "cHRM":
        return list(struct.unpack(">8i", _exactly(p, 32)))
    if name == "sRGB":
        if _exactly(p, 1)[0] > 3:
            raise ValueError("invalid")
        return p[0]
    if name == "sBIT":
        v = list(_exactly(p, 3 if color == 3 else head["channels"]))
        depth = 8 if color == 3 else head["bit_depth"]
        if any(not 1 <= x <= depth for x in v):
            raise ValueError("invalid")
        rgb, alpha = (v[:3], v[3:]) if color in (2, 3, 6) else ([v[0]] * 3, v[1:])
        return {"red": rgb[0], "green": rgb[1], "blue": rgb[2], "gray": v[0] if color in (0, 4) else 0, "alpha": alpha[0] if alpha else head["bit_depth"]}
    if name == "bKGD":
        if color == 3:
            i = _exactly(p, 1)[0]
            if i >= len(image.palette):
                raise ValueError("invalid index")
            r, g, b = image.palette[i]
            return {"index": i, "red": r, "green": g, "blue": b, "gray": 0}
        out = _color16(image, p)
        if head["bit_depth"] < 16 and max(out["red"], out["green"], out["blue"]) >= 1 << head["bit_depth"]:
            raise ValueError("invalid")
        return out
    if name == "hIST":
        if not image.palette:
            raise ValueError("out of place")
        return list(struct.unpack(f">{len(image.palette)}H", _exactly(p, 2 * len(image.palette))))
    if name == "pHYs":
        return list(struct.unpack(">IIB", _exactly(p, 9)))
    if name == "oFFs":
        return list(struct.unpack(">iiB", _exactly(p, 9)))
    if name == "tIME":
        return list(struct.unpack(">HBBBBB", _exactly(p, 7)))
    if name == "cICP":
        return list(_exactly(p, 4))
    if name == "cLLI":
        return list(struct.unpack(">II", _exactly(p, 8)))
    if name == "mDCV":
        return list(struct.unpack(">8HII", _exactly(p, 24)))
    if name == "eXIf":
        if not p:
            raise ValueError("empty")
        return p
    if name == "iCCP":
        word, rest = _keyword(p)
        if rest[:1] != b"\0":
            raise ValueError("bad compression method")
        profile = inflate(rest[1:])
        if len(profile) < 132 or struct.unpack_from(">I", profile, 128)[0] < 2:
            raise ValueError("invalid profile")
        return {"name": word, "profile": profile}
    if name == "sCAL":
        width, mark, height = p[1:].partition(b"\0")
        if p[:1] not in (b"\1", b"\2") or not mark or not width or not height:
            raise ValueError("invalid")
        return {"unit": p[0], "width": width.decode("latin-1"), "height": height.rstrip(b"\0").decode("latin-1")}
    if name == "pCAL":
        word, rest = _keyword(p)
        x0, x1, kind, n = struct.unpack_from(">iiBB", rest)
        parts = rest[10:].split(b"\0")
        if kind > 3 or n != CALIBRATION_PARAMETERS[kind] or len(parts) != n + 1:
            raise ValueError("invalid parameter count")
        return {"purpose": word, "x0": x0, "x1": x1, "equation": kind, "unit": parts[0].decode("latin-1"), "parameters": [x.decode("latin-1") for x in parts[1:]]}
    if name == "sPLT":
        word, rest = _keyword(p)
        size, form = {8: (6, ">4BH"), 16: (10, ">5H")}.get(rest[0] if rest else 0, (0, ""))
        if not size or (len(rest) - 1) % size:
            raise ValueError("invalid")
        return {"name": word, "depth": rest[0], "entries": [list(struct.unpack_from(form, rest, i)) for i in range(1, len(rest), size)]}
    raise KeyError(name)


#: Chunks that are parsed into ``Image.metadata``; those with lists may occur more than once.
METADATA = ("gAMA", "cHRM", "sRGB", "sBIT", "bKGD", "hIST", "pHYs", "oFFs", "tIME", "cICP", "cLLI", "mDCV", "eXIf", "iCCP", "sCAL", "pCAL", "sPLT")


def _parse_text(name: str, p: bytes) -> tuple:
    """compression (-1, 0 for tEXt and zTXt; 1, 2 for plain and compressed iTXt), keyword, text, language, translated."""
    word, rest = _keyword(p)
    if name == "tEXt":
        return -1, word, rest.decode("latin-1"), "", ""
    if name == "zTXt":
        if rest[:1] != b"\0":
            raise ValueError("unknown compression type")
        return 0, word, inflate(rest[1:]).decode("latin-1"), "", ""
    if len(rest) < 2 or rest[0] > 1 or rest[1] != 0:
        raise ValueError("bad compression info")
    language, mark, more = rest[2:].partition(b"\0")
    translated, second, text = more.partition(b"\0")
    if not mark or not second:
        raise ValueError("truncated")
    text = inflate(text) if rest[0] else text
    return 1 + rest[0], word, text.decode("utf-8", "replace"), language.decode("latin-1"), translated.decode("utf-8", "replace")


def _parse_optional(c: Chunk, image: Image) -> None:
    head = image.header
    try:
        if c.name == "PLTE":
            n = len(c.payload) // 3
            if head["color_type"] in (0, 4) or image.palette or c.location == 8:
                raise ValueError("ignored in grayscale PNG" if head["color_type"] in (0, 4) else "out of place")
            if len(c.payload) % 3 or not 1 <= n <= 256:
                raise ValueError("invalid")
            entries = [tuple(c.payload[i : i + 3]) for i in range(0, 3 * n, 3)]
            image.palette = entries[: 1 << head["bit_depth"]] if head["color_type"] == 3 else entries
        elif c.name == "tRNS":
            if head["color_type"] == 3:
                if not image.palette or not 1 <= len(c.payload) <= len(image.palette):
                    raise ValueError("invalid")
                image.alpha = list(c.payload)
                image.metadata["tRNS"] = {"count": len(c.payload)}
            elif head["color_type"] in (4, 6):
                raise ValueError("invalid with alpha channel")
            else:
                image.metadata["tRNS"] = {"count": 1} | _color16(image, c.payload)
        elif c.name in ("tEXt", "zTXt", "iTXt"):
            image.text.append(_parse_text(c.name, c.payload))
        elif c.name in METADATA:
            if len(c.payload) > MAX_ANCILLARY:
                raise ValueError("too large")
            value = _parse(c.name, c.payload, image)
            if c.name == "sPLT":
                image.metadata.setdefault("sPLT", []).append(value)
            elif c.name in image.metadata:
                raise ValueError("duplicate")
            else:
                image.metadata[c.name] = value
        elif c.critical:
            image.note("error", "unhandled critical chunk", c.name)
        else:
            keep, named, handler = image.policy
            if not (handler and _handled(handler, c, image)) and kept_unknown(c.name, keep, named):
                image.unknown.append((c.name, c.payload, c.location))
    except (ValueError, zlib.error, struct.error, IndexError) as e:
        image.note("error" if c.name == "PLTE" and head["color_type"] == 3 else "warning", str(e), c.name)


def _handled(handler, c: Chunk, image: Image) -> bool:
    try:
        return bool(handler(c.name, c.payload))
    except Exception as e:  # a client's own code: the file is not to blame
        image.note("warning", f"chunk handler: {e}", c.name)
        return False


def chunk(name: str, payload: bytes) -> bytes:
    body = name.encode() + payload
    return struct.pack(">I", len(payload)) + body + struct.pack(">I", zlib.crc32(body))


def filter_rows(rows: np.ndarray, stride: int, allowed: tuple[int, ...] = (0, 1, 2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Filter kind of each row, the cheapest of ``allowed`` (the first on ties), and the filtered rows."""
    left, above, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, stride:], above[1:], corner[1:, stride:] = rows[:, :-stride], rows[:-1], rows[:-1, :-stride]

    def guess(kind: int) -> np.ndarray:
        if kind < 3:
            return (np.uint8(0), left, above)[kind]
        a, b = left.astype(np.int16), above.astype(np.int16)
        if kind == 3:
            return ((a + b) >> 1).astype(np.uint8)
        da, db = b - corner, a - corner
        pa, pb, pc = np.abs(da), np.abs(db), np.abs(da + db)
        return np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))

    done = [rows - guess(k) for k in allowed]
    # a byte's distance from zero either way round; -128 stays 128 as an unsigned byte
    cost = np.stack([np.abs(d.view(np.int8)).view(np.uint8).sum(axis=1, dtype=np.int64) for d in done])
    best = cost.argmin(axis=0)
    out = done[0]
    for k in range(1, len(allowed)):
        out = np.where((best == k)[:, None], done[k], out) if (best == k).any() else out
    return np.array(allowed, np.uint8)[best], out


def _metadata_payload(name: str, v, color: int) -> bytes:
    forms = {"gAMA": ">i", "sRGB": ">B"}
    lists = {"cHRM": ">8i", "pHYs": ">IIB", "oFFs": ">iiB", "tIME": ">HBBBBB", "cICP": ">4B", "cLLI": ">II", "mDCV": ">8HII"}
    if name in forms:
        return struct.pack(forms[name], v)
    if name in lists:
        return struct.pack(lists[name], *v)
    if name == "hIST":
        return struct.pack(f">{len(v)}H", *v)
    if name == "eXIf":
        return bytes(v)
    if name == "sBIT":
        keys = {0: ("gray",), 2: ("red", "green", "blue"), 3: ("red", "green", "blue"), 4: ("gray", "alpha"), 6: ("red", "green", "blue", "alpha")}[color]
        return bytes(v[k] for k in keys)
    if name == "bKGD":
        return bytes([v["index"]]) if color == 3 else struct.pack(">HHH", v["red"], v["green"], v["blue"]) if color in (2, 6) else struct.pack(">H", v["gray"])
    if name == "iCCP":
        return v["name"].encode("latin-1") + b"\0\0" + zlib.compress(bytes(v["profile"]))
    if name == "sCAL":
        return bytes([v["unit"]]) + v["width"].encode("latin-1") + b"\0" + v["height"].encode("latin-1")
    if name == "pCAL":
        return v["purpose"].encode("latin-1") + b"\0" + struct.pack(">iiBB", v["x0"], v["x1"], v["equation"], len(v["parameters"])) + b"\0".join(x.encode("latin-1") for x in (v["unit"], *v["parameters"]))
    return v["name"].encode("latin-1") + b"\0" + bytes([v["depth"]]) + b"".join(struct.pack(">4BH" if v["depth"] == 8 else ">5H", *e) for e in v["entries"])


def text_chunk(compression: int, keyword: str, text: str, language: str = "", translated: str = "") -> bytes:
    head = keyword.encode("latin-1") + b"\0"
    if compression == -1:
        return chunk("tEXt", head + text.encode("latin-1"))
    if compression == 0:
        return chunk("zTXt", head + b"\0" + zlib.compress(text.encode("latin-1")))
    body = zlib.compress(text.encode()) if compression == 2 else text.encode()
    return chunk("iTXt", head + bytes([compression - 1, 0]) + language.encode("latin-1") + b"\0" + translated.encode() + b"\0" + body)


def encode(samples: np.ndarray, depth: int, color: int, interlaced: bool = False, palette=(), alpha=(), key=None, metadata: dict | None = None, text=(), unknown=(), filters: tuple[int, ...] | None = None, level: int = 6, idat: int = 1 << 15, flush_rows: int = 0, late_text=()) -> bytes:
    """A file of samples (height, width, channels). Sub-byte and palette images are not predicted unless asked.

    ``flush_rows``: after so many rows what is there can be inflated, and ends a chunk. ``late_text`` stands behind the rows. ``unknown`` (name, data, place) has places
    1 (before the palette), 2 (after it) and 8 (behind the rows).
    """
    h, w, channels = samples.shape
    if samples.min(initial=0) < 0 or samples.max(initial=0) >> depth:
        raise ValueError("a sample does not fit its depth")
    if color == 3 and not 1 <= len(palette) <= 1 << depth:
        raise ValueError("invalid number of palette entries")
    meta = metadata or {}
    filters = filters if filters is not None else (0,) if depth < 8 or color == 3 else (0, 1, 2, 3, 4)
    out = [MAGIC, chunk("IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(interlaced)))]
    out += [chunk(n, _metadata_payload(n, meta[n], color)) for n in ("cICP", "mDCV", "cLLI", "gAMA", "cHRM", "sRGB", "iCCP", "sBIT") if n in meta]
    out += [chunk(n, d) for n, d, place in unknown if place == 1]
    if len(palette):
        out.append(chunk("PLTE", bytes(x for e in palette for x in e)))
    if len(alpha):
        out.append(chunk("tRNS", bytes(alpha)))
    elif key is not None:
        out.append(chunk("tRNS", struct.pack(f">{len(key)}H", *key)))
    out += [chunk(n, _metadata_payload(n, meta[n], color)) for n in ("bKGD", "hIST", "pHYs", "oFFs", "sCAL", "pCAL") if n in meta]
    out += [chunk("sPLT", _metadata_payload("sPLT", v, color)) for v in meta.get("sPLT", ())]
    out += [chunk(n, _metadata_payload(n, meta[n], color)) for n in ("tIME", "eXIf") if n in meta]
    out += [chunk(n, d) for n, d, place in unknown if place not in (1, 8)]
    out += [text_chunk(*t) for t in text]
    engine, body, since = zlib.compressobj(level), b"", 0
    data: list[bytes] = []
    stride = max(1, channels * depth // 8)
    for k, pw, ph in pass_sizes(w, h, interlaced):
        x0, y0, dx, dy = PASSES[k][:4] if interlaced else (0, 0, 1, 1)
        kinds, rows = filter_rows(pack(samples[y0::dy, x0::dx], depth), stride, filters)
        lines = np.concatenate([kinds[:, None], rows], axis=1)
        while flush_rows and len(lines) >= flush_rows - since:
            body += engine.compress(lines[: flush_rows - since].tobytes()) + engine.flush(zlib.Z_SYNC_FLUSH)
            data, body, lines, since = [*data, body], b"", lines[flush_rows - since :], 0
        body, since = body + engine.compress(lines.tobytes()), since + len(lines)
    data.append(body + engine.flush())
    out += [chunk("IDAT", d[i : i + idat]) for d in data for i in range(0, len(d), idat)]
    out += [text_chunk(*t) for t in late_text]
    out += [chunk(n, d) for n, d, place in unknown if place == 8]
    return b"".join([*out, chunk("IEND", b"")])
