"""A push reader: bytes of one file in any portions, events out as soon as the bytes allow them.

Image data is inflated as it comes and rows are handed over once their last byte is there, so no more than a row, the row above
and an unfinished chunk are held besides the inflater's own window.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from ..sources import codec


@dataclass(frozen=True)
class Event:
    """``kind``: header, chunk, row (with its pass, row of the pass, row of the image and samples), pass_end, end, warning or error."""

    kind: str
    name: str = ""
    pass_: int = 0
    pass_row: int = 0
    y: int = 0
    samples: np.ndarray | None = None
    message: str = ""


class PushReader:
    """``feed`` takes bytes and returns events. After ``pause`` bytes are kept and nothing is read until ``resume``; ``skip`` leaves rows out up to a row of the image."""

    def __init__(self, max_rows: int | None = None) -> None:
        self.image, self.buffer, self.paused, self.over = codec.Image(), b"", False, False
        self.signed, self.engine, self.inflated = False, None, b""
        self.passes: list[tuple[int, int, int]] = []
        self.above: np.ndarray | None = None
        self.row, self.rows, self.skipped, self.max_rows, self.seq = 0, 0, 0, max_rows, 0

    def pause(self) -> int:
        """Bytes that wait."""
        self.paused = True
        return len(self.buffer)

    def resume(self) -> list[Event]:
        self.paused = False
        return self.feed(b"")

    def skip(self, y: int) -> None:
        """Rows of the image below ``y`` are read but not handed over."""
        self.skipped = y

    def finish(self) -> list[Event]:
        """What there is to say at the end of the bytes: a file that is cut is an error."""
        if self.over:
            return []
        self.over = True
        missing = self.engine is not None and bool(self.passes)
        return [Event("error", message="Not enough image data" if missing else "Read Error")]

    def feed(self, data: bytes) -> list[Event]:
        self.buffer += data
        out: list[Event] = []
        while not self.paused and not self.over:
            if (events := self._next()) is None:
                break
            out += events
        return out

    def _fail(self, message: str, name: str = "") -> list[Event]:
        self.over = True
        return [Event("error", name, message=message)]

    def _next(self) -> list[Event] | None:
        """Events of the next signature or chunk; None if more bytes are needed."""
        if not self.signed:
            n = min(8, len(self.buffer))
            if n and not codec.same_signature(self.buffer, 0, n):
                return self._fail("PNG file corrupted by ASCII conversion" if self.buffer[:4] == codec.MAGIC[:4] else "Not a PNG file")
            if n < 8:
                return None
            self.signed, self.buffer = True, self.buffer[8:]
            return []
        if len(self.buffer) < 8:
            return None
        n, raw = struct.unpack_from(">I4s", self.buffer)
        if n >> 31:
            return self._fail("PNG unsigned integer out of range")
        if not raw.isalpha() or not raw.isascii():
            return self._fail("invalid chunk type")
        if len(self.buffer) < 12 + n:
            return None
        payload, (crc,), name = self.buffer[8 : 8 + n], struct.unpack_from(">I", self.buffer, 8 + n), raw.decode()
        self.buffer = self.buffer[12 + n :]
        chunk = codec.Chunk(self.seq, 0, name, payload, crc, zlib.crc32(raw + payload) == crc, 8 if self.engine else 1)
        self.seq += 1
        return self._chunk(chunk)

    def _chunk(self, c: codec.Chunk) -> list[Event]:
        if not c.crc_ok:
            return self._fail("CRC error", c.name) if c.critical else [Event("warning", c.name, message="CRC error")]
        if (self.image.header is None) != (c.name == "IHDR"):
            return self._fail("out of place" if c.name == "IHDR" else "missing IHDR", c.name)
        if c.name == "IHDR":
            head = self.image.header = codec.parse_header(c.payload, self.image)
            if head is None:
                return self._notes(0)
            self.passes = codec.pass_sizes(head["width"], head["height"], head["interlaced"])
            return [Event("header", "IHDR")]
        if c.name == "IDAT":
            return self._data(c.payload)
        if c.name == "IEND":
            if self.passes:
                return self._fail("Not enough image data", "IDAT")
            self.over = True
            return [Event("end", "IEND")]
        before = len(self.image.diagnostics)
        codec._parse_optional(c, self.image)
        return [*self._notes(before), Event("chunk", c.name)]

    def _notes(self, start: int) -> list[Event]:
        found = [Event(s, c, message=m) for s, c, m in self.image.diagnostics[start:]]
        self.over = self.over or any(e.kind == "error" for e in found)
        return found

    def _data(self, payload: bytes) -> list[Event]:
        if self.engine is None:
            if self.image.header["color_type"] == 3 and not self.image.palette:
                return self._fail("Missing PLTE before IDAT", "IDAT")
            self.engine = zlib.decompressobj()
        out: list[Event] = []
        while payload or self.engine.unconsumed_tail:
            if not self.passes:
                return [*out, Event("warning", "IDAT", message="Extra compressed data")]
            try:
                got = self.engine.decompress(self.engine.unconsumed_tail + payload if payload else self.engine.unconsumed_tail, 1 << 16)
            except zlib.error as e:
                return [*out, *self._fail(f"IDAT: {e}", "IDAT")]
            payload = b""
            self.inflated += got
            out += self._rows()
            if self.over or not got and not self.engine.unconsumed_tail:
                break
        return out

    def _rows(self) -> list[Event]:
        head, out, at = self.image.header, [], 0
        while self.passes:
            k, width, height = self.passes[0]
            n = (width * head["pixel_depth"] + 7) // 8
            if len(self.inflated) - at < n + 1:
                break
            kind, line = self.inflated[at], np.frombuffer(self.inflated, np.uint8, n, at + 1)
            at += n + 1
            if kind > 4:
                return [*out, *self._fail("bad adaptive filter value", "IDAT")]
            above = self.above if self.row else np.zeros(n, np.uint8)
            # the row above goes along as one that is not predicted
            self.above = codec.unfilter(np.array([0, kind], np.uint8), np.stack([above, line]), head["filter_stride"])[1]
            y = codec.PASSES[k][1] + self.row * codec.PASSES[k][3] if head["interlaced"] else self.row
            if y >= self.skipped:
                out.append(Event("row", "IDAT", k, self.row, y, codec.unpack(self.above[None], width, head["channels"], head["bit_depth"])[0]))
                self.rows += 1
            self.row += 1
            if self.row == height:
                out.append(Event("pass_end", "IDAT", k, self.row, y))
                self.passes, self.row = self.passes[1:], 0
            if self.max_rows is not None and self.rows >= self.max_rows:
                self.over, self.passes = True, []
        self.inflated = self.inflated[at:]
        return out
