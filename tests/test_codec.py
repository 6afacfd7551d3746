import random
import struct
import zlib

import numpy as np
import pytest

from pixelloom.sources import codec
from pixelloom.sources.codec import CHANNELS, DEPTHS, MAGIC, Image, chunk, decode, encode

SIZES = [(1, 1), (1, 9), (9, 1), (2, 2), (13, 7), (17, 17)]


def sample(w, h, channels, depth, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << depth, (h, w, channels)).astype(np.int32)


@pytest.mark.parametrize("color", sorted(CHANNELS))
@pytest.mark.parametrize("interlaced", [False, True])
def test_round_trip_of_every_kind(color, interlaced):
    for depth in DEPTHS[color]:
        for w, h in SIZES:
            for filters in (None, (0,), (1,), (2,), (3,), (4,)):
                s = sample(w, h, CHANNELS[color], depth)
                pal = [(7 * i % 256, 13 * i % 256, 29 * i % 256) for i in range(1 << min(depth, 8))] if color == 3 else ()
                got = decode(encode(s, depth, color, interlaced, palette=pal, filters=filters))
                assert not got.fatal and (got.samples == s).all() and got.header["bit_depth"] == depth
                assert got.palette == list(pal)


@pytest.mark.parametrize("stride", [1, 2, 3, 4, 6, 8])
def test_wave_front_equals_the_plain_loop(stride):
    rng = np.random.default_rng(stride)
    rows = rng.integers(0, 256, (70, 70 * stride - (stride > 1)), np.uint8)
    for kinds in (rng.integers(0, 5, 70), rng.integers(0, 3, 70)):
        assert (codec.unfilter(kinds, rows, stride) == codec._unfilter_loop(kinds, rows, stride)).all()
        best, filtered = codec.filter_rows(rows, stride)
        assert (codec.unfilter(best, filtered, stride) == rows).all()


def test_passes_cover_each_pixel_once():
    for w in range(1, 21):
        for h in range(1, 21):
            seen = np.zeros((h, w), int)
            for k, pw, ph in codec.pass_sizes(w, h, True):
                x0, y0, dx, dy = codec.PASSES[k][:4]
                assert seen[y0::dy, x0::dx].shape == (ph, pw)
                seen[y0::dy, x0::dx] += 1
            assert (seen == 1).all()


META = {
    "gAMA": 45455, "cHRM": [31270, 32900, 64000, 33000, 30000, 60000, 15000, 6000], "sRGB": 1, "sBIT": {"red": 5, "green": 6, "blue": 5, "gray": 0, "alpha": 8}, "bKGD": {"index": 0, "red": 1, "green": 2, "blue": 3, "gray": 0},
    "pHYs": [3937, 3937, 1], "oFFs": [-12, 34, 0], "tIME": [2026, 7, 29, 13, 45, 7], "sCAL": {"unit": 1, "width": "2.5", "height": "1.25"}, "eXIf": b"MM\0*",
    "pCAL": {"purpose": "depth", "x0": -100, "x1": 5000, "equation": 0, "unit": "metres", "parameters": ["1.5", "-2"]},
    "sPLT": [{"name": "p", "depth": 8, "entries": [[1, 2, 3, 4, 500]]}, {"name": "q", "depth": 16, "entries": [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10]]}],
    "iCCP": {"name": "prof", "profile": bytes(128) + struct.pack(">I", 2) + bytes(24)},
}


def test_metadata_round_trip():
    text = [(-1, "Title", "a\xe9", "", ""), (0, "Z", "zz" * 100, "", ""), (1, "I", "日本", "ja", "訳"), (2, "J", "x" * 500, "en", "t")]
    got = decode(encode(sample(6, 3, 3, 8), 8, 2, metadata=META, text=text, unknown=[("abCd", b"hi", 2), ("zzZz", b"end", 8)], key=(1, 2, 3)))
    assert not got.diagnostics and got.text == text
    assert {k: v for k, v in got.metadata.items() if k != "tRNS"} == META
    assert got.metadata["tRNS"] == {"count": 1, "index": 0, "red": 1, "green": 2, "blue": 3, "gray": 0}
    assert got.unknown == [("abCd", b"hi", 1), ("zzZz", b"end", 8)]


@pytest.mark.parametrize("name, payload", [("gAMA", b"123"), ("cHRM", b""), ("sRGB", b"\x04"), ("sBIT", b"\x09\x01\x01"), ("pHYs", b"1"), ("tIME", b"1"), ("sCAL", b"\x031\x001"), ("pCAL", b"a\0" + struct.pack(">iiBB", 0, 1, 0, 3) + b"u\x001\x002\x003"), ("sPLT", b"n\0\x09"), ("iCCP", b"n\0\0bad"), ("tEXt", b"no nul"), ("zTXt", b"k\0\1"), ("iTXt", b"k\0\2\0"), ("hIST", b"12"), ("tRNS", b"1"), ("cICP", b"1"), ("cLLI", b"1"), ("mDCV", b"1"), ("eXIf", b"")])
def test_bad_ancillary_chunks_are_warnings(name, payload):
    data = encode(sample(3, 3, 3, 8), 8, 2)
    got = decode(data[:33] + chunk(name, payload) + data[33:])
    assert [(s, c) for s, c, _ in got.diagnostics] == [("warning", name)] and got.samples is not None


def test_damaged_files_never_raise():
    rng = random.Random(1)
    data = encode(sample(9, 5, 3, 8), 8, 2, metadata=META, palette=[(1, 2, 3)])
    for _ in range(600):
        b = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(3)
            at = rng.randrange(len(b))
            if kind == 0:
                b[at] ^= 1 << rng.randrange(8)
            elif kind == 1:
                del b[at:]
                break
            else:
                b[at:at] = bytes(rng.randrange(256) for _ in range(3))
            if not b:
                break
        got = decode(bytes(b))
        assert got.fatal or got.samples is not None
    assert [d[2] for d in decode(b"xxxxxxxxx").diagnostics] == ["Not a PNG file"]
    assert [d[2] for d in decode(MAGIC[:4] + b"\n\x1a\n\n").diagnostics] == ["PNG file corrupted by ASCII conversion"]
    assert decode(None).fatal and isinstance(decode(b""), Image)


def test_header_problems_are_all_reported():
    bad = MAGIC + chunk("IHDR", struct.pack(">IIBBBBB", 0, 0, 3, 1, 1, 1, 2))
    assert len([d for d in decode(bad).diagnostics if d[0] == "warning"]) == 7 and decode(bad).fatal


def test_short_and_long_image_data():
    data = MAGIC + chunk("IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0))
    end = chunk("IEND", b"")
    assert decode(data + chunk("IDAT", zlib.compress(b"\0ab")) + end).diagnostics[0][2] == "Not enough image data"
    assert decode(data + chunk("IDAT", zlib.compress(b"\0ab\0cdXX")) + end).diagnostics == [("warning", "IDAT", "Extra compressed data")]
    assert decode(data + chunk("IDAT", zlib.compress(b"\5ab\0cd")) + end).fatal


def test_a_header_that_claims_too_much_gives_diagnostics():
    """A file of some 70 bytes says it is 60,000 x 60,000, or a million squared: no memory is taken for it."""
    import resource
    import struct

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for side, depth, color in ((60_000, 8, 0), (1_000_000, 16, 6)):
        for interlaced in (0, 1):
            head = codec.chunk("IHDR", struct.pack(">IIBBBBB", side, side, depth, color, 0, 0, interlaced))
            image = codec.decode(codec.MAGIC + head + codec.chunk("IDAT", zlib.compress(b"\0" * 40)) + codec.chunk("IEND", b""))
            assert image.samples is None and ("error", "IDAT", "Not enough image data") in image.diagnostics
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def pushed(content, step, **options):
    from pixelloom.streaming.push import PushReader

    reader, events = PushReader(**options), []
    for at in range(0, len(content), step):
        events += [(at // step, e) for e in reader.feed(content[at : at + step])]
    return events + [(None, e) for e in reader.finish()]


@pytest.mark.parametrize("color, depth, interlaced", [(0, 1, False), (0, 4, True), (2, 8, True), (2, 8, False), (3, 2, True), (6, 16, True), (4, 8, False)])
@pytest.mark.parametrize("step", [1, 7, 5000])
def test_pushed_rows_are_the_decoded_ones(color, depth, interlaced, step):
    rng = np.random.default_rng(color + depth)
    top = 4 if color == 3 else 1 << depth
    px = rng.integers(0, top, (11, 9, codec.CHANNELS[color])).astype(np.int32)
    pal = [(i, i, i) for i in range(4)] if color == 3 else ()
    content = codec.encode(px, depth, color, interlaced, palette=pal, filters=(0, 1, 2, 3, 4), idat=50, flush_rows=2, late_text=[(-1, "Title", "t", "", "")])
    events = pushed(content, step)
    got, ends = np.full_like(px, -1), []
    for _, e in events:
        if e.kind == "row":
            x0, _, dx, _ = codec.PASSES[e.pass_][:4] if interlaced else (0, 0, 1, 1)
            got[e.y, x0::dx] = e.samples
        elif e.kind == "pass_end":
            ends.append(e.pass_)
    assert (got == px).all() and ends == [k for k, _, _ in codec.pass_sizes(9, 11, interlaced)]
    assert [e.kind for _, e in events if e.kind not in ("row", "pass_end")][0] == "header" and events[-1][1].kind == "end"
    assert codec.decode(content).text[0][1] == "Title"
    if step == 7:  # rows come before the last slice
        assert min(at for at, e in events if e.kind == "row") < len(content) // step - 2


def test_pushing_pauses_skips_stops_and_says_what_is_wrong():
    from pixelloom.streaming.push import PushReader

    px = np.arange(60).reshape(10, 6, 1).astype(np.int32)
    content = codec.encode(px, 8, 0)
    reader = PushReader()
    first = reader.feed(content[:40])
    waiting = reader.pause()
    assert reader.feed(content[40:]) == [] and reader.pause() == waiting + len(content) - 40
    assert [e.kind for e in first] == ["header"] and [e.kind for e in reader.resume()].count("row") == 10
    reader = PushReader()
    reader.skip(7)
    assert [e.y for e in reader.feed(content) if e.kind == "row"] == [7, 8, 9]
    assert sum(e.kind == "row" for _, e in pushed(content, 3, max_rows=4)) == 4
    for bad, message in ((content[:-20], "Read Error"), (b"\x89PNG\n", "PNG file corrupted by ASCII conversion"), (b"GIF89a", "Not a PNG file"), (content[:60] + b"\0" + content[61:], "CRC error")):
        found = [e for _, e in pushed(bad, 5) if e.kind == "error"]
        assert len(found) == 1 and (found[0].message == message or found[0].message == "Not enough image data"), (found, message)


def test_policies_for_checksums_and_unknown_chunks():
    px = np.zeros((1, 1, 1), np.int32)
    content = codec.encode(px, 8, 0, metadata={"gAMA": 45455}, unknown=[("prVt", b"a", 1), ("saFe"[:3] + "e", b"b", 2), ("neVR", b"c", 8)])
    at = content.index(b"gAMA")
    broken = content[: at + 4] + b"\1" + content[at + 5 :]
    outcome = {a: codec.decode(broken, ancillary_crc=a) for a in codec.CRC_ACTIONS["ancillary"]}
    assert [("gAMA" in i.metadata, i.fatal, len(i.diagnostics)) for i in outcome.values()] == [(False, False, 1), (False, True, 1), (True, False, 1), (True, False, 0)]
    at = content.index(b"IDAT")
    broken = content[: content.index(b"IEND") - 5] + b"\0" + content[content.index(b"IEND") - 4 :]
    assert codec.decode(content).fatal is False and at
    names = lambda **p: [n for n, _, _ in codec.decode(content, **p).unknown]
    assert names() == ["prVt", "safe"[:2] + "Fe", "neVR"] and names(keep="never") == [] and names(keep="if_safe") == ["prVt", "saFe"]
    assert names(keep="never", keep_named={"neVR": "always"}) == ["neVR"] and names(keep_named={"prVt": "never"}) == ["saFe", "neVR"]
    seen = []
    assert names(handler=lambda n, d: seen.append((n, d)) or n == "prVt") == ["saFe", "neVR"] and seen[0] == ("prVt", b"a")
    image = codec.decode(content, handler=lambda n, d: 1 / 0)
    assert len(image.unknown) == 3 and [d[0] for d in image.diagnostics] == ["warning"] * 3
    with pytest.raises(ValueError):
        codec.decode(content, keep="sometimes")


def test_signatures_in_part():
    assert codec.same_signature(codec.MAGIC) and codec.same_signature(codec.MAGIC[:3], 0, 3) and codec.same_signature(codec.MAGIC + b"x", 4, 40)
    assert not codec.same_signature(codec.MAGIC[:3]) and not codec.same_signature(codec.MAGIC, 8, 1) and not codec.same_signature(codec.MAGIC, 0, 0)


def test_samples_that_do_not_fit_are_refused():
    for px, depth, color in ((np.full((1, 1, 1), 256), 8, 0), (np.full((1, 1, 1), -1), 8, 0), (np.zeros((1, 1, 1), int), 8, 3)):
        with pytest.raises(ValueError):
            codec.encode(px.astype(np.int32), depth, color)


def test_runs_of_rows_are_undone_as_one_by_one():
    rng = np.random.default_rng(5)
    for stride, width, height in ((1, 301, 40), (3, 300, 37), (4, 402, 30), (6, 600, 20)):
        for kinds in (np.full(height, 4), np.full(height, 3), np.full(height, 1), rng.integers(0, 5, height), np.sort(rng.integers(0, 5, height)), rng.integers(3, 5, height)):
            rows = rng.integers(0, 256, (height, width)).astype(np.uint8)
            want = codec._unfilter_loop(kinds.astype(np.uint8), rows, stride)
            assert (codec.unfilter(kinds.astype(np.uint8), rows, stride) == want).all(), (stride, kinds)
            made, coded = codec.filter_rows(want, stride)
            assert (codec.unfilter(made, coded, stride) == want).all()


def test_the_cheapest_filter_is_the_first_of_the_least_sums():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 256, (12, 15)).astype(np.uint8)
    kinds, _ = codec.filter_rows(rows, 3)
    for y in range(12):
        sums = []
        for kind in range(5):
            total = 0
            for i in range(15):
                a, b, c = (int(rows[y, i - 3]) if i >= 3 else 0), (int(rows[y - 1, i]) if y else 0), (int(rows[y - 1, i - 3]) if y and i >= 3 else 0)
                d = (int(rows[y, i]) - codec._predict(kind, a, b, c)) % 256
                total += min(d, 256 - d)
            sums.append(total)
        assert kinds[y] == sums.index(min(sums))
