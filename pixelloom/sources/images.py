"""Image files as relations: ``binaryFile`` scans, one image a record, decoded in Arrow tasks.

Each relation names the wanted parts, so a scan for headers or text inflates no pixels, and a damaged file gives
diagnostics rather than a failed job.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec

HEADER = "width int, height int, bit_depth int, color_type int, interlaced boolean, channels int, pixel_depth int, row_bytes int, filter_stride int"
SCHEMAS = {
    "chunks": "image_id string, seq int, offset long, name string, length long, payload binary, crc long, crc_ok boolean, location int",
    "headers": f"image_id string, {HEADER}",
    "palette": "image_id string, idx int, r int, g int, b int, a int, freq int",
    "scanlines": "image_id string, pass int, pass_row int, filter int",
    "rows": "image_id string, y int, width int, channels int, samples array<int>",
    "typed_rows": "image_id string, y int, width int, channels int, samples array<int>, color_type int, bit_depth int, transparent boolean, key array<int>, gamma int, sample_bits int",
    "text": "image_id string, ord int, compression int, keyword string, text string, language string, translated string",
    "unknown": "image_id string, ord int, name string, data binary, location int",
    "diagnostics": "image_id string, seq int, severity string, chunk string, message string",
    "metadata": "image_id string, name string, value string",
}


def files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """image_id, content of the files under ``path`` (any store that Spark reads)."""
    return spark.read.format("binaryFile").options(**options).load(path).select(F.col("path").alias("image_id"), "content")


def kind_of(image: codec.Image) -> tuple | None:
    """color_type, bit_depth, transparent, key (red, green, blue), gamma, significant bits: what a plan depends on; None without a header."""
    if image.header is None:
        return None
    trns, color = image.metadata.get("tRNS"), image.header["color_type"]
    key = [trns[c] for c in ("red", "green", "blue")] if trns and color in (0, 2) else [0, 0, 0]
    bits = image.metadata.get("sBIT", {})
    known = max(bits.get(c, 0) for c in (("red", "green", "blue") if color & 2 else ("gray",)))
    return color, image.header["bit_depth"], trns is not None, key, image.metadata.get("gAMA", 0), known


def _rows(kind: str, content: bytes | None, policy: dict) -> list[tuple]:
    image = codec.decode(content, pixels=kind in ("rows", "typed_rows", "scanlines", "diagnostics"), **policy)
    if kind == "chunks":
        return [(c.seq, c.offset, c.name, len(c.payload), c.payload, c.crc, c.crc_ok, c.location) for c in image.chunks]
    if kind == "headers":
        return [tuple(image.header.values())] if image.header else []
    if kind == "palette":
        freq = image.metadata.get("hIST", [])
        return [(i, *e, image.alpha[i] if i < len(image.alpha) else 255, freq[i] if i < len(freq) else None) for i, e in enumerate(image.palette)]
    if kind == "scanlines":
        return image.filters
    if kind in ("rows", "typed_rows"):
        more = kind_of(image) if kind == "typed_rows" else ()
        return [] if image.samples is None else [(y, image.header["width"], image.header["channels"], row.ravel().tolist(), *more) for y, row in enumerate(image.samples)]
    if kind == "text":
        return [(i, *t) for i, t in enumerate(image.text)]
    if kind == "unknown":
        return [(i, *u) for i, u in enumerate(image.unknown)]
    if kind == "metadata":
        return [(k, json.dumps(v, default=lambda b: b.hex())) for k, v in image.metadata.items()]
    return [(i, *d) for i, d in enumerate(image.diagnostics)]


def relation(images: DataFrame, kind: str, quiet_crc: bool = False, **policy) -> DataFrame:
    """One of ``SCHEMAS`` from (image_id, content); ``policy`` is ``codec.decode``'s."""
    schema, policy = SCHEMAS[kind], {"quiet_crc": quiet_crc, **policy}

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _rows(kind, content.as_py(), policy)
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    cols = [[name] * len(part), *map(list, zip(*part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [arrow[f.split()[1]] for f in schema.split(", ")]
    return images.select(F.col("image_id").cast("string"), "content").mapInArrow(run, schema)


def explode_rows(rows: DataFrame, *more: str) -> DataFrame:
    """image_id, y, x, c0..c3 (NULL beyond the image's channels) and ``more`` of rows of samples; no shuffle."""
    at = rows.select("image_id", "y", "samples", "channels", *more, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    take = [F.when(F.col("channels") > k, F.get("samples", F.col("x") * F.col("channels") + k)).alias(f"c{k}") for k in range(4)]
    return at.select("image_id", "y", "x", *take, *more)


def pixels(images: DataFrame, quiet_crc: bool = False, **policy) -> DataFrame:
    """image_id, y, x, c0..c3 (NULL beyond the image's channels); no shuffle."""
    return explode_rows(relation(images, "rows", quiet_crc, **policy))


def packed_rows(pixel_rows: DataFrame, channels: list[str], depth: int) -> DataFrame:
    """image_id, rows: each image's rows in order, their samples in order as one array of the narrowest integers, moved to be signed."""
    kind, half = ("smallint", 1 << 15) if depth == 16 else ("tinyint", 1 << 7)
    cells = F.array_sort(F.collect_list(F.struct("x", *channels)))
    sample = lambda c: F.array(*[(c[n].cast("int") - half).cast(kind) for n in channels])
    spread = pixel_rows.select("image_id", "y", "x", *channels).repartition("image_id")  # rows and images are then grouped in place
    rows = spread.groupBy("image_id", "y").agg(F.flatten(F.transform(cells, sample)).alias("row"))
    return rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda r: r["row"]).alias("rows"))


def encode_images(pixel_rows: DataFrame, width: int | None, channels: list[str], depth: int, color: int, interlaced: bool = False, palettes: DataFrame | None = None, **options) -> DataFrame:
    """image_id, content from a pixel relation (image_id, y, x, channels): rows of bytes, then one record an image.

    Images may differ in size; with ``width`` given they may not. ``palettes`` (image_id, entries, alpha: arrays) gives each its own palette. An
    image's samples meet in one record since a file is one record; images are spread by id.
    """
    grouped = packed_rows(pixel_rows, channels, depth)
    if palettes is not None:
        grouped = grouped.join(palettes.select("image_id", "entries", "alpha"), "image_id", "left").select("image_id", "rows", "entries", "alpha")
    half = 1 << 15 if depth == 16 else 1 << 7

    def run(batches):
        for batch in batches:
            out, more = [], [{}] * batch.num_rows
            if batch.num_columns > 2:
                more = [{"palette": e or [], "alpha": a or []} for e, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            for rows, own in zip(batch.column(1), more):
                flat = rows.values.flatten().to_numpy().astype(np.int32) + half
                wide = len(flat) // len(rows.values) // len(channels)
                if len({len(r) for r in rows.values}) != 1 or width not in (None, wide):
                    raise ValueError("rows of an image differ in length")
                out.append(codec.encode(flat.reshape(-1, wide, len(channels)), depth, color, interlaced, **options | own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "content"])

    kind = pixel_rows.schema["image_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"image_id {kind}, content binary")
