"""A Python data source ``loom_png``: chunks of image files as rows, and a sink that writes (name, content) rows as files.

Paths are of any store that pyarrow knows (local folders, ``s3://``, ``gs://``, ``hdfs://``), the same for driver and executors. For other
stores ``images.files`` reads with Spark's own ``binaryFile``.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyarrow import fs

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codec


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def _listed(path: str) -> list[str]:
    """Image files below a folder, or the file itself, as paths of the store."""
    store, inside = _store(path)
    if store.get_file_info(inside).type == fs.FileType.File:
        return [inside]
    found = store.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".png") and not f.base_name.startswith("."))


class PngSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_png"

    def schema(self) -> str:
        return "image_id string, seq int, offset long, name string, length long, payload binary, crc_ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.files = _listed(self.path)
        self.group = int(options.get("files_per_task", "64"))

    def partitions(self):
        return [InputPartition(self.files[i : i + self.group]) for i in range(0, len(self.files), self.group)] or [InputPartition([])]

    def read(self, partition):
        store, _ = _store(self.path)
        for path in partition.value:
            with store.open_input_stream(path) as f:
                for c in codec.lex(f.read(), codec.Image()):
                    yield path, c.seq, c.offset, c.name, len(c.payload), c.payload, c.crc_ok


@dataclass
class _Written(WriterCommitMessage):
    moves: list


class _Writer(DataSourceWriter):
    """Files are written under a hidden name and moved at commit, so a failed task leaves no image behind."""

    def __init__(self, options, columns) -> None:
        self.path, self.columns = options["path"], columns

    def write(self, rows):
        store, inside = _store(self.path)
        store.create_dir(inside, recursive=True)
        name, content = self.columns.index("image_id"), self.columns.index("content")
        moves = []
        for row in rows:
            hidden = f"{inside}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(bytes(row[content]))
            moves.append((hidden, f"{inside}/{os.path.basename(str(row[name]))}.png"))
        return _Written(moves)

    def commit(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for a, b in m.moves:
                store.move(a, b)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for a, _ in m.moves if m else []:
                if store.get_file_info(a).type == fs.FileType.File:
                    store.delete_file(a)


def register(spark) -> None:
    spark.dataSource.register(PngSource)
