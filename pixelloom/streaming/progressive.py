"""The push reader on Structured Streaming: byte slices of many images in, rows of finished images out.

State per image is the slices that have arrived, bounded by the file size; an image is decoded once its end chunk is
there. Slices may arrive out of order. With a timeout, abandoned images are dropped after that much processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import codec
from .push import PushReader

OUT = "image_id long, y int, samples array<int>, message string"
STATE = "seqs array<int>, parts array<binary>"
END = b"IEND\xaeB`\x82"


def _finished(parts: dict[int, bytes]) -> bytes | None:
    """The whole file once slices 0..n are all there and end in the end chunk."""
    if sorted(parts) != list(range(len(parts))):
        return None
    whole = b"".join(parts[i] for i in range(len(parts)))
    return whole if whole.endswith(END) or len(whole) >= 8 and whole[:8] != codec.MAGIC else None


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([{"image_id": key[0], "y": None, "samples": None, "message": "abandoned"}])
        return
    parts = dict(zip(*state.get)) if state.exists else {}
    for f in frames:
        parts |= dict(zip(f["seq"].tolist(), map(bytes, f["bytes"])))
    whole = _finished(parts)
    if whole is None:
        state.update((list(parts), list(parts.values())))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        return
    if state.exists:
        state.remove()
    image = codec.decode(whole)
    if image.samples is not None:
        yield pd.DataFrame({"image_id": key[0], "y": range(len(image.samples)), "samples": [r.ravel().tolist() for r in image.samples], "message": None})
    else:
        yield pd.DataFrame([{"image_id": key[0], "y": None, "samples": None, "message": image.diagnostics[-1][2]}])


def progressive_rows(slices: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``OUT`` rows of a stream (image_id long, seq int, bytes binary).

    A timeout keeps a query with ``availableNow`` going, since time never stops; leave it out there.
    """
    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return slices.groupBy("image_id").applyInPandasWithState(lambda k, f, s: _advance(k, f, s, timeout_ms), OUT, STATE, "append", kind)


EVENTS = "image_id long, seq int, kind string, name string, pass int, pass_row int, y int, samples array<int>, message string"


def _events_of(key: tuple, frame: pd.DataFrame, max_rows: int | None) -> pd.DataFrame:
    reader, found = PushReader(max_rows), []
    frame = frame.sort_values("seq").drop_duplicates("seq")
    for seq, data in zip(frame["seq"].tolist(), frame["bytes"]):
        found += [(seq, e) for e in reader.feed(bytes(data))]
        if reader.over:
            break
    found += [(None, e) for e in reader.finish()]
    rows = [(key[0], seq, e.kind, e.name, e.pass_, e.pass_row, e.y, None if e.samples is None else e.samples.ravel().tolist(), e.message) for seq, e in found]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])


def slice_events(slices: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``EVENTS`` of (image_id long, seq int, bytes binary): headers, chunks, rows and ends of passes, each with the slice that completed it.

    One task reads an image slice by slice, inflating each byte once. What only the end of the slices shows (a file that is cut) has no slice.
    ``max_rows`` stops reading an image after so many rows.
    """
    return slices.groupBy("image_id").applyInPandas(lambda key, frame: _events_of(key, frame, max_rows), EVENTS)
