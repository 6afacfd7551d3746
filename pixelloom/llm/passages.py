"""Substring deduplication: repeated 20-word windows, by a log-structured index of window fingerprints.

Every window is represented by its least 5-word hash ``m`` (equal windows have equal ``m``). Consecutive windows with one
``m`` form a block, known by ``m`` and a 128-bit digest (``b``, ``d``) of its words' bytes. The index holds each distinct block
once, at its first place, in immutable runs: tables bucketed and sorted by that key, so that a batch, combined map-side and shuffled
once as small rows, is merge-joined with every run without moving or sorting any run again; what is new is the next run. When there
are more than ``MAX_RUNS`` runs they are merged into one, bucket by bucket, and the old ones removed.

A block that the index has at another place repeats in full: that match rests on the digest of the bytes, which is independent of
the word hashes that found it. Where an ``m`` occurs in several different blocks, the windows of those first blocks are told
apart one by one, by 128-bit digests of their bytes, and the first place of each is kept. Texts are shuffled once, at the end, for
all batches together, beside a list of places a document. Repeated windows cost one row a distinct block and task, so no copy group
is gathered anywhere.

Defined results: a null or empty text has no words; fewer than 20 words are never removed; a null id sorts last; rows that
repeat an id are put in some order, the same throughout a call, and the later one loses; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import materialise, quoted, remove, shared_dir, text_or_empty

WINDOW, GRAM = 20, 5
SPAN = WINDOW - GRAM + 1
#: A key below 2**33 and a word position below 2**30 are packed into one long.
KEY_BITS, START_BITS = 33, 30
#: The filter of values that need a second look: 8 MB; used up to this many values, beyond it they are joined.
FILTER_BITS, FILTER_VALUES = 26, 4_000_000
MAX_RUNS = 3
#: Ranges of the id that a whole table is taken in by: one more than the runs that stay apart, so a table passes a compaction.
BATCHES = 4
#: Spark's own bound on buckets of a table.
MAX_BUCKETS = 100_000
#: Documents are worked on together up to this many bytes.
CHUNK_BYTES = 1 << 17

_FACTOR = 0x9E3779B97F4A7C15
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


class _Powers:
    """Powers of the odd factor and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up, self.down = self._grow(1 << 10)

    @staticmethod
    def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
        bases = _FACTOR, pow(_FACTOR, -1, 1 << 64)
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(f))]), dtype=np.uint64) for f in bases)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = self._grow(2 * n)
        return self.up, self.down


_powers = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` of each span: a polynomial, by differences of one running sum."""
    up, down = _powers.to(len(values))
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=upto[1:])
    return _mix((upto[end] - upto[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and 64-bit hash of each word; ``blob`` ends in white space. Long blobs are cut at white space."""
    raw = np.frombuffer(blob, np.uint8)
    space = _SPACES[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[0::2], edges[1::2]
    if len(raw) <= 2 * CHUNK_BYTES:
        return start, _spans_hash(_BYTES[raw], start, end)
    out, at = [], 0
    while at < len(start):  # as many words as a chunk holds, one at least
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        low = start[at]
        out.append(_spans_hash(_BYTES[raw[low : end[to - 1]]], start[at:to] - low, end[at:to] - low))
        at = to
    return start, np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words."""
    h = w[: max(0, len(w) - n + 1)].copy()
    for j in range(1, n):
        h *= np.uint64(_FACTOR)
        h += w[j : len(w) - n + 1 + j]
    return _mix(h)


class Chunk:
    """Words of some documents in one row, and the blocks of their windows.

    ``first``: place of each document's first word (one more at the end). A block has its value ``m``, its first
    window ``start`` and ``stop`` (exclusive) as places, its document ``doc``, and ``own``: it may repeat itself.
    """

    def __init__(self, docs: list[bytes]) -> None:
        docs = [b" ".join(d.split()) for d in docs]
        self.blob = b" ".join(docs) + b" "
        begins = np.cumsum([0] + [len(d) + 1 for d in docs])
        self.at, self.w = word_hashes(self.blob)
        self.first = np.searchsorted(self.at, begins)
        n = np.diff(self.first)
        self.end = np.append(self.at[1:], len(self.blob)) - 1  # of each word; a document's last word ends with it
        self.end[self.first[1:][n > 0] - 1] = (begins[1:] - 1)[n > 0]
        g = gram_hashes(self.w, GRAM)
        low, k = g, 1
        while k * 2 <= SPAN:
            low, k = np.minimum(low[:-k], low[k:]), k * 2
        if k < SPAN and len(low):
            low = np.minimum(low[: k - SPAN], low[SPAN - k :])
        self.windows = len(low)
        valid = np.ones(self.windows, bool)
        for lo, hi in zip(np.maximum(self.first[1:] - WINDOW + 1, self.first[:-1]).tolist(), self.first[1:].tolist()):
            valid[lo:hi] = False
        opens = valid.copy()
        opens[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        begun = self.first[:-1][n >= WINDOW]
        opens[begun] = True
        self.start = np.flatnonzero(opens)
        closes = np.flatnonzero(valid & np.concatenate([opens[1:] | ~valid[1:], [True]])) if self.windows else np.zeros(0, np.int64)
        self.stop = closes + 1
        self.m = low[self.start]
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        while len(self.doc) and (empty := n[self.doc] == 0).any():  # documents without words share a place with the next
            self.doc = self.doc - empty
        seen = np.zeros(self.windows, np.uint8)
        for d in range(SPAN):
            seen += g[d : d + self.windows] == low
        seen[~valid] = 0
        most = np.maximum.reduceat(seen, self.start) if len(self.start) else np.zeros(0, np.uint8)
        self.own = (most > 1) | (self.stop - self.start > SPAN)

    def digests(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digest, as two longs, of the bytes of the windows from each ``start`` up to ``stop``; words are one space apart."""
        blob, spans = self.blob, zip(self.at[start].tolist(), self.end[stop + WINDOW - 2].tolist())
        both = np.frombuffer(b"".join([xxh3_128_digest(blob[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def hashes(self) -> np.ndarray:
        """The first half of each block's digest."""
        return self.digests(self.start, self.stop)[0]

    def places(self, lists: list) -> np.ndarray:
        """Windows named by each document's list of starts."""
        own = [np.asarray(x, np.int64) + f for x, f in zip(lists, self.first.tolist()) if x]
        return np.concatenate(own) if own else np.zeros(0, np.int64)

    def look(self, listed: list, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """First blocks, and those of them whose windows are told apart one by one.

        ``listed`` are starts of first blocks, ``-1 - start`` where the block is marked for the second.
        """
        mark = np.zeros(self.windows + 1, np.uint8)
        mark[self.places([[x if x >= 0 else -1 - x for x in own] if own else None for own in listed])] = 1
        mark[self.places([[-1 - x for x in own if x < 0] if own else None for own in listed])] = 2
        mark = mark[self.start]
        return mark > 0, (mark > 0) & ((mark == 2) | self.own | _in_filter(bits, self.m))

    def spread(self, blocks: np.ndarray) -> np.ndarray:
        """Whether each window is in one of ``blocks``."""
        out = np.zeros(self.windows, bool)
        ends = np.zeros(self.windows + 1, np.int64)
        ends[self.start[blocks]] += 1
        ends[self.stop[blocks]] -= 1
        out[np.cumsum(ends[:-1]) > 0] = True
        return out


def _chunks(batch: pa.RecordBatch, at: int):
    """Row ranges of at most ``CHUNK_BYTES`` of text (one row at least), with the texts as bytes."""
    column = batch.column(at).cast(pa.binary()).fill_null(b"")
    low = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if size and size + n > CHUNK_BYTES:
            yield slice(low, i), column[low:i].to_pylist()
            low, size = i, 0
        size += n + 1
    if low < len(column):
        yield slice(low, len(column)), column[low:].to_pylist()


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64, copy=False) if a.dtype != np.uint64 else a.view(np.int64))


def _emit_blocks(batches):
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for rows, texts in _chunks(batch, 1):
            c = Chunk(texts)
            yield pa.RecordBatch.from_arrays([_longs(x) for x in (c.m, *c.digests(c.start, c.stop), keys[rows][c.doc], c.start - c.first[c.doc])], ["m", "b", "d", "key", "start"])


def _in_filter(bits: np.ndarray | None, m: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(m), bool)
    hit = np.ones(len(m), bool)
    for shift in (0, 19, 38):
        at = (m >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        hit &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _emit_windows(bits):
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows, texts in _chunks(batch, 1):
                c = Chunk(texts)
                _, look = c.look(batch.column(2)[rows.start : rows.stop].to_pylist(), bits.value if bits else None)
                at = np.flatnonzero(c.spread(look))
                of = np.searchsorted(c.start, at, "right") - 1
                doc = c.doc[of]
                yield pa.RecordBatch.from_arrays([_longs(x) for x in (*c.digests(at, at + 1), keys[rows][doc], at - c.first[doc])], ["b", "d", "key", "start"])

    return run


def _stay(c: Chunk, listed: list, kept: list, bits: np.ndarray | None) -> np.ndarray:
    """Whether each word of the chunk stays."""
    first, look = c.look(listed, bits)
    bad = c.spread(~(first & ~look))
    bad[c.places(kept)] = False
    upto = np.concatenate([[0], np.cumsum(bad)])
    i = np.arange(len(c.w))
    return upto[np.minimum(i + 1, c.windows)] == upto[np.minimum(np.maximum(i - WINDOW + 1, 0), c.windows)]


def _emit_result(bits, with_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, out = [], [], []
            for rows, texts in _chunks(batch, 1):
                c = Chunk(texts)
                stay = _stay(c, *(batch.column(k)[rows.start : rows.stop].to_pylist() for k in (2, 3)), bits.value if bits else None)
                for low, high in zip(c.first.tolist(), c.first[1:].tolist()):
                    own = stay[low:high]
                    gone = high - low - int(np.count_nonzero(own))
                    if gone:  # runs of words that stay
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))) + low
                        kept = b" ".join([c.blob[a:b] for a, b in zip(c.at[edges[0::2]].tolist(), c.end[edges[1::2] - 1].tolist())])
                    else:
                        kept = c.blob[c.at[low] : c.end[high - 1]] if high > low else b""
                    n_words.append(high - low)
                    n_removed.append(gone)
                    out.append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], [batch.schema.names[0], "n_words", "n_removed", "kept"])

    return run


BLOCK = ["m", "b", "d"]


class PassageIndex:
    """Runs of first places (m, b, d, key, start), each a table in the shared folder, bucketed and sorted by (m, b, d).

    ``ingest`` takes a batch in and answers for its rows, whose keys are greater than all before. ``add`` only takes it in; ``resolve`` answers
    for all documents at once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = MAX_RUNS) -> None:
        self.spark, self.path, self.max_runs, self.runs = spark, path or f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}", max_runs, []
        self.buckets = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.compactions = 0

    def _write(self, blocks: DataFrame) -> str:
        name = f"passages_{uuid.uuid4().hex}"
        rows = blocks.select(*BLOCK, "key", "start")
        rows.write.format("parquet").bucketBy(self.buckets, *BLOCK).sortBy(*BLOCK).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def read(self, runs: list[str] | None = None) -> DataFrame:
        found = [self.spark.table(r) for r in (self.runs if runs is None else runs)]
        if not found:
            return self.spark.createDataFrame([], "m long, b long, d long, key long, start long")
        return reduce(DataFrame.unionByName, found)

    def drop(self, runs: list[str] | None = None) -> None:
        """Remove runs (all) with their files."""
        for r in list(self.runs if runs is None else runs):
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            remove(self.spark, f"{self.path}/{r}")
            if r in self.runs:
                self.runs.remove(r)

    def compact(self) -> None:
        """Merge all runs into one; a block is in one run only, so rows are as before. Buckets meet their like: no shuffle."""
        old, self.compactions = list(self.runs), self.compactions + 1
        merged = self._write(self.read().sortWithinPartitions(*BLOCK))
        self.drop(old)
        self.runs = [merged]

    def add(self, batch: DataFrame) -> str:
        """Take (key, text) rows in; the run of what is new."""
        order = _Order(batch)
        raw = order.attach(batch.select("key", "text").mapInArrow(_emit_blocks, "m long, b long, d long, key long, start long"))
        blocks = order.split(raw.groupBy(*BLOCK).agg(F.min("pos").alias("pos")))
        for r in self.runs:
            blocks = blocks.join(self.read([r]).select(*BLOCK).hint("merge"), BLOCK, "left_anti")
        self.runs.append(self._write(blocks))
        return self.runs[-1]

    def _compact_if_due(self) -> None:
        if len(self.runs) > self.max_runs:
            self.compact()

    def ingest(self, batch: DataFrame, history: DataFrame | None = None, with_text: bool = False) -> DataFrame:
        """key, n_words, n_removed, kept of each row of ``batch`` (key, text).

        ``kept`` is the kept text, or its SHA-256. ``history`` (key, text) holds the documents of earlier batches: where a value ``m`` of the batch
        meets an earlier block with other words, that block's windows are taken from there.
        """
        past = list(self.runs)
        if past and history is None:
            raise ValueError("the documents of earlier batches are needed")
        new = self.read([self.add(batch)])
        out = self._answer(batch, new, self.read(past) if past else None, history, with_text)
        if len(self.runs) > self.max_runs:  # the answer reads the runs
            out = materialise(out, "passages")
            self.compact()
        return out

    def resolve(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """key, n_words, n_removed, kept of all documents (key, text) taken in so far, and ``doc_id`` for key if there."""
        return self._answer(docs, self.read(), None, None, with_text)

    def _answer(self, batch: DataFrame, new: DataFrame, past: DataFrame | None, history: DataFrame | None, with_text: bool) -> DataFrame:
        order = _Order(batch)
        named = "doc_id" if "doc_id" in batch.columns else "key"
        places = new if past is None else new.unionByName(past.join(new.select("m").distinct(), "m", "left_semi"))
        mixed = materialise(places.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m"), "mixed")
        bits = None
        if mixed.count() <= FILTER_VALUES:
            bits = self.spark.sparkContext.broadcast(_filter_of(mixed))
            listed = new if past is None else new.unionByName(past.join(mixed, "m", "left_semi"))
        else:
            marked = places.join(mixed.withColumn("x", F.lit(True)), "m", "left")
            listed = marked.withColumn("start", F.when(F.col("x"), -1 - F.col("start")).otherwise(F.col("start")))
        lists = listed.groupBy("key").agg(F.collect_list("start").alias("listed"))
        more = [c for c in [named] if c != "key"]
        rows = batch.select("key", "text", *more).join(lists, "key", "left").select("key", "text", "listed", *more)
        looked = rows  # with the same columns for both uses, so that one exchange of the texts serves them
        if past is not None:
            looked = looked.unionByName(history.select("key", "text").join(lists, "key"), allowMissingColumns=True)
        windows = order.attach(looked.mapInArrow(_emit_windows(bits), "b long, d long, key long, start long"))
        firsts = order.split(windows.groupBy("b", "d").agg(F.min("pos").alias("pos")))
        kept = firsts.groupBy("key").agg(F.collect_list("start").alias("kept"))
        done = rows.join(kept, "key", "left").select(named, "text", "listed", "kept")
        return done.mapInArrow(_emit_result(bits, with_text), f"{named} {batch.schema[named].dataType.simpleString()}, n_words long, n_removed long, kept string")


class _Order:
    """How places are compared: key and start as one long if they fit, else as a struct."""

    def __init__(self, batch: DataFrame) -> None:
        top = batch.agg(F.max("key"), F.min("key")).first()
        self.packed = top[0] is None or 0 <= top[1] and top[0] < 1 << KEY_BITS

    def attach(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("pos", F.shiftleft("key", START_BITS) + F.col("start") if self.packed else F.struct("key", "start"))

    def split(self, rows: DataFrame) -> DataFrame:
        if self.packed:
            key, start = F.shiftright("pos", START_BITS), F.col("pos").bitwiseAND(F.lit((1 << START_BITS) - 1))
        else:
            key, start = F.col("pos.key"), F.col("pos.start")
        return rows.withColumn("key", key).withColumn("start", start).drop("pos")


def _filter_of(values: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size: set bits are gathered by word, at most 2**20 of them."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    at = values.select(F.explode(F.array(*[F.shiftrightunsigned("m", s).bitwiseAND(mask) for s in (0, 19, 38)])).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, text with keys in the order of the ids (any whole number, or text), the missing ones last.

    Unique ids are keys themselves. Otherwise the rows are sorted, numbered and written once, so that every later read finds the
    same numbers; a random value among equal ids keeps a frequent one from filling a single task.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(F.col(quoted(text_col))).alias("text"))
    if rows.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        void = F.count(F.when(F.col("doc_id").isNull(), 1)).alias("void")
        counts = rows.groupBy("doc_id").count().agg(F.max("count").alias("most"), void, F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        if (counts["most"] or 0) <= 1 and not counts["void"]:
            low, key = counts["low"] or 0, F.col("doc_id").cast("long")
            as_it_is = low >= 0 and (counts["high"] or 0) < 1 << KEY_BITS  # then ranges of it reach the scan
            return rows.select((key if as_it_is else key - F.lit(low).cast("long")).alias("key"), "doc_id", "text")
    ranged = rows.withColumn("salt", F.rand(7)).orderBy(F.col("doc_id").asc_nulls_last(), "salt")
    return materialise(ranged.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "numbered")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 or (``with_text``) kept: one row per input row.

    The table is taken in by ``batches`` ranges of the key, each merged with the runs of those before.
    """
    index, rows = PassageIndex(docs.sparkSession, max_runs=max_runs), numbered(docs, id_col, text_col)
    at = [k / batches for k in range(1, batches)]
    cuts = sorted(set(rows.agg(F.percentile_approx("key", at).alias("cuts")).first()["cuts"] or [])) if at else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = rows if low is None else rows.filter(F.col("key") > low)
        index.add(batch if high is None else batch.filter(F.col("key") <= high))
        index._compact_if_due()
    found = index.resolve(rows, with_text)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept" if with_text else "kept_sha256"))
