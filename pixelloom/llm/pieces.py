"""SentencePiece encoding and decoding with spans of the original bytes.

The model file is read here: its compiled character map (a double-array trie and its replacements) drives a
longest-prefix normalisation which records, for every normalised byte, the source byte it came from. Pieces are
merged here too, best score first and leftmost on ties, what no piece covers falling back to bytes; word by word where no piece has
a word mark after other characters, so that no merge crosses a word, each distinct word once a worker. Piece lengths over the
normalised bytes give offsets, and the recorded alignment projects them to byte spans of the source. The library decodes, and
encodes for models that are not of merged pairs.

Defined results: a null text is the empty text, which encodes to the begin and end ids alone; rows that repeat
encode alike; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_WORDS, CACHED_LENGTH = 200_000, 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The model type of merged pairs.
BPE = 2


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(buf):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = buf[i : i + 8], i + 8
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            value, i = buf[i : i + 4], i + 4
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: longest-prefix replacement by a double-array trie."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.strings = [], b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.strings = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, source: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at ``start`` and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(start, len(source)):
            node ^= source[i]
            unit = self.units[node]
            if unit & 0x800000FF != source[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - start, self.units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class PieceModel:
    """A model file: pieces, normaliser settings and the library's processor."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for field, value in _fields(proto):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.kinds.append(piece.get(3, NORMAL))
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.widths = np.array([0 if k == CONTROL else 1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds)], np.int64)
        plain = not self.map.units and self.dummy_prefix and not self.trim and self.escape
        #: Words can be merged apart from each other.
        self.by_word = plain and not any(k == USER_DEFINED or MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds)) and BYTE in self.kinds
        #: Pairs can be merged here: a byte for everything, no pieces that are cut out first or taken apart again.
        self.merges = trainer.get(3, 1) == BPE and BYTE in self.kinds and not {USER_DEFINED, UNUSED} & set(self.kinds) and not trainer.get(24, 0)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        joined = re.escape("".join(sorted({c for p in self.id_of if len(p) > 1 for c in p} - {MARK})))
        self.parts = re.compile(f"{MARK}+[{joined}]*|[{joined}]+|[^{MARK}{joined}]" if joined else ".", re.S)
        self.known: dict[str, list[int]] = {}
        self.together = _Together(self.id_of, self.scores) if self.merges and self.by_word else None
        self.words = _Words(self.merged_word if self.merges else self.library.encode, self.pieces.index(MARK) if MARK in self.pieces else None)

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source offset of each of them and of the end."""
        mark = MARK.encode() if self.escape else b" "
        if self.by_word:
            if not source:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(source, np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            return mark + source.replace(b" ", mark), np.concatenate([np.zeros(3, np.int64), at, [len(raw)]])
        out, at, i = bytearray(), [], 0
        while self.trim and i < len(source):  # leading spaces go
            n, new = self._step(source, i)
            if new != b" ":
                break
            i += n
        if i == len(source):
            return b"", np.array([len(source)], np.int64)
        if self.dummy_prefix:
            out += mark
            at += [i] * len(mark)
        spaced = self.trim
        while i < len(source):
            n, new = self._step(source, i)
            if spaced and self.trim:
                new = new.lstrip(b" ")
            if new:
                for b in new:
                    piece = mark if b == 32 else bytes([b])
                    out += piece
                    at += [i] * len(piece)
                spaced = new.endswith(b" ")
            i += n
        while self.trim and out.endswith(mark):
            del out[-len(mark) :], at[-len(mark) :]
        return bytes(out), np.array([*at, len(source)], np.int64)

    def _step(self, source: bytes, i: int) -> tuple[int, bytes]:
        if hit := self.map.longest(source, i):
            return hit
        b = source[i]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, source[i : i + n]

    def merged(self, norm: str) -> list[int]:
        """Ids of normalised text: neighbours that make a piece are merged, the best score first, the leftmost of equal ones."""
        parts: list[str] = list(norm)
        n, id_of, scores = len(parts), self.id_of, self.scores
        after, before, agenda = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (k := id_of.get(parts[left] + parts[right])) is not None:
                heappush(agenda, (-scores[k], left, right, len(parts[left]) + len(parts[right])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heappop(agenda)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue  # one of the two was merged meanwhile
            parts[left] += parts[right]
            parts[right], beyond = "", after[right]
            after[left] = beyond
            if beyond >= 0:
                before[beyond] = left
            offer(before[left], left)
            offer(left, beyond)
        return self._named([p for p in parts if p])

    def _named(self, parts: list[str]) -> list[int]:
        """Ids of parts; one that is no piece is a single character and goes by its bytes."""
        get = self.id_of.get
        out = [get(p, -1) for p in parts]
        if -1 in out:
            out = [k for p, found in zip(parts, out) for k in ([found] if found >= 0 else [self.byte_id[b] for b in p.encode()])]
        return out

    def merged_word(self, word: str) -> list[int]:
        """Ids of the word mark followed by ``word``, whose spaces are marks too.

        The word is taken apart at characters that no piece joins to others, and its parts are merged once a worker.
        """
        norm = MARK + word.replace(" ", MARK)
        if not self.by_word:
            return self.merged(norm)
        out: list[int] = []
        for part in self.parts.findall(norm):
            if (ids := self.known.get(part)) is None:
                ids = self.merged(part)
                if len(part) <= CACHED_LENGTH:
                    if len(self.known) >= CACHED_WORDS:
                        self.known.clear()
                    self.known[part] = ids
            out += ids
        return out

    def ids(self, text: str) -> list[int]:
        """Ids of ``text`` without the begin and end ids."""
        if not text:
            return []
        if not self.by_word:
            return self.merged(self.normalise(text.encode())[0].decode()) if self.merges else self.library.encode(text)
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text that is not empty, each without the mark in front of it."""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def learn(self, texts: list[str]) -> None:
        """Merge the words of some texts that are not known yet, all at once."""
        if self.together is None:
            return
        words = self.words
        used = {w for t in texts if t for w in self.split(t)}
        words.make_room(sum(w not in words for w in used))
        words.update(self.together.merge([w for w in used if w not in words and len(w) < CACHED_LENGTH]))

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """All ids, and the start and end source byte of each (begin and end ids are empty spans)."""
        source = text.encode()
        norm, at = self.normalise(source)
        ids = [self.bos, *(self.merged(norm.decode()) if self.merges and not self.by_word else self.ids(text)), self.eos]
        widths = self.widths[ids] if self.by_word or self.merges else np.array([0, *(len(p.piece.encode()) for p in self.library.encode(text, out_type="immutable_proto").pieces), 0])
        ends = np.cumsum(widths)
        if ends[-1] != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        return ids, at[ends - widths], at[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


class _Words(dict):
    """Ids of words, each merged once; ``w`` stands for the word mark followed by ``w``."""

    def __init__(self, encode, mark: int | None) -> None:
        self.encode = encode
        if mark is not None:
            self[""] = (mark,)

    def make_room(self, n: int) -> None:
        """Forget all words if there are too many with ``n`` more."""
        if len(self) + n > CACHED_WORDS:
            mark = self.get("")
            self.clear()
            if mark is not None:
                self[""] = mark

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encode(word))
        if len(word) <= CACHED_LENGTH:
            self.make_room(1)
            self[word] = ids
        return ids


class _Together:
    """Merging of many short words at once: rows of symbols, in each of which the best pair is merged until none is left.

    Symbols are piece ids; a character that is no piece has none, and its words are left to the caller. Pairs of symbols that make a piece are a
    sorted table.
    """

    WIDTHS = (*range(3, 17), 20, 24, 32, CACHED_LENGTH)
    ROWS = 20_000

    def __init__(self, id_of: dict[str, int], scores: list[float]) -> None:
        self.many = max(id_of.values(), default=0) + 1
        found = {}
        for piece, k in id_of.items():
            for cut in range(1, len(piece)):
                left, right = id_of.get(piece[:cut]), id_of.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * self.many + right] = k
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.cost = -np.array(scores, np.float32)[self.made] if len(self.made) else np.zeros(0, np.float32)
        self.char = np.full(0x110000, -1, np.int32)
        for piece, k in id_of.items():
            if len(piece) == 1:
                self.char[ord(piece)] = k

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (infinite if they make none) and id of the piece that two symbols make."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.many + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.cost[at], np.float32(np.inf)), self.made[at]

    def merge(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of the mark and each word, for the words of which every character is a piece."""
        out: dict[str, tuple[int, ...]] = {}
        if not len(self.keys):
            return out
        words = sorted(words, key=len)
        for at in range(0, len(words), self.ROWS):
            part, low = words[at : at + self.ROWS], 0
            for width, high in zip(self.WIDTHS, np.searchsorted([len(w) for w in part], self.WIDTHS).tolist()):
                if high > low:
                    out |= self._rows(part[low:high], width)
                low = high
        return out

    def _rows(self, words: list[str], width: int) -> dict[str, tuple[int, ...]]:
        n = np.array([len(w) + 1 for w in words])
        codes = np.frombuffer("".join(MARK + w.replace(" ", MARK) for w in words).encode("utf-32-le"), np.uint32)
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.char[codes]
        known = np.flatnonzero((ids >= 0).sum(axis=1) == n)
        ids, of = ids[known], known
        cost, made = self.pairs(ids[:, :-1], ids[:, 1:])
        out: dict[str, tuple[int, ...]] = {}
        column = np.arange(width)
        while len(of):
            j = cost.argmin(axis=1)
            row = np.arange(len(of))
            going = cost[row, j] < np.inf
            for k, own in zip(of[~going].tolist(), ids[~going].tolist()):
                out[words[k]] = tuple(own[: own.index(-1)] if own[-1] < 0 else own)
            if not going.any():
                break
            ids, cost, made, of, j = ids[going], cost[going], made[going], of[going], j[going]
            row = np.arange(len(of))
            ids[row, j] = made[row, j]
            after = np.minimum(column + (column > j[:, None]), width - 1)  # what stands right of the merged pair moves up
            ids = np.take_along_axis(ids, after, 1)
            ids[:, -1] = -1
            after = np.minimum(column[:-1] + (column[:-1] >= j[:, None]), width - 2)
            cost, made = np.take_along_axis(cost, after, 1), np.take_along_axis(made, after, 1)
            cost[:, -1] = np.inf
            for side in (j - 1, j):  # the pairs that the new symbol is in
                inside = (side >= 0) & (side < width - 1)
                r, c = row[inside], side[inside]
                cost[r, c], made[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
        return out


_models: dict[str, PieceModel] = {}


def load(proto: bytes) -> PieceModel:
    """The model of ``proto``, built once a worker."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(proto)
    return _models[key]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (source byte spans), decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches):
        model = load(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            model.learn(texts)
            rows = [(*model.encode(t or ""),) for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([np.asarray(r[k], np.int32) for r in rows], kind) for k in range(3)), pa.array([model.decode(r[0]) for r in rows], pa.string())],
                ["doc_id", "ids", "starts", "ends", "decoded"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def encoding_digests(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (source bytes that the spans cover), and ids if asked for.

    The same encoding as ``encode_documents``, reduced to digests where it is made.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "span_bytes": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def digest(model: PieceModel, text: str | None) -> tuple:
        ids, starts, ends = model.encode(text or "")
        packed = array("I", ids).tobytes()
        row = len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest(), int((ends - starts).sum())
        return (*row, np.frombuffer(packed, np.int32)) if with_ids else row

    def run(batches):
        model = load(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                model.learn(texts)
                rows = [digest(model, t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds.values()))], ["doc_id", *kinds])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"
    return source.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
