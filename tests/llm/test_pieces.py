import hashlib
import random
import struct
from array import array

import pytest
import sentencepiece

from pixelloom.llm.pieces import CharacterMap, PieceModel, default_model, encode_documents, encoding_digests, load

TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "▁▁x", "x▁ y", " \n a\t\tb", "日本 語🙂 x", "​ é", "<s> a </s>", "<0x0A> q", "a\u0000b", "word " * 30000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=default_model())


def test_ids_spans_and_decoding_equal_the_library(library):
    model, rng = load(default_model()), random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["a", " ", "  ", "▁", "\n", "é", "the", "🙂", "<s>", ".", " the"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    for t in texts:
        ids, starts, ends = model.encode(t)
        assert ids == library.encode(t, add_bos=True, add_eos=True)
        assert model.decode(ids) == library.decode(ids)
        source = t.encode()
        assert b"".join(source[s:e] for s, e in zip(starts, ends)) == source
        assert all(s <= e for s, e in zip(starts, ends))


def _darts(entries):
    """A double-array trie of byte strings, by brute force, for a test map."""
    units = {0: 0}
    used = {0}

    def place(prefix, node):
        below = sorted({e[len(prefix)] for e in entries if e.startswith(prefix) and len(e) > len(prefix)})
        leaf = prefix in entries
        labels = ([None] if leaf else []) + below
        offset = 1
        while any((node ^ offset ^ (c or 0)) in used for c in labels):
            offset += 1
        units[node] = units.get(node, 0) | offset << 10 | (256 if leaf else 0)
        base = node ^ offset
        for c in labels:
            used.add(base ^ (c or 0))
        if leaf:
            units[base] = entries[prefix] | 0x80000000
        for c in below:
            units[base ^ c] = c
        for c in below:
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    return struct.pack(f"<{max(units) + 300}I", *(units.get(i, 0) for i in range(max(units) + 300)))


def test_longest_prefix_of_a_compiled_map():
    trie = _darts({b"a": 0, b"ab": 2, "ﬁ".encode(): 5})
    charmap = CharacterMap(struct.pack("<I", len(trie)) + trie + b"x\0yy\0fi\0")
    assert charmap.longest(b"abc", 0) == (2, b"yy")
    assert charmap.longest(b"ac", 0) == (1, b"x")
    assert charmap.longest(b"zab", 0) is None
    model = load(default_model())
    other = PieceModel.__new__(PieceModel)
    other.map, other.by_word, other.dummy_prefix, other.trim, other.escape = charmap, False, True, True, True
    norm, at = other.normalise("  aﬁ  ab ".encode())
    assert norm.decode() == "▁xfi▁yy"
    assert at.tolist() == [2, 2, 2, 2, 3, 3, 6, 6, 6, 8, 8, 11] and model.by_word


def test_query_columns(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "x y", None), (1, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(encoding_digests(docs, default_model()).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encoding_digests(docs.limit(0), default_model()).count() == 0
    full = encode_documents(docs, default_model()).filter("doc_id = 7").first()
    assert full["decoded"] == library.decode(full["ids"]) and len(full["ids"]) == len(full["starts"]) == len(full["ends"])


def test_merging_equals_the_library(library):
    """Words, runs of marks, long words without any space, what no piece covers; with ties everywhere."""
    model, rng = load(default_model()), random.Random(8)
    assert model.merges
    for n in (1, 2, 5, 30, 400):
        for _ in range(150 if n < 30 else 12):
            t = "".join(rng.choice(["a", "aa", "th", "e", "▁", "é", "语", "\u0001", "🙂", "0", "z"]) for _ in range(n))
            assert model.merged("▁" + t) == library.encode(t), t
    for t in ("ab" * 20000, "the\nword\n\n" * 3000, "x\n▁ y" * 4000, "日本語\n" * 200):
        assert model.merged_word(t) == library.encode(t)


def test_words_merged_together_equal_the_library(library):
    model, rng = PieceModel(default_model()), random.Random(9)
    words = ["", " ", "  x", "a" * 63, "a" * 64, "🙂a", "\n"] + ["".join(rng.choice(["a", "aa", "th", "e", "é", "语", ".", "0", "z", "ing"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    found = model.together.merge([w for w in words if len(w) < 64])
    assert len(found) > 2500 and all(list(ids) == library.encode(w) for w, ids in found.items() if w)
    texts = [" ".join(rng.sample(words, 8)) for _ in range(200)] + [None, ""]
    model.learn(texts)
    assert all(model.ids(t) == library.encode(t) for t in texts if t)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3 | 2) + _varint(len(value)) + value if isinstance(value, bytes) else _varint(number << 3) + _varint(value)


def test_a_model_with_a_character_map_equals_the_library():
    """The pieces of the model under a normaliser with the library's own compiled map: ids, and spans where the library gives them."""
    from pixelloom.llm.pieces import _fields

    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = dict(_fields(dict(_fields(spec))[3]))[2]
    assert len(charsmap) > 1000
    for dummy, trim in ((1, 1), (1, 0), (0, 1)):
        settings = _field(1, b"made") + _field(2, charsmap) + _field(3, dummy) + _field(4, trim) + _field(5, 1)
        proto = b"".join(_field(n, settings if n == 3 else v) for n, v in _fields(default_model()) if not isinstance(v, int))
        made, model = sentencepiece.SentencePieceProcessor(model_proto=proto), PieceModel(proto)
        assert model.map.units and not model.by_word and model.merges
        rng = random.Random(dummy + 2 * trim)
        parts = ["a", " ", "  ", "ﬁ", "①", "Ａ", "ｶﾞ", "e\u0301", "\u200b", "\t", "é", "🙂", "the ", "½", "\u3000", "▁", "한"]
        for t in ["", " ", "ﬁne  day ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(300))]:
            ids, starts, ends = model.encode(t)
            assert ids[1:-1] == made.encode(t), t
            source, want = t.encode(), made.encode(t, return_type="proto").pieces
            assert all(0 <= a <= b <= len(source) for a, b in zip(starts, ends)) and list(starts) == sorted(starts)
            whole = [(p, a, b) for p, a, b in zip(want, starts[1:-1], ends[1:-1]) if not p.piece.startswith("<0x")]
            assert [p.begin for p, _, _ in whole] == [a for _, a, _ in whole], t
            assert [p.surface for p, _, _ in whole[:-1]] == [source[a:b].decode() for _, a, b in whole[:-1]], t  # trailing space is the last one's
