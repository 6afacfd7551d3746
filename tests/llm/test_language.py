import zlib

import numpy as np

from pixelloom.llm import language
from pixelloom.llm.common import table
from pixelloom.llm.language import identify, train

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, DATA, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = identify(docs, train(docs)).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_every_language_is_learned(spark):
    codes = [f"{a}{b}" for a in "qwxyz" for b in "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"][:130]
    codes = [f"{c}{i}" for i, c in enumerate(codes + codes)]
    rows = [(i, f"{c} {c * 3} {'12' * (i % 3)}", c) for i, c in enumerate(codes * 2)] + [(None, "1 2", "digits"), (None, None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = {c for i, _, c in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(usable) > 200
    for sample in (400, 1):
        assert {c for own in train(docs, sample=sample).members for c in own} == usable


def test_edges(spark):
    docs = table(spark, DATA, "documents")
    model = train(docs)
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "123 !!", "fr", None), (4, "the of and to in is " * 30000, "xx", "b"), (4, "the of and to in is", "xx", "b"), (None, "de la les des", None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(made, model).collect()
    assert sorted((r["lang_pred"], r["score"] > 0) for r in got) == [("en", True), ("en", True), ("fr", True), ("und", False), ("und", False), ("und", False)]
    assert train(made.limit(0)) is None
    assert {r["lang_pred"] for r in identify(made, None).collect()} == {"und"}
    one = train(made.filter("doc_id = 4"))
    if one is not None:
        assert {r["lang_pred"] for r in identify(made.filter("doc_id = 4"), one).collect()} == {"xx"}
    assert identify(made.limit(0), model).count() == 0


def plain_features(text):
    """Hashed byte n-grams one by one."""
    raw, counts = text.lower().encode(), [0.0] * language.BINS
    for i in range(len(raw)):
        grams = [raw[i] * 3266489917]
        if i + 1 < len(raw):
            grams.append((raw[i] << 8 | raw[i + 1]) * 2246822519)
        if i + 2 < len(raw):
            grams.append((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761)
        for g in grams:
            counts[(g & 0xFFFFFFFF) >> 20] += 1
    root = [c**0.5 for c in counts]
    norm = sum(r * r for r in root) ** 0.5
    return [r / norm for r in root]


def test_features_count_every_n_gram_once_in_slices_too(monkeypatch):
    text = "Ä word or twö, and 3 more words of a löng text. " * 7
    want = plain_features(text)
    for size in (1 << 20, 64, 1):
        monkeypatch.setattr(language, "SLICE", size)
        assert abs(language.features(text) - want).max() < 1e-6


def test_votes_are_one_against_one_and_margins_break_ties():
    """Three languages of one family that beat each other in a ring: each has one vote, the greatest summed margin wins."""
    model = language.LanguageModel.__new__(language.LanguageModel)
    model.families, model.members, model.family_weights, model.scale = ["f"], [["a", "b", "c"]], None, 8.0
    flat = lambda m: np.append(np.zeros(language.BINS, np.float32), np.float32(m))
    model.pairs = [[(0, 1, flat(0.5)), (0, 2, flat(-0.2)), (1, 2, flat(0.1))]]
    assert model.predict("text")[0] == "a"
    model.pairs = [[(0, 1, flat(0.1)), (0, 2, flat(-0.6)), (1, 2, flat(0.1))]]
    assert model.predict("text")[0] == "c"
