import hashlib
import random

import numpy as np
import pytest

from pixelloom.llm import passages
from pixelloom.llm.passages import WINDOW, Chunk, PassageIndex, remove_repeats, word_hashes


def plain(rows):
    """Kept words of each (order, text), by brute force."""
    docs = [(o, (t or "").encode().split()) for o, t in rows]
    first = {}
    for o, w in sorted(docs, key=lambda d: d[0]):
        for i in range(len(w) - WINDOW + 1):
            first.setdefault(tuple(w[i : i + WINDOW]), (o, i))
    out = {}
    for o, w in docs:
        stay = [True] * len(w)
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i : i + WINDOW])] != (o, i):
                stay[i : i + WINDOW] = [False] * WINDOW
        out[o] = (len(w), len(w) - sum(stay), b" ".join(x for x, s in zip(w, stay) if s).decode())
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    passage = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(6)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                p = rng.choice(passage)
                a = rng.randint(0, len(p) // 3)
                t += p[a : a + rng.randint(15, 90)]
            elif kind < 0.5:
                t += [rng.choice(words)] * rng.randint(1, 70)
            elif kind < 0.6:
                t += [words[0], words[1], words[2]] * rng.randint(1, 30)
            else:
                t += [rng.choice(words) for _ in range(rng.randint(1, 60))]
        out.append(" ".join(t))
    return out + [out[0], out[1], None, "", " \n", "é " * 25, "é\t" * 24]


def test_blocks_cover_every_window():
    docs = [b"", b"a b", b" ".join(b"%d" % (i * i) for i in range(300)), b" ", b"\n".join(b"%d" % (i * i) for i in range(50, 300)), b"x " * 20, b""]
    c = Chunk(docs)
    assert c.first.tolist() == [0, 0, 2, 302, 302, 552, 572, 572]
    covered = sorted(i for a, b in zip(c.start.tolist(), c.stop.tolist()) for i in range(a, b))
    assert covered == [*range(2, 302 - WINDOW + 1), *range(302, 552 - WINDOW + 1), 552]
    assert set(c.doc.tolist()) == {2, 4, 5}
    h, one, two = c.hashes(), c.doc == 2, c.doc == 4
    assert len(set(h[two].tolist()) & set(h[one].tolist())) >= two.sum() - 1


def test_long_texts_are_hashed_in_slices(monkeypatch):
    blob = b" ".join(b"w%d" % (i % 97) for i in range(5000)) + b"\x0b" + b"y" * 3000 + b" "
    start, want = word_hashes(blob)
    monkeypatch.setattr(passages, "CHUNK_BYTES", 1000)
    again, got = word_hashes(blob)
    assert (start == again).all() and (want == got).all() and len(np.unique(want)) == 98


@pytest.mark.parametrize("values", [passages.FILTER_VALUES, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, values, seed):
    monkeypatch.setattr(passages, "FILTER_VALUES", values)
    rows = [(i * 7 - 20, t, "clash") for i, t in enumerate(texts(seed, 120))]
    random.Random(seed).shuffle(rows)
    want = plain([r[:2] for r in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(docs, with_text=True, batches=1 + seed).collect()}
    assert got == want and sum(r[1] for r in want.values()) > 1000
    digest = {r["doc_id"]: r["kept_sha256"] for r in remove_repeats(docs).collect()}
    assert digest == {k: hashlib.sha256(v[2].encode()).hexdigest() for k, v in want.items()}


def test_batches_give_what_one_batch_gives(spark):
    all_texts = texts(9, 90)
    want = plain(list(enumerate(all_texts)))
    index, got = PassageIndex(spark, max_runs=2), {}
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(all_texts)], "key long, text string")
    for low, high in ((0, 30), (30, 50), (50, 51), (51, 200)):
        part = docs.filter(f"key >= {low} and key < {high}")
        found = index.ingest(part, docs.filter(f"key < {low}"), with_text=True)
        got |= {r["key"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()}
    assert got == want and len(index.runs) <= 2


def test_repeated_and_missing_ids(spark):
    schema = "doc_id long, text string"
    long = " ".join(f"a{i}" for i in range(40))
    rows = [(5, long), (5, long), (None, long), (None, "x"), (4, "q " + long)]
    got = remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in got) == [(4, 41, 0), (5, 40, 40), (5, 40, 40), (99, 1, 0), (99, 40, 40)]
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_hashes_are_spread():
    g = passages.gram_hashes(np.arange(10_000, dtype=np.uint64), 5)
    assert len(np.unique(g)) == len(g)


@pytest.mark.parametrize("awkward", [False, True])
def test_many_batches_and_a_compaction_against_brute_force(spark, monkeypatch, awkward):
    """Seven ranges, runs merged whenever there are more than two; once with an id that repeats, which takes the same path."""
    seen = []
    compact = PassageIndex.compact
    monkeypatch.setattr(PassageIndex, "compact", lambda self: (compact(self), seen.append(len(self.runs))))
    rows = list(enumerate(texts(11, 150)))
    want = plain(rows)
    if awkward:
        rows.append((len(rows) - 1, " ".join(f"only{i}" for i in range(30))))
        want[len(rows) - 1] = (30, 0, rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = remove_repeats(docs, with_text=True, batches=7, max_runs=2).collect()
    got = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == sorted(want.values()) and len(seen) >= 2 and set(seen) == {1}
    if not awkward:
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == want


def test_a_compacted_run_has_every_block_once_in_order(spark):
    index = PassageIndex(spark, max_runs=9)
    docs = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts(3, 60))], "key long, text string")
    for low in (0, 20, 40):
        index.add(docs.filter(f"key >= {low} and key < {low + 20}"))
    before = sorted(index.read().collect())
    assert len({r[:3] for r in before}) == len(before)
    index.compact()
    assert len(index.runs) == 1 and sorted(index.read().collect()) == before
    plan = index.read().join(index.read().select("m", "b", "d").hint("merge"), ["m", "b", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()
    assert not index.runs


def test_blocks_are_known_by_their_bytes(monkeypatch):
    """With word hashes that collide, blocks of other words still differ."""
    monkeypatch.setattr(passages, "word_hashes", lambda blob: (word_hashes(blob)[0], np.ones(len(word_hashes(blob)[0]), np.uint64)))
    c = Chunk([b" ".join(b"a%d" % i for i in range(30)), b" ".join(b"b%d" % i for i in range(30)), b"", b" ".join(b"a%d" % i for i in range(30))])
    assert len(set(c.m.tolist())) == 1 and c.hashes()[0] == c.hashes()[2] != c.hashes()[1]
