import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from pixelloom.llm.components import components
from pixelloom.llm.simhash import Tree, fingerprint, fingerprint_links, keep_one_of_each, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", None, " \n", "one", "A b C", "a b c d", "É a\x0bb c d e", "x " * 70000])
def test_fingerprint(text):
    if len(text or "") < 1000:
        assert fingerprint(text) == plain_fingerprint(text)
    assert 0 <= fingerprint(text) < 1 << 64


@pytest.mark.parametrize("levels, most", [(1, 8192), (2, 8192), (3, 8192), (1, 5), (2, 3)])
def test_links_have_the_components_of_all_pairs(spark, levels, most):
    rng = random.Random(levels)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randint(0, 12)):  # chains: each some bits from the last
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), levels=levels, homes=most, guests=most + 1)
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in links.collect())
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert [roots.get(x, x) for x in signed] == plain_components(signed, fps)


def test_query_against_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "x"
            texts.append(" ".join(w))
    texts += [None, "", " ", "a", "a", "A", "b c", texts[0], texts[0].upper()]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components([r[0] for r in rows], fps)
    assert [got[r[0]]["component_id"] for r in rows] == want
    assert [got[r[0]]["fingerprint"] for r in rows] == [f"{x:016x}" for x in fps]


def test_dense_group_gives_a_forest(spark):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(1 << 62))
    fps = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (3000, 2))})
    links = fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), homes=700, guests=500)
    assert len({r["root"] for r in components(links).collect()}) == 1
    assert links.count() <= 100 * len(fps)


def test_edges_of_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", None), (None, "q r s t", None), (2, None, None), (3, "", "y")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 2)], key=str)
    kept = keep_one_of_each(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["text"] or "" for r in kept)) == ["", "a b c d e", "q r s t"] and kept[0].asDict().keys() == {"doc_id", "text", "lang"}


def test_a_bit_that_half_of_the_shingles_set_is_not_set():
    """Two shingles: bits on which they differ are set in exactly half of them."""
    one, two = (xxh64_intdigest(g, 42) for g in (b"a b c d", b"b c d e"))
    assert fingerprint("a b c d e") == one & two == plain_fingerprint("a b c d e")


def test_a_tree_has_points_of_its_data_and_every_row_in_it():
    rng = random.Random(3)
    sample = [rng.getrandbits(64) - (1 << 63) for _ in range(500)]
    tree = Tree(sample, 3)
    assert [len(p) for p in tree.points] == [1, 65, 65 * 65] and tree.points[0][0] in {x & (1 << 64) - 1 for x in sample}
    assert Tree([], 2).points[0] == [Tree([], 2).points[0][0]]
    assert Tree(sample[::-1], 3).points == tree.points
