"""SimHash near-duplicates: fingerprints linked by vantage-point partitioning.

Equal fingerprints are one class first. Distinct fingerprints are partitioned by a vantage-point tree: a node's point is the one of
a bounded sample of the node's fingerprints whose distances spread most, and its branches are the shells of equal Hamming distance to
it, so a shard is a path of distances. By the triangle bound a pair within ``RADIUS`` differs by at most ``RADIUS`` at each node that
both pass, and since a flipped bit changes each distance by one, by the same parity everywhere; so each fingerprint also visits, as
a guest, only the shards inside these bounds, and of each pair of shards only one direction. Inside a shard further vantage points
prune the same way until a block is small, which is compared exactly. Each shard returns a spanning forest of its links, never all
pairs, and components are found over those. The sample only shapes the tree: every fingerprint is in it.

Defined results: a text without words (null, empty, white space) has fingerprint zero; with fewer than 4 words the whole
sequence is one shingle; a null id is never a component id unless a component has no other; rows that repeat share
all values; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, one_row_each, quoted, row_key, small_or_shuffled
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Distinct fingerprints up to which 2 vantage levels are used; each further level is for 64 times as many.
LEVEL_STEP = 2_000_000
#: Home rows, and guests, that one task of a cell takes; larger cells are split. Cells that are split, as broadcast.
HOME_ROWS, GUEST_ROWS, HOT_CELLS = 4096, 6144, 100_000
#: Pairs compared at once, and below which a block is not partitioned further.
BLOCK_PAIRS = 1 << 22


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of 4-word shingles of the text with A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(words) - SHINGLE + 1, 1 << 16):
        part = words[at : at + (1 << 16) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(part) - SHINGLE + 1)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(words) - SHINGLE + 1
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (``row_key``), doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["key", "doc_id", "fp"])

    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return source.mapInArrow(run, f"key binary, doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def vantage_points(n: int) -> list[int]:
    """``n`` fixed 64-bit points (SplitMix64)."""
    out, state = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append(z ^ (z >> 31))
    return out


#: Fingerprints that the tree is shaped by, and how many of a node's are tried as its point.
SAMPLE, TRIED = 16_384, 24
SHELLS = 65


class Tree:
    """Vantage points of the upper levels: one at the root, one for each shell of it, and from there on one for each pair of a root's shell and the last shell."""

    def __init__(self, sample: list[int], levels: int) -> None:
        self.levels, spare = levels, vantage_points(levels)
        values = np.array(sorted(sample), np.int64).view(np.uint64)
        groups, self.points = {0: values}, []
        for level in range(levels):
            size = (1, SHELLS, SHELLS * SHELLS)[min(level, 2)]
            own, below = [spare[level]] * size, {}
            for node, inside in groups.items():
                own[node] = self._chosen(inside, spare[level])
                far = np.bitwise_count(inside ^ np.uint64(own[node])).astype(np.int64)
                first = far if level == 0 else np.full(len(far), node if level == 1 else node // SHELLS)
                for key in np.unique(first * SHELLS + far if level else far).tolist():
                    at = (first * SHELLS + far if level else far) == key
                    below[key] = np.concatenate([below[key], inside[at]]) if key in below else inside[at]
            self.points.append(own)
            groups = below

    @staticmethod
    def _chosen(inside: np.ndarray, spare: int) -> int:
        """The point of up to ``TRIED`` evenly spaced ones whose distances to the others vary most; a fixed one for a node without a sample."""
        if len(inside) < 2:
            return int(inside[0]) if len(inside) else spare
        tried = inside[np.unique(np.linspace(0, len(inside) - 1, TRIED).astype(int))]
        spread = np.bitwise_count(tried[:, None] ^ inside[None, :]).astype(np.float64).std(axis=1)
        return int(tried[int(spread.argmax())])

    def distance(self, fp, shells: list):
        """Distance of a fingerprint to the point of the node that the shells so far lead to."""
        level = len(shells)
        table = [p - (1 << 64) if p >> 63 else p for p in self.points[level]]
        if level == 0:
            point = F.lit(table[0])
        else:
            node = shells[0] if level == 1 else shells[0] * SHELLS + shells[-1]
            point = F.get(F.expr(f"array({', '.join(f'{p}L' if p != -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for p in table)})"), node)
        return F.bit_count(fp.bitwiseXOR(point)).cast("int")


def visits(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of distance tuples that a pair within ``radius`` can have, of each opposite two only the greater."""
    found = [()]
    for _ in range(levels):
        found = [(*t, d) for t in found for d in range(-radius, radius + 1) if not t or (t[0] - d) % 2 == 0]
    return [t for t in found if t > tuple([0] * levels)]


class _Forest:
    """Union-find over positions, joined by blocks of pairs; keeps one pair for each union."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Each round unites along one pair for each label on either side, so a dense block costs few unions."""
        while True:
            a, b = self.label[i], self.label[j]
            differ = np.flatnonzero(a != b)
            if not len(differ):
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            chosen = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while (p := parent.get(x, x)) != x:
                    parent[x] = parent.get(p, p)
                    x = p
                return x

            for x, y, k in zip(a[chosen].tolist(), b[chosen].tolist(), chosen.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    self.links.append((int(i[k]), int(j[k])))
            root = np.arange(len(self.label))
            for x in list(parent):
                root[x] = find(x)
            self.label = root[self.label]


def _compare(values: np.ndarray, home: np.ndarray, guest: np.ndarray, same: bool, radius: int, points: list[int], forest: _Forest) -> None:
    """Join positions ``home`` x ``guest`` of ``values`` within ``radius``; ``same``: both are one set."""
    if not len(home) or not len(guest):
        return
    if len(home) * len(guest) <= BLOCK_PAIRS or not points:
        step = max(1, BLOCK_PAIRS // len(home))
        for at in range(0, len(guest), step):
            part = guest[at : at + step]
            g, h = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[home][None, :]) <= radius)
            g, h = part[g], home[h]
            keep = g != h
            forest.join(g[keep], h[keep])
        return
    dh, dg = (np.bitwise_count(values[x] ^ np.uint64(points[0])).astype(np.int64) for x in (home, guest))
    order = np.argsort(dh, kind="stable")
    home, dh = home[order], dh[order]
    for d in np.unique(dg):
        low = d if same else d - radius  # of one set, each two shells meet once
        inside = home[np.searchsorted(dh, low) : np.searchsorted(dh, d + radius, "right")]
        _compare(values, inside, guest[dg == d], False, radius, points[1:], forest)


def cell_links(cell: pd.DataFrame, radius: int, points: list[int]) -> pd.DataFrame:
    """u, v: a spanning forest of the links from a task's guests to its home rows, and among these if ``own``."""
    values = cell["fp"].to_numpy(np.int64).view(np.uint64)
    home, guest = np.flatnonzero(cell["home"].to_numpy()), np.flatnonzero(~cell["home"].to_numpy())
    forest = _Forest(len(values))
    if cell["own"].iloc[0]:
        _compare(values, home, home, True, radius, points, forest)
    _compare(values, home, guest, False, radius, points, forest)
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    signed = values.view(np.int64)
    return pd.DataFrame({"u": signed[links[:, 0]], "v": signed[links[:, 1]]})


def visiting_rows(fps: DataFrame, radius: int, tree: Tree) -> DataFrame:
    """cell, fp, home: every fingerprint in its own shard, and as a guest in those that the bounds leave."""
    steps = visits(tree.levels, radius)
    home = F.struct(F.array(*[F.lit(0)] * tree.levels).alias("step"), F.lit(True).alias("home"))
    guests = F.array(*[F.struct(F.array(*[F.lit(d) for d in t]).alias("step"), F.lit(False).alias("home")) for t in steps])
    rows = fps.select("fp", F.explode(F.concat(F.array(home), guests)).alias("t")).select("fp", "t.*")
    names = []
    for level in range(tree.levels):  # a guest's next distance is to the point of the node it visits
        rows = rows.withColumn(f"s{level}", tree.distance(F.col("fp"), [F.col(n) for n in names]) + F.get("step", F.lit(level)))
        rows = rows.filter(F.col(f"s{level}").between(0, 64))
        names.append(f"s{level}")
    cell = F.lit(0).cast("long")
    for n in names:
        cell = cell * SHELLS + F.col(n)
    return rows.select(cell.alias("cell"), "fp", "home")


def split_cells(rows: DataFrame, homes: int = HOME_ROWS, guests: int = GUEST_ROWS) -> DataFrame:
    """cell, i, j, fp, home, own: rows dealt to tasks of at most about ``homes + guests`` rows.

    A cell with more is split: home rows into parts i, guests into parts j, and each (i, j) is a task, so every home
    row meets every guest. Two home parts i < k meet in the task (i, -1 - k), and a part meets itself in (i, -1 - i).
    """
    n_home = F.count(F.when(F.col("home"), 1))
    sizes = rows.groupBy("cell").agg(n_home.alias("n_home"), (F.count(F.lit(1)) - n_home).alias("n_guest"))
    hot = sizes.filter(f"n_home > {homes} or n_guest > {guests}").select("cell", F.ceil(F.col("n_home") / homes).alias("hs"), F.ceil(F.col("n_guest") / guests).alias("gs"))
    hot = materialise(hot, "hot-cells")
    one = F.lit(1).cast("long")
    dealt = rows.join(small_or_shuffled(hot, HOT_CELLS), "cell", "left")
    dealt = dealt.withColumn("hs", F.greatest(F.coalesce("hs", one), one)).withColumn("gs", F.greatest(F.coalesce("gs", one), one))
    dealt = dealt.withColumn("h", F.pmod(F.xxhash64("fp"), F.col("hs"))).withColumn("g", F.pmod(F.xxhash64("fp"), F.col("gs")))
    zero = F.lit(0).cast("long")
    task = lambda i, j, home, own: F.struct(i.alias("i"), j.alias("j"), F.lit(home).alias("home"), own.alias("own"))
    whole = F.col("hs") == 1
    with_guests = F.transform(F.sequence(zero, F.col("gs") - 1), lambda j: task(F.col("h"), j, True, whole & (j == 0)))
    later = F.transform(F.sequence(F.col("h"), F.col("hs") - 1), lambda k: task(F.col("h"), -1 - k, True, k == F.col("h")))
    earlier = F.transform(F.filter(F.sequence(zero, F.col("h")), lambda k: k < F.col("h")), lambda k: task(k, -1 - F.col("h"), False, F.lit(False)))
    of_home = F.when(whole, with_guests).otherwise(F.concat(with_guests, later, earlier))
    of_guest = F.transform(F.sequence(zero, F.col("hs") - 1), lambda i: task(i, F.col("g"), False, whole & (F.col("g") == 0)))
    return dealt.select("cell", "fp", F.explode(F.when(F.col("home"), of_home).otherwise(of_guest)).alias("t")).select("cell", "fp", "t.*")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, levels: int | None = None, homes: int = HOME_ROWS, guests: int = GUEST_ROWS) -> DataFrame:
    """u, v over distinct fingerprints ``fp``: links whose components are those of all pairs within ``radius``."""
    if levels is None:
        n, levels = fps.count(), 2
        while n > LEVEL_STEP * 64 ** (levels - 2):
            levels += 1
    sample = fps.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(SAMPLE).collect()  # by hash, so that reruns agree
    tree, inner = Tree([r["fp"] for r in sample], levels), vantage_points(levels + 12)[levels:]
    tasks = split_cells(visiting_rows(fps, radius, tree), homes, guests)
    return tasks.groupBy("cell", "i", "j").applyInPandas(lambda pdf: cell_links(pdf, radius, inner), "u long, v long")


def _named(rows: DataFrame, radius: int) -> DataFrame:
    """fp, component_id, root for each distinct fingerprint of written ``rows``.

    A class of equal fingerprints is the node (no id, least id, fp), so a component's least node holds its id; nodes without
    any id come last.
    """
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.struct(F.col("least").isNull().alias("void"), "least", "fp").alias("node")), "classes")
    links = fingerprint_links(classes.select("fp"), radius)
    for end in ("u", "v"):
        links = links.join(classes.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    roots = materialise(components(links.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))), "roots")
    roots = roots.select(F.col("node.fp").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return named.select("fp", F.col("root.least").alias("component_id"), F.col("root.fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    named = materialise(_named(rows, radius), "components")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row of ``docs`` whose id is its component's; of rows that repeat that id (or have none in a component without ids) one stays."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    found = rows.join(materialise(_named(rows, radius), "components"), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialise(found.groupBy("root").agg(F.min("key").alias("key")).select("key"), "kept")
    return one_row_each(docs, kept, rows, id_col, text_col)
