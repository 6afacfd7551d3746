"""Palette operators: look-ups, overruns, frequencies, and colour reduction."""

from __future__ import annotations

from heapq import heapify, heappop
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import color_cell

#: A palette has at most 256 entries, so it is broadcast.
ENTRIES = 256


def expand(px: DataFrame, palette: DataFrame, index: str, by_image: bool = False) -> DataFrame:
    """``px`` with pr, pg, pb, pa of its index; an index beyond the palette is opaque black.

    One palette is broadcast; with a palette for each image (``by_image``) it is a shuffled equi-join.
    """
    entries = palette.withColumnRenamed("idx", index)
    joined = px.join(entries, ["image_id", index], "left") if by_image else px.join(F.broadcast(entries), index, "left")
    for c, v in (("pr", 0), ("pg", 0), ("pb", 0), ("pa", 255)):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(v).cast("long")))
    return joined


def overruns(px: DataFrame, palette: DataFrame, index: str) -> DataFrame:
    """Pixels whose index has no entry."""
    return px.join(F.broadcast(palette.select(F.col("idx").alias(index))), index, "left_anti")


def histogram(px: DataFrame, index: str) -> DataFrame:
    return px.groupBy("image_id", index).agg(F.count(F.lit(1)).alias("freq"))


def nearest_entries(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """cell, idx: the entry nearest to each cell of the 5-bit cube (greatest plus summed difference; lowest index on ties).

    ``cells`` are at most 32768 and entries at most 256: both bounded, so the comparison of all with all is too.
    """
    part = lambda k: F.shiftright("cell", k).bitwiseAND(F.lit(31))
    d = [F.abs(part(k) - F.shiftright(c, 3)) for k, c in ((10, "pr"), (5, "pg"), (0, "pb"))]
    distance = F.greatest(*d) + d[0] + d[1] + d[2]
    pairs = cells.crossJoin(F.broadcast(palette))
    return pairs.groupBy("cell").agg(F.min_by("idx", F.struct(distance, "idx")).alias("idx"))


def quantize(px: DataFrame, palette: DataFrame) -> DataFrame:
    """``px`` (r, g, b) with qidx, the palette entry of its colour's cell; only cells in use are compared."""
    at = px.withColumn("cell", color_cell(F.col("r"), F.col("g"), F.col("b")))
    lookup = nearest_entries(at.select("cell").distinct(), palette)
    return at.join(F.broadcast(lookup.withColumnRenamed("idx", "qidx")), "cell")


def distance(a, b) -> int:
    return sum(abs(x - y) for x, y in zip(a, b))


def _sunk(order: list[int], weight: list[int]) -> list[int]:
    """``order`` after one pass that carries the rarest entry met so far towards the end."""
    out, carried = [], order[0]
    for entry in order[1:]:
        if weight[carried] < weight[entry]:
            out.append(entry)
        else:
            out.append(carried)
            carried = entry
    return [*out, carried]


def reduce_by_frequency(colors: list, frequency: list[int], most: int) -> tuple[list, list[int]]:
    """Palette with the kept colours in front, and where each old index goes.

    One pass for each entry to drop settles the tail of a ranking, no more. Where a ranking's front place holds an entry from beyond
    ``most``, the colours *at that place* and at the last back place that holds one from the front are exchanged. Dropped colours go to
    the nearest kept one, the lowest on ties.
    """
    n = len(colors)
    if n <= most:
        return list(colors), list(range(n))
    order = list(range(n))
    for end in range(n, most, -1):
        order[:end] = _sunk(order[:end], frequency)
    front = [place for place in range(most) if order[place] >= most]
    back = [place for place in reversed(range(most, n)) if order[place] < most]
    partner = dict(zip(front, back)) | dict(zip(back, front))
    kept = [colors[partner.get(slot, slot)] for slot in range(most)]
    nearest = lambda c: min(range(most), key=lambda slot: (distance(c, kept[slot]), slot))
    return kept, [slot if (slot := partner.get(e, e)) < most else nearest(colors[e]) for e in range(n)]


class _Survivors:
    """Entries that stand for themselves, each in a slot; a merged entry names its heir."""

    def __init__(self, n: int) -> None:
        self.heir, self.slots = list(range(n)), list(range(n))

    def alive(self, entry: int) -> bool:
        return self.heir[entry] == entry

    def merge(self, gone: int, heir: int) -> None:
        """The entry of the last slot moves to the one that falls free."""
        self.heir[gone] = heir
        free, last = self.slots.index(gone), self.slots.pop()
        if last != gone:
            self.slots[free] = last

    def slot_of_all(self) -> list[int]:
        at, out = {entry: slot for slot, entry in enumerate(self.slots)}, []
        for entry in range(len(self.heir)):
            while not self.alive(entry):
                entry = self.heir[entry]
            out.append(at[entry])
        return out


#: Pairs are taken up to a distance that grows by this much from round to round, to the greatest that three channels allow.
RADIUS_STEP, FARTHEST = 96, 765


def reduce_by_distance(colors: list, most: int) -> tuple[list, list[int]]:
    """Merge nearest pairs until ``most`` colours are left.

    A round looks at the slots as they are when it begins: pairs within the radius by distance, of equal ones the last first. Of a pair of
    survivors the earlier goes if their number is odd, else the later.
    """
    left, radius = _Survivors(len(colors)), 0
    while len(left.slots) > most and radius < FARTHEST:
        radius += RADIUS_STEP
        ranked = ((distance(colors[a], colors[b]), -rank, a, b) for rank, (a, b) in enumerate(combinations(left.slots, 2)))
        near = [pair for pair in ranked if pair[0] <= radius]
        heapify(near)
        while near and len(left.slots) > most:
            _, _, a, b = heappop(near)
            if left.alive(a) and left.alive(b):
                left.merge(*((a, b) if len(left.slots) % 2 else (b, a)))
    return [colors[e] for e in left.slots], left.slot_of_all()


def reduce_palettes(palettes: DataFrame, most: int, by_frequency: bool) -> DataFrame:
    """image_id, idx, new_idx, pr, pg, pb: each image's reduction map and the colour it maps to.

    ``palettes`` (image_id, idx, pr, pg, pb, freq). The merge is sequential over at most 256 entries of one image, so a
    grouped map over images is the whole work.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        colors = list(frame[["pr", "pg", "pb"]].itertuples(index=False, name=None))
        kept, moved = reduce_by_frequency(colors, frame["freq"].tolist(), most) if by_frequency else reduce_by_distance(colors, most)
        return pd.DataFrame([(frame["image_id"].iloc[0], i, m, *kept[m]) for i, m in enumerate(moved)], columns=["image_id", "idx", "new_idx", "pr", "pg", "pb"])

    return palettes.groupBy("image_id").applyInPandas(run, "image_id long, idx long, new_idx long, pr long, pg long, pb long")
