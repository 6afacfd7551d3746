"""Write requests to an ordered list of steps, from the samples a client has to the samples a file holds.

The order is the canonical one of writing, so the order of requests never matters; each step undoes the reading step of its name.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .planner import Settings, Shape

REQUESTS = ("user_transform", "filler", "pack_swap", "packing", "shift", "swap_bytes", "swap_alpha", "invert_alpha", "bgr", "invert_mono")

#: When a request acts on files of a shape.
ACTS = {
    "user_transform": lambda f: True,
    "filler": lambda f: not f.has_alpha and f.depth >= 8,
    "pack_swap": lambda f: f.depth < 8,
    "packing": lambda f: f.depth < 8,
    "shift": lambda f: not f.indexed,
    "swap_bytes": lambda f: f.depth == 16,
    "swap_alpha": lambda f: f.has_alpha,
    "invert_alpha": lambda f: f.has_alpha,
    "bgr": lambda f: f.has_color and not f.indexed,
    "invert_mono": lambda f: not f.has_color and not f.indexed,
}


@dataclass(frozen=True)
class WritePlan:
    """Steps in order, the file's shape, and the shape of the rows that a client supplies."""

    steps: tuple[str, ...]
    file: Shape
    supplied: Shape
    settings: Settings

    def apply(self, px: DataFrame) -> DataFrame:
        """``px`` (image_id, y, x and the supplied samples in their order) as the file's samples c0, c1, ...: one projection."""
        live = [F.col(c).cast("long") for c in px.columns[3:]]
        if len(live) != self.supplied.channels:
            raise ValueError(f"{self.supplied.channels} samples a pixel are needed")
        x = F.col("x")
        for name in self.steps:
            x, live = self._step(name, x, live)
        return px.select("image_id", "y", x.alias("x"), *[c.alias(f"c{i}") for i, c in enumerate(live)])

    def _step(self, name: str, x, live: list) -> tuple:
        s, f = self.settings, self.file
        colors = live[:-1] if f.has_alpha else live
        alpha = live[len(colors) :]
        if name == "user_transform" and s.user:
            return x, list(s.user(dict(enumerate(live))).values())
        if name == "filler":
            return x, live[:-1] if s.filler_after else live[1:]
        if name == "pack_swap" and "packing" not in self.steps:  # samples of a byte each have no byte to change places in
            return k.pack_swap(x, 8 // f.depth), live
        if name == "packing":
            return x, [k.pack(c, f.depth) for c in live]
        if name == "shift":
            bits = s.significant
            up = [k.shift_up(c, f.depth, bits[min(i, 2)]) for i, c in enumerate(colors)]
            return x, up + [k.shift_up(c, f.depth, bits[3] if len(bits) > 3 else bits[-1]) for c in alpha]
        if name == "swap_bytes":
            return x, [k.swap_bytes(c) for c in live]
        if name == "swap_alpha":
            return x, live[1:] + live[:1]
        if name == "invert_alpha":
            return x, colors + [k.invert(c, f.depth) for c in alpha]
        if name == "bgr":
            return x, colors[::-1] + alpha
        if name == "invert_mono":
            return x, [k.invert(c, f.depth) for c in colors] + alpha
        return x, live


def plan_write(asked: set[str], file: Shape, settings: Settings = Settings()) -> WritePlan:
    """The steps for a set of write requests on files of one shape."""
    if unknown := set(asked) - set(REQUESTS):
        raise ValueError(f"unknown requests: {sorted(unknown)}")
    steps = tuple(name for name in REQUESTS if name in asked and ACTS[name](file))
    supplied = replace(file, channels=file.channels + ("filler" in steps), depth=8 if "packing" in steps else file.depth)
    return WritePlan(steps, file, supplied, settings)
