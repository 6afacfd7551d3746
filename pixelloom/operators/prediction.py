"""Scanline prediction: encoding by windows, cost, and the choice of a filter for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = ("none", "sub", "up", "average", "paeth")


def neighbours(rows: DataFrame, stride: int = 1) -> DataFrame:
    """``rows`` (image_id, pass, row, byte, v) with left, above and corner bytes, zero outside the pass.

    Two windows over one partitioning by image and pass, so one shuffle.
    """
    across = Window.partitionBy("image_id", "pass", "row").orderBy("byte")
    down = Window.partitionBy("image_id", "pass", "byte").orderBy("row")
    placed = rows.repartition("image_id")
    with_left = placed.withColumn("left", F.lag("v", stride, 0).over(across))
    return with_left.withColumn("above", F.lag("v", 1, 0).over(down)).withColumn("corner", F.lag("left", 1, 0).over(down))


def paeth(a: Column, b: Column, c: Column) -> Column:
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def predicted(kind: int) -> Column:
    a, b, c = F.col("left"), F.col("above"), F.col("corner")
    return [F.lit(0), a, b, F.shiftright(a + b, 1), paeth(a, b, c)][kind]


def encoded(kind: int) -> Column:
    """The filtered byte of a row with ``neighbours``."""
    return F.pmod(F.col("v") - predicted(kind), F.lit(256))


def costs(rows: DataFrame, stride: int = 1) -> DataFrame:
    """image_id, pass, row, filter, cost: the sum of each filter's bytes taken as signed magnitudes."""
    near = neighbours(rows, stride)
    sums = [F.sum(F.least(encoded(k), F.lit(256) - encoded(k))).alias(f"c{k}") for k in range(5)]
    wide = near.groupBy("image_id", "pass", "row").agg(*sums)
    return wide.select("image_id", "pass", "row", F.posexplode(F.array(*[f"c{k}" for k in range(5)])).alias("filter", "cost")).withColumn("filter", F.col("filter").cast("long"))


def chosen(rows: DataFrame, stride: int = 1) -> DataFrame:
    """image_id, pass, row, filter, cost: the cheapest filter, the lowest on ties."""
    best = F.min(F.struct("cost", "filter"))
    return costs(rows, stride).groupBy("image_id", "pass", "row").agg(best.alias("m")).select("image_id", "pass", "row", "m.filter", "m.cost")


def undo_sub(rows: DataFrame) -> DataFrame:
    """Left-predicted bytes of one-byte pixels back to samples: a running sum modulo 256."""
    w = Window.partitionBy("image_id", "pass", "row").orderBy("byte").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("v", F.sum("v").over(w) % 256)


def undo_up(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("image_id", "pass", "byte").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("v", F.sum("v").over(w) % 256)
