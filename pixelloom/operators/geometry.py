"""Interlacing as coordinate arithmetic and a 7-row dimension; no shuffle in either direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.codec import PASSES


def passes(spark: SparkSession) -> DataFrame:
    """pass, x0, y0, dx, dy, block_w, block_h."""
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PASSES)], "pass long, x0 long, y0 long, dx long, dy long, block_w long, block_h long")


def pass_extent(n: Column, start: Column, step: Column) -> Column:
    """Rows or columns of a pass: the ceiling of what is left over the step, 0 if nothing is."""
    return F.greatest(F.lit(0), F.floor((n - start + step - 1) / step))


def pass_sizes(headers: DataFrame) -> DataFrame:
    """Each image's passes that are present, from (image_id, width, height); the dimension has 7 rows."""
    sized = headers.crossJoin(F.broadcast(passes(headers.sparkSession)))
    sized = sized.withColumn("pass_width", pass_extent(F.col("width"), F.col("x0"), F.col("dx"))).withColumn("pass_height", pass_extent(F.col("height"), F.col("y0"), F.col("dy")))
    return sized.filter("pass_width > 0 and pass_height > 0").drop("x0", "y0", "dx", "dy", "block_w", "block_h")


def pass_of(x: Column, y: Column) -> Column:
    """The pass that a pixel is in."""
    out = F.lit(6)
    for k in range(5, -1, -1):
        x0, y0, dx, dy = PASSES[k][:4]
        out = F.when((x % dx == x0) & (y % dy == y0), k).otherwise(out)
    return out.cast("long")


def interlace(px: DataFrame) -> DataFrame:
    """``px`` with pass, pass_x, pass_y for its x, y."""
    at = px.withColumn("pass", pass_of(F.col("x"), F.col("y")))
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in PASSES]), F.col("pass").cast("int"))
    return at.withColumn("pass_x", F.floor((F.col("x") - pick(0)) / pick(2))).withColumn("pass_y", F.floor((F.col("y") - pick(1)) / pick(3)))


def deinterlace(rows: DataFrame) -> DataFrame:
    """x, y from pass, pass_x, pass_y: a broadcast of seven rows and a projection."""
    joined = rows.join(F.broadcast(passes(rows.sparkSession).drop("block_w", "block_h")), "pass")
    return joined.withColumn("x", F.col("x0") + F.col("pass_x") * F.col("dx")).withColumn("y", F.col("y0") + F.col("pass_y") * F.col("dy")).drop("x0", "y0", "dx", "dy")


def block_origin(x: Column, y: Column, upto: int) -> tuple[Column, Column]:
    """x and y of the pixel shown at (x, y) once passes up to ``upto`` are there: the newest whose block covers it.

    A pass's blocks tile the grid that its own and the earlier passes make up, so the origin is a rounding down of the position.
    """
    ox, oy = x, y
    for k in range(7):
        if k > upto:
            break
        x0, y0, dx, dy, bw, bh = PASSES[k]
        px, py = x - (x - x0) % dx, y - (y - y0) % dy  # this pass's pixel left of and above
        covers = (x >= x0) & (y >= y0) & (x - px < bw) & (y - py < bh)
        ox, oy = (px, py) if k == 0 else (F.when(covers, px).otherwise(ox), F.when(covers, py).otherwise(oy))
    return ox, oy


def block_display(rows: DataFrame, upto: int, width: int, height: int) -> DataFrame:
    """Progressive display: every pixel shows the newest pass up to ``upto`` whose block covers it.

    ``rows`` has image_id, pass, x, y, v; each shown pixel looks its origin up, inside its image.
    """
    shown = rows.filter(F.col("pass") <= upto).select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox"), "v")
    ids = rows.select("image_id").distinct()
    spots = ids.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    ox, oy = block_origin(F.col("x"), F.col("y"), upto)
    return spots.withColumn("ox", ox).withColumn("oy", oy).join(shown, ["image_id", "oy", "ox"]).select("image_id", "y", "x", "v")


def combine(before: DataFrame, new: DataFrame) -> DataFrame:
    """Rows so far (image_id, y, x, v) with the pixels that a further pass brings."""
    both = before.select("image_id", "y", "x", "v").join(new.select("image_id", "y", "x", F.col("v").alias("new")), ["image_id", "y", "x"], "full")
    return both.select("image_id", "y", "x", F.coalesce("new", "v").alias("v"))


def unused_bits(samples: Column, depth: int = 1) -> Column:
    """Mask of the low bits of a row's last byte that no sample uses; 0 where the row fills its bytes."""
    return F.pow(F.lit(2), (F.lit(8) - samples * depth % 8) % 8).cast("long") - 1
