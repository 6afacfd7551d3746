"""Image relations derived from the driver's tables, and the same derivation as SQL.

A row of ``embeddings`` is an 8 x 8 image: element i is the pixel (i div 8, i % 8). ``v`` is an 8-bit sample; r, g, b, a are
the samples 0, 16, 32 and 48 places on; names ending in 16 are 16-bit samples of a place and its successor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = {"r": 0, "g": 16, "b": 32, "a": 48}


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v, r, g, b, a, v16, r16, g16, b16, a16, idx (0-15), over (0-19)."""
    v = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256)
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("image_id"), v.alias("s"))
    at = base.select("image_id", "s", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    one = lambda k: F.get("s", (F.col("i") + k) % 64)
    two = lambda k: one(k) * 256 + one(k + 1)
    cols = [one(0).alias("v"), *(one(k).alias(c) for c, k in CHANNELS.items()), two(0).alias("v16"), *(two(k).alias(f"{c}16") for c, k in CHANNELS.items())]
    out = at.select("image_id", (F.col("i") / 8).cast("int").cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"), *cols)
    return out.withColumn("idx", F.col("v") % 16).withColumn("over", F.col("v") % 20)


_ONE = lambda k: f"s[(i + {k}) % 64 + 1]"
PIXELS_SQL = (
    "base AS (SELECT CAST(vec_id AS BIGINT) AS image_id, list_transform(embedding, lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 1000) AS BIGINT) % 256) AS s FROM embeddings), "
    "px AS (SELECT image_id, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x, "
    + ", ".join([f"{_ONE(0)} AS v", *(f"{_ONE(k)} AS {c}" for c, k in CHANNELS.items()), f"{_ONE(0)} * 256 + {_ONE(1)} AS v16", *(f"{_ONE(k)} * 256 + {_ONE(k + 1)} AS {c}16" for c, k in CHANNELS.items()), f"{_ONE(0)} % 16 AS idx", f"{_ONE(0)} % 20 AS over"])
    + " FROM base, range(64) AS t(i))"
).replace("AS over", 'AS "over"')


def palette(spark: SparkSession, entries: int = 16, clear: int = 8) -> DataFrame:
    """idx, pr, pg, pb, pa of a generated palette; the first ``clear`` entries are partly transparent."""
    i = F.col("id")
    return spark.range(entries).select(i.alias("idx"), (i * 7 % 256).alias("pr"), (i * 13 % 256).alias("pg"), (i * 29 % 256).alias("pb"), F.when(i < clear, i * 32).otherwise(255).alias("pa"))


PALETTE_SQL = "pal AS (SELECT i AS idx, i * 7 % 256 AS pr, i * 13 % 256 AS pg, i * 29 % 256 AS pb, CASE WHEN i < 8 THEN i * 32 ELSE 255 END AS pa FROM range(16) AS t(i))"
