"""What the corpus operators share: tables, shared storage, broadcast checks, and rows found again by what they hold.

A row is never known by its number in a scan, since splits follow the executors alive at that moment; it is known by a
digest of its id and text (``row_key``). Rows that agree in both are interchangeable for every operator.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word contracts: space and U+0009..U+000D, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one set by ``setCheckpointDir``; a temporary one on a local master only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = by_call.get() if by_call.isDefined() else None
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "pixelloom")


_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors.

    The table stays, since the result may be read at any later time, unless a ``scratch`` scope is open.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at the end: what is made of them must be written, outside the scope, or done by then."""
    _scopes.append(paths := [])
    try:
        yield paths
    finally:
        _scopes.remove(paths)
        for path in paths:
            remove(spark, path)


def small_or_shuffled(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if a count proves it has at most ``max_rows`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_or_empty(col) -> F.Column:
    return F.coalesce(col, F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> F.Column:
    """All columns of ``docs`` as one struct ``row``: no name in it can clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")


def row_key(id_col: str, text_col: str) -> F.Column:
    """128-bit digest of a row's id and text; a null text is the empty one, a null id like no other id."""
    named = F.coalesce(F.concat(F.lit("="), F.col(quoted(id_col)).cast("string"), F.lit("\n")), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, text_or_empty(F.col(quoted(text_col)))).cast("binary")))


#: A key with more than this share of all rows is resolved map-side: at most ``1 / HOT_SHARE`` such keys exist, so they are broadcast.
HOT_SHARE = 1 / 1000


def one_row_each(docs: DataFrame, wanted: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``key`` of ``wanted``, with all its columns; ``rows`` is written and has every row's ``key``.

    Of rows that share id and text the one with the least JSON text stays.
    """
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = materialise(wanted.select("key").join(repeated, "key"), "repeated")
    keyed = docs.select(whole_row(docs), row_key(id_col, text_col).alias("key"))
    if repeated.isEmpty():
        return keyed.join(wanted.select("key"), "key", "left_semi").select("row.*")
    least = rows.count() * HOT_SHARE
    hot, few = repeated.filter(F.col("n") > least).select("key"), repeated.filter(F.col("n") <= least).select("key")
    single = keyed.join(wanted.select("key").join(repeated, "key", "left_anti"), "key", "left_semi").select("row.*")
    several = keyed.join(few, "key", "left_semi").unionByName(keyed.join(F.broadcast(hot), "key", "left_semi"))
    return single.unionByName(several.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
