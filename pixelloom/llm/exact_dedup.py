"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Misra-Gries (``freqItems``) names at most ``1 / support`` digest keys that may be frequent. Their
groups are counted exactly (map-side combined, so a hot group costs one row a task); the verified
winners, at most ``1 / support`` rows, are broadcast and resolve their copies without a shuffle.
Every other digest takes an ordinary shuffle, where no group exceeds a ``support`` share of the rows.

Defined results: a null text is the empty text; a null id sorts after all others; rows that repeat an
id with an equal text count in ``group_size`` and exactly one of them is kept; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, one_row_each, quoted, row_key, text_or_empty

SUPPORT = 1 / 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per row: rid (tells equal rows apart), doc_id, text_sha256 of the text with white-space runs made one space, and ``row_key`` if ``keyed``."""
    norm = F.regexp_replace(text_or_empty(F.col(quoted(text_col))), f"{SPACE}+", " ")
    key = [row_key(id_col, text_col).alias("key")] if keyed else []
    return docs.select(*key, F.monotonically_increasing_id().alias("rid"), F.col(quoted(id_col)).alias("doc_id"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"))


def _groups(rows: DataFrame) -> DataFrame:
    ties = [c for c in ("key", "rid") if c in rows.columns]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", *ties)).alias("first")
    return rows.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    return _resolved(materialise(digests(docs, id_col, text_col), "digests"), support)


def _resolved(rows: DataFrame, support: float) -> DataFrame:
    """``exact_dedup``'s columns (and ``key`` if there) from written digests; row numbers are compared in that table alone."""
    keyed = rows.select(F.xxhash64("text_sha256").alias("key"))
    maybe = keyed.stat.freqItems(["key"], support).first()[0] or []
    winners = _groups(rows.filter(F.xxhash64("text_sha256").isin([int(k) for k in maybe]))) if maybe else _groups(rows.limit(0))
    winners = winners.filter(F.col("group_size") > 1)
    if winners.count() <= len(maybe):  # at most 1 / support rows: a 64-bit key stands for one digest
        winners = F.broadcast(winners)
    rest = rows.join(winners.select("text_sha256"), "text_sha256", "left_anti")
    resolved = rows.join(winners, "text_sha256").unionByName(rest.join(_groups(rest), "text_sha256"))
    kept = (F.col("rid") == F.col("first.rid")).alias("kept")
    return resolved.select(*[c for c in ["key"] if c in rows.columns], "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept, "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; its columns are kept, whatever their names."""
    rows = materialise(digests(docs, id_col, text_col, keyed=True), "digests")
    kept = materialise(_resolved(rows, support).filter("kept").select("key"), "kept")
    return one_row_each(docs, kept, rows, id_col, text_col)
