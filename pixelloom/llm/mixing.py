"""Mixing sources to target weights by hash-threshold histograms, without a sort of documents.

Each document has a 60-bit hash of its id (of its text where the id is null). Sizes are summed by (source, top 12 bits); a running sum
over at most 4096 buckets a source finds the bucket in which the source's budget ends, only that
bucket's documents are summed again by their next 12 bits, and so on until one hash value is left.
Documents under the threshold get one copy more than the ``floor(target / source size)`` copies all get,
so the budgets for 0, 1, 2 and 3 copies are nested.

Defined results: a null text has size 0; null is a source of its own, last in order; a source of size 0
has target 0; rows that repeat an id share a hash and so the number of copies; rows without an id are hashed by their
text; an empty table gives no rows; further columns are kept or ignored, whatever their names. Reruns agree since nothing
depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, quoted, small_or_shuffled, text_or_empty, whole_row

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS, STEP_BITS = 60, 12
#: Sources up to this number are broadcast (under 10 MB); beyond it the joins shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """skey, source_size, target: the shares by weight, capped at ``max_repeat`` sizes and reshared.

    With sources in order of cap / weight the capped ones are a prefix, so running sums solve the
    resharing exactly in integers.
    """
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.max("source").alias("source"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") - 1) % len(weights) + 1).cast("long")
    ranked = by_source.withColumn("rank", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    run = ranked.withColumn("left", left).withColumn("w_left", F.sum("w").over(after))
    run = run.withColumn("capped", F.col("cap") * F.col("w_left") < F.col("w") * F.col("left"))
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("w")).alias("r"), "rank", "left", "w_left"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("free.left")).cast("double") / F.col("free.w_left").cast("double"))
    return run.withColumn("free", free).select("skey", "source_size", target.alias("target"))


def source_key(source_col: str) -> Column:
    """The source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(quoted(source_col))), F.lit("-"))


def place(id_col: str, text_col: str) -> Column:
    """The 60-bit hash by which documents of a source are taken."""
    named = F.coalesce(F.col(quoted(id_col)).cast("string"), F.concat(F.lit("-"), text_or_empty(F.col(quoted(text_col)))))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, skey, size, h of each row."""
    size = F.regexp_count(text_or_empty(F.col(quoted(text_col))), F.lit(WORD)).cast("long")
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), source_key(source_col).alias("skey"), size.alias("size"), place(id_col, text_col).alias("h"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """skey, source_size, target, copies, below: documents with h < below get one copy more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))).otherwise(F.lit(0)).cast("long")
    todo = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    todo = materialise(todo.withColumn("prefix", F.lit(0).cast("long")), "mix-targets")
    out = [todo.filter("rest <= 0").withColumn("below", F.lit(0).cast("long"))]
    todo = todo.filter("rest > 0")
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        bucket = F.shiftright("h", HASH_BITS - bits)
        inside = rows.join(small_or_shuffled(todo.select("skey", "prefix"), BROADCAST_SOURCES), "skey").filter(F.shiftright("h", HASH_BITS - bits + STEP_BITS) == F.col("prefix"))
        bins = inside.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        bins = bins.withColumn("upto", F.sum("size").over(Window.partitionBy("skey").orderBy("bucket")))
        edge = bins.join(todo, "skey").withColumn("rest", F.col("rest") - (F.col("upto") - F.col("size"))).filter("rest >= 0 and rest < size")
        edge = materialise(edge.drop("prefix").withColumnRenamed("bucket", "prefix"), "mix-edge")
        done = edge.filter("lo = hi").withColumn("below", F.col("lo") + F.when(F.col("rest") * 2 > F.col("size"), 1).otherwise(0))
        out.append(done)
        todo = edge.filter("lo < hi").select("skey", "source_size", "target", "copies", "rest", "prefix")
        if todo.isEmpty():
            break
    cols = ["skey", "source_size", "target", "copies", "below"]
    found = out[0].select(*cols)
    for x in out[1:]:
        found = found.unionByName(x.select(*cols))
    return found


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Each source's target and threshold; broadcast up to ``BROADCAST_SOURCES``."""
    return small_or_shuffled(materialise(thresholds(rows, source_targets(rows, weights, max_repeat)), "mix-plan"), BROADCAST_SOURCES)


def _times() -> Column:
    return F.col("copies") + (F.col("h") < F.col("below")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, times, taken: one row per input row."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "mix-sizes")
    joined = rows.join(mix_plan(rows, weights, max_repeat), "skey")
    return joined.select("doc_id", "size", "source_size", "target", _times().alias("times"), (F.col("size") * _times()).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to ``max_repeat`` times).

    How often follows from a row's own source and hash, so the texts stay where they are read.
    """
    rows = materialise(sized(docs, id_col, text_col, source_col), "mix-sizes")
    keyed = docs.select(whole_row(docs), source_key(source_col).alias("skey"), place(id_col, text_col).alias("h"))
    taken = keyed.join(mix_plan(rows, weights, max_repeat), "skey").select("row", _times().alias("times")).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
