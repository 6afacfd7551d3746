"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes every stage's rows to shared storage, reads them as the next one's docs, and removes what only a finished stage
needed, so that two copies of the corpus exist at most.

Defined results, of all stages: a null text is empty, and so rejected by the first; a null id is an id like no other, last in order;
rows that repeat id and text leave one row; of documents with equal texts, and of a group of near duplicates, the one with the least id
stays (of equal ids the row with the least digest of its text); a null source is a source of its own; an empty table gives no rows; further columns, whatever
their names, are kept as they are by every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm.common import materialise, remove, scratch, table
from pixelloom.llm.exact_dedup import drop_exact_copies
from pixelloom.llm.mixing import mixed_rows
from pixelloom.llm.pieces import default_model, encoding_digests
from pixelloom.llm.quality import keep_good
from pixelloom.llm.simhash import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoding_digests(docs, default_model(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("SentencePiece", encoding),
]

#: XXH64 and the piece model cannot be expressed in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            path = made.pop()
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
