"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extract, train

    return extract(table(spark, sf_dir, "pages"), train())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import default_model, encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), default_model())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests, train

    return secret_digests(table(spark, sf_dir, "documents"), train())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_language_id, op4_sentencepiece, op5_mixing, op6_secret_scan, op7_substring_dedup, op8_simhash, op9_url_filter, op10_exact_dedup)}

ORACLE_SQL = {
    "op2_quality_rules": sql.QUALITY,
    "op5_mixing": sql.MIXING,
    "op9_url_filter": sql.URLS,
    "op10_exact_dedup": sql.EXACT_DEDUP,
}
