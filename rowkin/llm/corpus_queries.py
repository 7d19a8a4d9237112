"""Queries on documents: leaked evaluation items and abusive content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowkin.llm.abuse import abuse_scores, abusive_documents, source_rates
from rowkin.llm.leakage import leaked_items
from rowkin.session import table


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).filter("kind = 'wording'").select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abusive_documents(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_scores(table(spark, sf_dir, "documents"), ["doc_id", "source"])


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rates(table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_scores": p10_scores, "p10_source_rates": p10_source_rates}
ORACLES: dict[str, str] = {}
