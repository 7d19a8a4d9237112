"""Queries on records: locations, spellings of names, matches across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.llm.linkage import CONFIDENT, linked_records
from rowkin.llm.locations import location_groups, same_location
from rowkin.llm.spellings import spelling_groups, spelling_pairs
from rowkin.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_location(table(spark, sf_dir, "records").filter(F.col("split") == "test"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building of each record, named by its least record, and the number of other records there."""
    return location_groups(table(spark, sf_dir, "records").filter(F.col("split") == "test"))


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_records(table(spark, sf_dir, "records").filter(F.col("split") == "test"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).filter(F.col("confidence") >= CONFIDENT).select("s1_id", "cand_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each name and the number of its other spellings."""
    groups = spelling_groups(table(spark, sf_dir, "records"), "name_core")
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("representative"))
    return groups.join(sizes, "group").select("name", "representative", (F.col("size") - 1).alias("n_links"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_pairs(table(spark, sf_dir, "records"), "name_core")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_groups": p6_groups}
ORACLES: dict[str, str] = {}
