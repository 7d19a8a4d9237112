"""Shared column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.session import cut

PASSES = ("dense", "exact_name", "rare_token", "addr_key", "tfidf_name", "tfidf_full", "reverse")


def latest(df: DataFrame, keys: Sequence[str], by: str = "loaded_at") -> DataFrame:
    """One row per key: the delivery loaded last."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def source_of(c: Column | str) -> Column:
    """Source number from an id's prefix, null if there is none."""
    col = F.col(c) if isinstance(c, str) else c
    return F.expr("try_cast(substring({0}, 2, 1) as tinyint)".format(c)) if isinstance(c, str) else F.substring(col, 2, 1).cast("tinyint")


def top_k(df: DataFrame, keys: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of greatest ``score`` per key, ties by ``tie``; Catalyst limits each task's share before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def cumulative(values: DataFrame, by: str, amount: str) -> DataFrame:
    """``values`` with ``upto`` (sum of ``amount`` over rows of ``by`` up to the row's own) and ``total``; ``by`` is unique.

    Sums run within ranges of ``by`` and then over the ranges, so no task sees all rows; the ranges are as many as partitions. The ranged
    table is written once: both branches read the same ranges, whatever partitions they are read in.
    """
    ranged = cut(values.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("__in", F.sum(amount).over(Window.partitionBy("__part").orderBy(by)))
    sizes = ranged.groupBy("__part").agg(F.sum(amount).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(1))).alias("total"))
    return inside.join(before, "__part").withColumn("upto", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")
