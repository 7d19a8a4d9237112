"""Queries of the general data problems over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators.skew import dense_key_counts, heavy_keys
from rowkin.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "records"), ["country", "name_core"], 0.01)


def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows of source 1 and characters of the address for every country and every name_core."""
    rec = table(spark, sf_dir, "records")
    rec = rec.select("country", "name_core", (F.col("source") == 1).cast("int").alias("n_source1"), F.length("business_address").alias("addr_chars"))
    return dense_key_counts(rec, ["country", "name_core"], ["n_source1", "addr_chars"])


QUERIES = {"p2_found": p2_found, "p2_key_stats": p2_key_stats}

_STATS = "count(*) AS n_rows, CAST(sum(CASE WHEN source = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_source1, CAST(sum(coalesce(length(business_address), 0)) AS BIGINT) AS addr_chars"
ORACLES = {
    "p2_found": """
        SELECT 'country' AS field, country AS key_value FROM records WHERE country <> '' GROUP BY country
        HAVING count(*) >= 0.01 * (SELECT count(*) FROM records)
        UNION ALL
        SELECT 'name_core', name_core FROM records WHERE name_core <> '' GROUP BY name_core
        HAVING count(*) >= 0.01 * (SELECT count(*) FROM records)""",
    "p2_key_stats": f"""
        SELECT 'country' AS field, country AS key_value, {_STATS} FROM records GROUP BY country
        UNION ALL SELECT 'name_core', name_core, {_STATS} FROM records GROUP BY name_core""",
}
