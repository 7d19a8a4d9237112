"""Queries on terms, characters, samples and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.llm.bpe_encode import encode_column
from rowkin.llm.burst_trie import marked_terms
from rowkin.llm.stable_sample import block_sample
from rowkin.llm.unicode_repair import odd_values, repair_values
from rowkin.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "records")).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p3_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_values(table(spark, sf_dir, "records"), ["split", "entity_id"], ["business_name", "business_address"])


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_values(table(spark, sf_dir, "records"), ["split", "entity_id"], ["business_name", "business_address"])


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_sample(table(spark, sf_dir, "folds"), "s1_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "text", ["doc_id"])


QUERIES = {"p3_found": p3_found, "p3_term_counts": p3_term_counts, "p4_found": p4_found, "p4_repaired": p4_repaired, "p7_sample": p7_sample, "p8_ids": p8_ids}

_TERMS = """
    WITH newest AS (
        SELECT split, entity_id, max({'loaded_at': loaded_at, 'name_core': name_core, 'addr_norm': addr_norm}) AS v FROM records GROUP BY split, entity_id),
    pieces AS (
        SELECT 'name_core' AS field, split, entity_id, unnest(string_split(v.name_core, ' ')) AS term FROM newest
        UNION ALL SELECT 'addr_norm', split, entity_id, unnest(string_split(v.addr_norm, ' ')) FROM newest),
    counted AS (
        SELECT field, term, count(*) AS occurrences, count(DISTINCT (split, entity_id)) AS records FROM pieces WHERE term <> '' GROUP BY field, term),
    marked AS (
        SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM newest) THEN 'common' END AS mark FROM counted)
"""


def _odd(k: int) -> str:
    return f"(CAST(('0x' || substr(md5('rowkin:{k}:' || block_no), 1, 7)) AS BIGINT))"


def _round(position: str, k: int) -> str:
    return f"(({position}) * (w{k} * 2 + 1) + w{k} // 4096) % 64"


_SAMPLE = f"""
    WITH ids AS (SELECT DISTINCT s1_id FROM folds WHERE s1_id IS NOT NULL),
    seqs AS (SELECT s1_id, CASE WHEN regexp_extract(s1_id, '([0-9]{{1,15}})$', 1) <> '' THEN CAST(regexp_extract(s1_id, '([0-9]{{1,15}})$', 1) AS BIGINT)
        ELSE CAST(('0x' || substr(md5(s1_id), 1, 12)) AS BIGINT) END AS seq FROM ids),
    blocks AS (SELECT s1_id, seq, seq // 64 AS block_no, seq % 64 AS position FROM seqs),
    words AS (SELECT *, {_odd(0)} AS w0, {_odd(1)} AS w1, {_odd(2)} AS w2 FROM blocks),
    r0 AS (SELECT *, {_round("position", 0)} AS a FROM words),
    r0x AS (SELECT *, xor(a, a // 8) AS b FROM r0),
    r1 AS (SELECT *, {_round("b", 1)} AS c FROM r0x),
    r1x AS (SELECT *, xor(c, c // 8) AS d FROM r1),
    r2 AS (SELECT *, {_round("d", 2)} AS e FROM r1x),
    r2x AS (SELECT *, xor(e, e // 8) AS f FROM r2)
    SELECT s1_id, seq, block_no, position FROM r2x WHERE f < 8
"""

ORACLES = {
    "p3_found": _TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_term_counts": _TERMS + "SELECT field, term, occurrences, records, mark FROM marked",
    "p7_sample": _SAMPLE,
}
