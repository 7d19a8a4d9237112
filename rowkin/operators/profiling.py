"""Profiles of record tables and of true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkin.functions.text import dominant_script, noise_flags, non_latin_scripts, word_tokens
from rowkin.operators.common import cumulative

LEVELS = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def profile(records: DataFrame) -> DataFrame:
    """One row per split and source: rows, empty fields, length percentiles, tokens per name and counts of every noise flag (and of names with any), in one aggregation."""
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    rows = records.select("split", "source", name.alias("name"), addr.alias("addr"))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim("name") == "").alias("empty_name"), F.count_if(F.trim("addr") == "").alias("empty_addr"), F.avg(F.size(F.split(F.trim("name"), r"\s+"))).alias("mean_tokens"), F.max(F.length("name")).alias("max_len")]
    aggs += [F.percentile(F.length("name"), F.lit(q)).alias(f"len_p{int(100 * q):02d}") for q in LEVELS]
    flags = noise_flags("name")
    aggs += [F.count_if(c).alias(f"n_{k}") for k, c in flags.items()]
    any_flag = None
    for c in flags.values():
        any_flag = c if any_flag is None else any_flag | c
    aggs.append(F.count_if(any_flag).alias("n_any"))
    return rows.groupBy("split", "source").agg(*aggs)


def country_counts(records: DataFrame) -> DataFrame:
    """Rows per split, source and country with totals of each level (``level`` 0 country, 1 source, 3 split, 7 all)."""
    return records.rollup("split", "source", "country").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_rows"))


def first_tokens(records: DataFrame, top: int = 30) -> DataFrame:
    """``(source, token, n, place)``: the most frequent first words of each source, counted over all rows."""
    token = F.lower(F.regexp_extract("business_name", r"(\S+)", 1))
    counts = records.select("source", token.alias("token")).filter("token <> ''").groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))).filter(F.col("place") <= top)


def token_frequencies(records: DataFrame, country: str, top: int = 50, column: str = "business_name") -> DataFrame:
    """``(token, n)``: the most frequent words of a country's names or addresses."""
    tokens = records.filter(F.col("country") == country).select(F.explode(word_tokens(column)).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(top)


def script_counts(records: DataFrame, column: str = "business_name") -> DataFrame:
    """``(country, script, n)`` of the dominant script."""
    return records.groupBy("country", dominant_script(column).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def script_sets(records: DataFrame, column: str = "business_name", top: int = 8) -> DataFrame:
    """``(scripts, n)``: the most frequent sets of scripts other than Latin."""
    sets = records.select(F.array_join(non_latin_scripts(column), "+").alias("scripts")).filter("scripts <> ''")
    return sets.groupBy("scripts").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "scripts").limit(top)


def exclusivity(truth: DataFrame) -> DataFrame:
    """Per source of the candidates: distinct candidates, those claimed by two or three and more records, greatest fan-in."""
    per = truth.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("n")).withColumn("source", F.substring("cand_id", 2, 1).cast("int"))
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("n_cands"), F.count_if(F.col("n") >= 2).alias("claimed_2"), F.count_if(F.col("n") >= 3).alias("claimed_3"), F.max("n").alias("max_fan_in"))


def country_crosstab(truth: DataFrame, records: DataFrame) -> DataFrame:
    """``(country_s1, country_cand, n, same_folded)`` over true pairs; countries are joined by key, never by position."""
    c = records.select("entity_id", "country")
    a, b = c.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("country_s1")), c.select(F.col("entity_id").alias("cand_id"), F.col("country").alias("country_cand"))
    both = truth.join(a, "s1_id").join(b, "cand_id")
    same = F.coalesce(F.lower(F.trim("country_s1")) == F.lower(F.trim("country_cand")), F.lit(False))
    return both.groupBy("country_s1", "country_cand", same.alias("same_folded")).agg(F.count(F.lit(1)).alias("n"))


def match_histogram(truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``(country, bucket, n)`` with the number of matches capped at 5, and totals over countries (level 1)."""
    per = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("k"))
    rows = universe.select("s1_id", "country").join(per, "s1_id", "left").select("country", F.least(F.coalesce("k", F.lit(0)), F.lit(5)).cast("int").alias("bucket"))
    return rows.groupingSets([["country", "bucket"], ["bucket"]], "country", "bucket").agg(F.grouping("country").cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def repeated_sources(truth: DataFrame, universe: DataFrame, cap: int = 4) -> DataFrame:
    """``(n2, n3, n)``: records by their capped numbers of matches in sources 2 and 3."""
    per = truth.groupBy("s1_id").agg(F.count_if(F.substring("cand_id", 2, 1) == "2").alias("n2"), F.count_if(F.substring("cand_id", 2, 1) == "3").alias("n3"))
    rows = universe.select("s1_id").join(per, "s1_id", "left").select(*[F.least(F.coalesce(c, F.lit(0)), F.lit(cap)).cast("int").alias(c) for c in ("n2", "n3")])
    return rows.groupBy("n2", "n3").agg(F.count(F.lit(1)).alias("n"))


def distractors(records: DataFrame, truth: DataFrame) -> DataFrame:
    """``(source, country, level, n_rows, n_distractors)``: pool records, and those that no true pair names, with totals per source."""
    pool = records.filter("source in (2, 3)").select("entity_id", "source", "country")
    named = truth.select(F.col("cand_id").alias("entity_id"), F.lit(1).alias("named")).distinct()
    rows = pool.join(named, "entity_id", "left")
    return rows.groupingSets([["source", "country"], ["source"]], "source", "country").agg(F.grouping("country").cast("int").alias("level"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("named").isNull()).alias("n_distractors"))


def id_spearman(truth: DataFrame) -> DataFrame:
    """One row ``(n, spearman)``: rank correlation of the ids' numbers over true pairs; ranks are averages of ties."""
    ids = truth.select(F.expr("try_cast(substring(s1_id, 4) as bigint)").alias("a"), F.expr("try_cast(substring(cand_id, 4) as bigint)").alias("b")).dropna()

    def ranks(c: str) -> DataFrame:
        v = cumulative(ids.groupBy(c).agg(F.count(F.lit(1)).alias("k")), c, "k")
        return v.select(c, (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{c}"))

    return ids.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))
