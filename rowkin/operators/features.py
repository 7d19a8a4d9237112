"""Pair features: frequencies, ranks, competition and second-stage features, all by windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.functions.similarity import similarity
from rowkin.operators.common import PASSES


def rank0(keys: list[str], score: str, tie: str) -> Column:
    """0 for the greatest score of a key, ties by ``tie``; null scores last."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), tie)) - 1


def group_rank(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """``df`` with ``g_rank``, ``g_best`` and ``g_other``: rank in the group, its best score, and the best score of another row (null if alone)."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(score), tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first(score).over(whole), F.nth_value(score, 2).over(whole)
    return df.withColumn("g_rank", F.row_number().over(w) - 1).withColumn("g_best", best).withColumn("g_other", F.when(F.col("g_rank") == 0, second).otherwise(best))


def name_frequency(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with ``fc_name_freq_s1`` and ``fc_name_freq_cand``: records of the split with the same name_core, 1 where unknown.

    Counts are taken before any join, so a frequent name moves as one row.
    """
    freq = records.filter("name_core <> ''").groupBy("name_core").agg(F.count(F.lit(1)).alias("f"))
    own = records.select("entity_id", "name_core").join(freq, "name_core").select("entity_id", "f")
    out = pairs
    for side, col in (("s1_id", "fc_name_freq_s1"), ("cand_id", "fc_name_freq_cand")):
        out = out.join(own.select(F.col("entity_id").alias(side), F.col("f").alias(col)), side, "left").withColumn(col, F.coalesce(col, F.lit(1)))
    return out


def address_key(postcode: str = "postcode", numbers: str = "addr_numbers", norm: str = "addr_norm") -> Column:
    """postcode|first number where both are known, else the normalised address, else null."""
    number = F.coalesce(F.get(numbers, F.lit(0)), F.lit(""))
    code = F.coalesce(F.col(postcode), F.lit(""))
    return F.when((code != "") & (number != ""), F.concat_ws("|", code, number)).when(F.coalesce(F.col(norm), F.lit("")) != "", F.concat(F.lit("__anorm__"), norm))


def address_frequency(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with ``fc_addr_freq_s1`` and ``fc_addr_freq_cand``: distinct names at the record's address key, 1 where there is none."""
    keyed = records.select("entity_id", "name_core", address_key().alias("akey")).filter("akey is not null")
    freq = keyed.groupBy("akey").agg(F.countDistinct("name_core").alias("f"))
    own = keyed.join(freq, "akey").select("entity_id", "f")
    out = pairs
    for side, col in (("s1_id", "fc_addr_freq_s1"), ("cand_id", "fc_addr_freq_cand")):
        out = out.join(own.select(F.col("entity_id").alias(side), F.col("f").alias(col)), side, "left").withColumn(col, F.coalesce(col, F.lit(1)))
    return out


def candidate_counts(cands: DataFrame, dense_close: float = 0.95, text_close: float = 0.8) -> DataFrame:
    """``cands`` with ``fc_n_cands``, ``fc_n_close`` (dense score at least ``dense_close``; the text score only where the table has no dense score), ``fc_rank`` and ``fc_gap_best``."""
    w = Window.partitionBy("s1_id")
    close = F.col("bs_dense") >= dense_close if "bs_dense" in cands.columns else F.col("bs_tfidf_name") >= text_close
    return (
        cands.withColumn("fc_n_cands", F.count(F.lit(1)).over(w))
        .withColumn("fc_n_close", F.count_if(close).over(w))
        .withColumn("fc_rank", F.col("prune_rank").cast("int"))
        .withColumn("fc_gap_best", F.max("prune_score").over(w).cast("double") - F.col("prune_score").cast("double"))
    )


def reverse_ranks(cands: DataFrame, score: str = "prune_score") -> DataFrame:
    """``cands`` with ``fc_rev_rank`` and ``fc_rev_n``: the record's place among those that list the candidate, and their number."""
    return cands.withColumn("fc_rev_rank", rank0(["cand_id"], score, "s1_id")).withColumn("fc_rev_n", F.count(F.lit(1)).over(Window.partitionBy("cand_id")))


def pass_features(cands: DataFrame, passes: tuple[str, ...] = PASSES) -> DataFrame:
    """``cands`` with ``fc_n_passes``, flags as 0/1 and scores under their feature names."""
    out = cands.withColumn("fc_n_passes", sum((F.col(f"blk_{p}").cast("int") for p in passes), F.lit(0))).withColumn("fc_cand_source", F.col("cand_source").cast("int"))
    for p in passes:
        out = out.withColumn(f"fc_blk_{p}", F.col(f"blk_{p}").cast("int")).withColumn(f"fc_bs_{p}", F.col(f"bs_{p}").cast("double"))
    return out


def context_features(cands: DataFrame, records: DataFrame) -> DataFrame:
    """All ``fc_`` features of the candidate pairs as one plan."""
    out = reverse_ranks(candidate_counts(pass_features(cands)))
    out = address_frequency(name_frequency(out, records), records)
    return out.select("s1_id", "cand_id", *[c for c in out.columns if c.startswith("fc_")])


def stage2_features(preds: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, fc2_*)`` of scored pairs (s1_id, cand_id, prob); rows without a score are dropped.

    rank, gap to the best, second-best score (null for a single candidate), number above 0.5; the same from the candidate's side, mutual
    best, and the best competing score: the second of the candidate's scores for its best pair, else its best.
    """
    p = preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("p"))

    def whole(key: str, tie: str) -> tuple[Window, Window]:
        w = Window.partitionBy(key).orderBy(F.desc("p"), tie)
        return w, w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    w1, a1 = whole("s1_id", "cand_id")
    w2, a2 = whole("cand_id", "s1_id")
    out = p.withColumn("fc2_rank_p", F.row_number().over(w1) - 1).withColumn("fc2_gap_p", F.first("p").over(a1) - F.col("p")).withColumn("fc2_second_p", F.nth_value("p", 2).over(a1)).withColumn("fc2_n_above_05", F.count_if(F.col("p") > 0.5).over(a1))
    out = out.withColumn("fc2_rev_rank_p", F.row_number().over(w2) - 1).withColumn("best", F.first("p").over(a2)).withColumn("second", F.nth_value("p", 2).over(a2))
    out = out.withColumn("fc2_mutual_best", ((F.col("fc2_rank_p") == 0) & (F.col("fc2_rev_rank_p") == 0)).cast("int"))
    return out.withColumn("fc2_best_competitor_p", F.when(F.col("p") >= F.col("best"), F.col("second")).otherwise(F.col("best"))).drop("p", "best", "second")


def support(preds: DataFrame, names: DataFrame, top: int = 5) -> DataFrame:
    """``(s1_id, cand_id, fc2_support)``: for a record's candidate, the best of score(a) * token_set_ratio(name a, its name) / 100 over the
    record's candidates a of the other source; only the ``top`` of each source take part, others have 0."""
    p = preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("p"), F.expr("try_cast(substring(cand_id, 2, 1) as int)").alias("src"))
    w = Window.partitionBy("s1_id", "src").orderBy(F.desc("p"), "cand_id")
    best = p.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top).join(names.select(F.col("entity_id").alias("cand_id"), F.col("name_core").alias("name")), "cand_id", "left")
    a = best.select("s1_id", F.col("src").alias("src_a"), F.col("p").alias("p_a"), F.col("name").alias("name_a"))
    both = best.join(a, "s1_id").filter("src <> src_a").withColumn("v", F.col("p_a") * similarity("token_set", "name_a", "name") / 100.0)
    got = both.groupBy("s1_id", "cand_id").agg(F.max("v").alias("v"))
    return p.select("s1_id", "cand_id").join(got, ["s1_id", "cand_id"], "left").select("s1_id", "cand_id", F.coalesce("v", F.lit(0.0)).alias("fc2_support"))


def competition(pairs: DataFrame, keep: DataFrame | None = None, close: float = 0.02) -> DataFrame:
    """``(s1_id, cand_id, score, q_*)``: competition for each candidate over the full field of records, cut to the records ``keep`` only afterwards."""
    p = pairs.select("s1_id", "cand_id", F.col("score").cast("double").alias("score"))
    rev = Window.partitionBy("cand_id")
    out = group_rank(p, "cand_id", "score", "s1_id").withColumnRenamed("g_rank", "q_rev_rank").withColumnRenamed("g_best", "q_cand_best")
    out = out.withColumn("q_rev_n", F.count(F.lit(1)).over(rev)).withColumn("q_rev_n_close", F.count_if(F.col("score") >= F.col("q_cand_best") - close).over(rev))
    out = out.withColumn("q_gap_cand_best", F.col("q_cand_best") - F.col("score")).withColumn("q_rival_margin", F.col("score") - F.col("g_other")).drop("g_other")
    own = rank0(["s1_id"], "score", "cand_id")
    out = out.withColumn("q_mutual_best", ((own == 0) & (F.col("q_rev_rank") == 0)).cast("int"))
    return out if keep is None else out.join(keep.select("s1_id").distinct(), "s1_id", "left_semi")


def dense_block(pairs: DataFrame, close: float = 0.02) -> DataFrame:
    """``(s1_id, cand_id, q_*)``: place of a pair among its record's pairs and among those of its source; ranks begin at 1."""
    p = pairs.select("s1_id", "cand_id", F.col("score").cast("double").alias("q_dense"), F.expr("try_cast(substring(cand_id, 2, 1) as int)").alias("q_cand_source"))
    one, src = Window.partitionBy("s1_id"), Window.partitionBy("s1_id", "q_cand_source")
    best = F.max("q_dense").over(one)
    return (
        p.withColumn("q_rank", rank0(["s1_id"], "q_dense", "cand_id") + 1)
        .withColumn("q_rank_src", rank0(["s1_id", "q_cand_source"], "q_dense", "cand_id") + 1)
        .withColumn("q_gap_best", best - F.col("q_dense"))
        .withColumn("q_gap_best_src", F.max("q_dense").over(src) - F.col("q_dense"))
        .withColumn("q_n_cands", F.count(F.lit(1)).over(one))
        .withColumn("q_n_close", F.count_if(F.col("q_dense") >= best - close).over(one))
        .withColumn("q_mean_score", F.avg("q_dense").over(one))
    )


def equalities(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, q_*)`` from both records' postcode, first number and text; ``text`` has entity_id, name, addr, postcode, number."""
    cols = ["name", "addr", "postcode", "number"]
    a = text.select(F.col("entity_id").alias("s1_id"), *[F.coalesce(c, F.lit("")).alias(f"{c}_a") for c in cols])
    b = text.select(F.col("entity_id").alias("cand_id"), *[F.coalesce(c, F.lit("")).alias(f"{c}_b") for c in cols])

    def equal(c: str) -> Column:
        return F.when((F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != ""), (F.col(f"{c}_a") == F.col(f"{c}_b")).cast("int"))

    both = pairs.select("s1_id", "cand_id").join(a, "s1_id").join(b, "cand_id")
    return both.select(
        "s1_id", "cand_id", equal("postcode").alias("q_postcode"), equal("number").alias("q_number"), (F.col("addr_b") == "").cast("int").alias("q_cand_addr_empty"),
        F.col("name_b").rlike(r"[^\x00-\x7F]").cast("int").alias("q_cand_non_latin"), (F.length("name_b") / F.greatest(F.length("name_a"), F.lit(1))).alias("q_name_len_ratio"),
    )


def name_scores(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, fn_*, q_name_gap_src)``: likeness of the names by every scorer, and the gap to the best of the record's source."""
    a = text.select(F.col("entity_id").alias("s1_id"), F.coalesce("name", F.lit("")).alias("a"))
    b = text.select(F.col("entity_id").alias("cand_id"), F.coalesce("name", F.lit("")).alias("b"))
    out = pairs.select("s1_id", "cand_id").join(a, "s1_id").join(b, "cand_id")
    for scorer in ("ratio", "token_sort", "token_set", "partial", "jaro_winkler"):
        out = out.withColumn(f"fn_{scorer}", similarity(scorer, "a", "b"))
    src = Window.partitionBy("s1_id", F.substring("cand_id", 2, 1))
    return out.withColumn("q_name_gap_src", F.max("fn_token_set").over(src) - F.col("fn_token_set")).drop("a", "b")


def address_scores(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, fa_*)``: likeness of the normalised addresses, null where one is empty; ``text`` has entity_id, addr."""
    a = text.select(F.col("entity_id").alias("s1_id"), F.coalesce("addr", F.lit("")).alias("a"))
    b = text.select(F.col("entity_id").alias("cand_id"), F.coalesce("addr", F.lit("")).alias("b"))
    out = pairs.select("s1_id", "cand_id").join(a, "s1_id").join(b, "cand_id")
    both = (F.col("a") != "") & (F.col("b") != "")
    for scorer in ("token_sort", "token_set", "partial"):
        out = out.withColumn(f"fa_{scorer}", F.when(both, similarity(scorer, "a", "b")))
    common = F.size(F.array_intersect(F.split("a", " "), F.split("b", " "))) / F.size(F.array_union(F.split("a", " "), F.split("b", " ")))
    return out.withColumn("fa_words", F.when(both, common)).drop("a", "b")
