"""Set metrics, blocking reports and error analysis.

``universe`` is one row per record of source 1 (s1_id), ``truth`` and ``pred`` are distinct pairs (s1_id, cand_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators.common import PASSES, cumulative


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of a set: 1 for two empty sets, 0 for one empty set or no hit, else 1.25 tp / (0.25 n_true + n_pred)."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def entity_scores(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``(s1_id, n_pred, n_true, tp, f05)`` of every record of the universe; a missing prediction is the empty set.

    Both pair tables are tagged and counted in one aggregation over the pair and one over the record.
    """
    tagged = pred.select("s1_id", "cand_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("s1_id", "cand_id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    pairs = tagged.groupBy("s1_id", "cand_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    per = pairs.groupBy("s1_id").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    zero = F.lit(0).cast("long")
    out = universe.select("s1_id").distinct().join(per, "s1_id", "left").select("s1_id", *[F.coalesce(c, zero).alias(c) for c in ("n_pred", "n_true", "tp")])
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """One row ``(n, macro_f05)``; 0 for an empty universe."""
    return entity_scores(pred, truth, universe).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"))


def blocking_report(cands: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """One row of the candidate set's quality: pair recall, share of records whose true pairs are all there (with none counting as covered),
    the F0.5 of a perfect choice among the candidates, and candidates per record (mean, median, 95th percentile, zeros included).
    ``ceiling_matched`` is the covered share among records with a true pair, and the percentiles ``*_found`` leave out records without candidates."""
    e = entity_scores(cands.select("s1_id", "cand_id").distinct(), truth, universe)
    oracle = f05(F.col("tp"), F.col("tp"), F.col("n_true"))
    return e.agg(
        (F.sum("tp") / F.sum("n_true")).alias("pair_recall"),
        F.avg((F.col("tp") == F.col("n_true")).cast("int")).alias("entity_ceiling"),
        F.avg(F.when(F.col("n_true") > 0, (F.col("tp") == F.col("n_true")).cast("int"))).alias("ceiling_matched"),
        F.avg(oracle).alias("oracle_f05"),
        F.avg("n_pred").alias("mean_candidates"),
        F.percentile("n_pred", F.lit(0.5)).alias("p50_candidates"),
        F.percentile("n_pred", F.lit(0.95)).alias("p95_candidates"),
        F.percentile(F.when(F.col("n_pred") > 0, F.col("n_pred")), F.lit(0.5)).alias("p50_found"),
        F.percentile(F.when(F.col("n_pred") > 0, F.col("n_pred")), F.lit(0.95)).alias("p95_found"),
    )


def labelled(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """``cands`` with ``is_true``."""
    return cands.join(truth.select("s1_id", "cand_id", F.lit(True).alias("is_true")), ["s1_id", "cand_id"], "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))


def pass_report(cands: DataFrame, truth: DataFrame, passes: tuple[str, ...] = PASSES) -> DataFrame:
    """``(pass, n_pairs, n_true, recall, marginal_recall)``: of each pass the recall it reaches and the recall lost without it."""
    n_true = truth.count()
    n_found = sum((F.col(f"blk_{p}").cast("int") for p in passes), F.lit(0))
    rows = labelled(cands, truth).withColumn("__f", n_found)
    long = rows.select("is_true", "__f", F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"blk_{p}").alias("hit")) for p in passes])).alias("x")).filter("x.hit")
    return long.groupBy(F.col("x.pass").alias("pass")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("is_true").alias("n_true"), (F.count_if("is_true") / F.lit(n_true)).alias("recall"), (F.count_if(F.col("is_true") & (F.col("__f") == 1)) / F.lit(n_true)).alias("marginal_recall")
    )


def group_report(cands: DataFrame, truth: DataFrame, universe: DataFrame, by: str) -> DataFrame:
    """Pair recall and mean candidates per value of a column of ``universe``, with the total in a row of its own (level 0 = value, 1 = total)."""
    e = entity_scores(cands.select("s1_id", "cand_id").distinct(), truth, universe).join(universe.select("s1_id", by).distinct(), "s1_id")
    return e.rollup(by).agg(
        F.grouping(by).cast("int").alias("level"), F.count(F.lit(1)).alias("n_s1"), F.sum("n_true").alias("n_true"), (F.sum("tp") / F.sum("n_true")).alias("recall"), F.avg("n_pred").alias("mean_candidates")
    )


def top_n_report(cands: DataFrame, truth: DataFrame, sizes: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """``(top_n, n_pairs, recall)`` after keeping ranks below each size; a pair is counted once per size it survives, all sizes in one pass."""
    n_true = truth.count()
    rows = labelled(cands, truth)
    kept = rows.select("is_true", F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n > F.col("prune_rank"))).alias("top_n"))
    return kept.groupBy("top_n").agg(F.count(F.lit(1)).alias("n_pairs"), (F.count_if("is_true") / F.lit(n_true)).alias("recall"))


def misses(cands: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """True pairs outside the candidates with a reason: cross_country, empty_fields, address_only_match, name_very_different or other."""
    lost = truth.join(cands.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    side = records.select("entity_id", F.coalesce("country", F.lit("")).alias("country"), F.coalesce("name_core", F.lit("")).alias("name"), F.coalesce("postcode", F.lit("")).alias("postcode"))
    a = side.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{c}_a") for c in ("country", "name", "postcode")])
    b = side.select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"{c}_b") for c in ("country", "name", "postcode")])
    both = lost.join(a, "s1_id").join(b, "cand_id")
    longest = F.greatest(F.length("name_a"), F.length("name_b"))
    both = both.withColumn("ned", F.when(longest == 0, 0.0).otherwise(F.levenshtein("name_a", "name_b") / longest))
    reason = (
        F.when(F.col("country_a") != F.col("country_b"), "cross_country")
        .when((F.col("name_a") == "") | (F.col("name_b") == ""), "empty_fields")
        .when((F.col("ned") > 0.6) & (F.col("postcode_a") != "") & (F.col("postcode_a") == F.col("postcode_b")), "address_only_match")
        .when(F.col("ned") > 0.6, "name_very_different")
        .otherwise("other")
    )
    return both.select("s1_id", "cand_id", "ned", reason.alias("reason"))


def shift_report(cands: DataFrame, universe: DataFrame, countries: tuple[str, ...], low: float = 0.3) -> DataFrame:
    """Per listed country (and ``other``): records, candidates per record and the best text score, with a flag for weak candidates."""
    best = cands.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.max("bs_tfidf_name").cast("double").alias("best"))
    who = universe.select("s1_id", F.when(F.col("country").isin(*countries), F.col("country")).otherwise("other").alias("land")).join(best, "s1_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = who.groupBy("land").agg(
        F.count(F.lit(1)).alias("n_s1"), F.avg("n").alias("mean_candidates"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.95)).alias("p95"),
        F.avg("best").alias("mean_best"), F.percentile("best", F.lit(0.25)).alias("p25_best"), F.percentile("best", F.lit(0.5)).alias("p50_best"), F.percentile("best", F.lit(0.75)).alias("p75_best"), F.avg(F.when(F.col("best").isNotNull(), (F.col("best") < low).cast("int"))).alias("share_low"),
    )
    return out.withColumn("weak", F.coalesce((F.col("mean_best") < 0.5) | (F.col("share_low") > 0.2), F.lit(False)))


def evaluate(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``(kind, value, n, macro_f05, empty_rate)`` overall, per fold, per country and per number of true matches (0, 1, 2, 3+): one expansion of the per-record table."""
    e = entity_scores(pred, truth, universe).join(universe.select("s1_id", "fold", "country"), "s1_id")
    bucket = F.when(F.col("n_true") >= 3, "3+").otherwise(F.col("n_true").cast("string"))
    kinds = {"overall": F.lit("all"), "fold": F.col("fold").cast("string"), "country": F.coalesce("country", F.lit("")), "n_true": bucket}
    long = e.select("n_pred", "f05", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("g"))
    return long.groupBy(F.col("g.kind").alias("kind"), F.col("g.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05"), F.avg((F.col("n_pred") == 0).cast("int")).alias("empty_rate"))


def evaluate_sources(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``(source, macro_f05)`` with both pair tables cut to one source of candidates."""
    out = None
    for s in (2, 3):
        keep = F.substring("cand_id", 2, 1) == str(s)
        part = macro_f05(pred.filter(keep), truth.filter(keep), universe).select(F.lit(s).alias("source"), "macro_f05")
        out = part if out is None else out.unionByName(part)
    return out


def singleton_accuracy(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: records without and with a true match, and the shares left empty."""
    e = entity_scores(pred, truth, universe)
    none, some = F.col("n_true") == 0, F.col("n_true") > 0
    empty = (F.col("n_pred") == 0).cast("int")
    return e.agg(F.count_if(none).alias("n_singletons"), F.avg(F.when(none, empty)).alias("singleton_accuracy"), F.count_if(some).alias("n_matched"), F.avg(F.when(some, empty)).alias("matched_left_empty"))


def evaluate_loco(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``(loco_fold, n, macro_f05)`` per held-out country."""
    e = entity_scores(pred, truth, universe).join(universe.select("s1_id", "loco_fold"), "s1_id")
    return e.groupBy("loco_fold").agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05"))


def loss_breakdown(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``(reason, n, points_lost)`` of records below 1: singletons matched, others left empty, partial sets."""
    e = entity_scores(pred, truth, universe).filter("f05 < 1")
    reason = F.when(F.col("n_true") == 0, "singleton_matched").when(F.col("n_pred") == 0, "left_empty").otherwise("partial_set")
    return e.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("f05")).alias("points_lost"))


def false_positives(selected: DataFrame, preds: DataFrame, truth: DataFrame, records: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` chosen pairs of greatest score that are not true, with both records and the pair's place within its record (equal scores share a place)."""
    place = F.rank().over(Window.partitionBy("s1_id").orderBy(F.desc_nulls_last("prob")))
    scored = preds.withColumn("rank_within_s1", place).join(selected.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
    wrong = scored.join(truth, ["s1_id", "cand_id"], "left_anti").orderBy(F.desc("prob"), "s1_id", "cand_id").limit(limit)
    return enrich(wrong.select("s1_id", "cand_id", "prob", "rank_within_s1"), records)


def false_negatives(selected: DataFrame, preds: DataFrame, truth: DataFrame, records: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` true pairs not chosen: those without a score first, then the lowest scores, with both records."""
    lost = truth.join(selected.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").join(preds.select("s1_id", "cand_id", "prob"), ["s1_id", "cand_id"], "left")
    return enrich(lost.orderBy(F.asc_nulls_first("prob"), "s1_id", "cand_id").limit(limit), records)


def enrich(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` with business_name and business_address of both records."""
    side = records.select("entity_id", "business_name", "business_address")
    a = side.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("name_s1"), F.col("business_address").alias("addr_s1"))
    b = side.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("name_cand"), F.col("business_address").alias("addr_cand"))
    return pairs.join(a, "s1_id", "left").join(b, "cand_id", "left")


def roc_auc(scored: DataFrame, score: str = "prob", label: str = "y") -> DataFrame:
    """One row ``(auc, brier, n)``: AUC by rank sums over distinct scores, and the mean squared error; null scores are left out."""
    rows = scored.filter(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    by = rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"), F.sum((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("e"))
    below = F.col("upto") - F.col("q")
    return cumulative(by, "s", "q").withColumn("below", below).agg(
        (F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"), (F.sum("e") / F.sum(F.col("p") + F.col("q"))).alias("brier"), F.sum(F.col("p") + F.col("q")).alias("n")
    )


def pair_recall(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """``(source, n_true, recall)`` of true pairs among candidates, per source of the candidate and overall (source 0)."""
    hit = truth.join(cands.select("s1_id", "cand_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "cand_id"], "left").withColumn("source", F.substring("cand_id", 2, 1).cast("int"))
    return hit.rollup("source").agg(F.count(F.lit(1)).alias("n_true"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).select(F.coalesce("source", F.lit(0)).alias("source"), "n_true", "recall")
