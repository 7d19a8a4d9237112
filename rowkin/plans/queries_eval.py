"""Queries of metrics, reports, selection, learning and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import blocking as bl
from rowkin.operators import learning as ln
from rowkin.operators import metrics as mt
from rowkin.operators import profiling as pf
from rowkin.operators import selection as sl
from rowkin.operators.common import PASSES
from rowkin.plans.queries_pairs import rounded
from rowkin.plans.queries_scan import NAME_SQL, PLAIN, SCRIPT_OF
from rowkin.plans.queries_scan import S as SCAN_SQL
from rowkin.plans.tables import Tables, with_
from rowkin.session import cut

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        name = fn.__name__
        Q[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            S[name] = sql
        return fn

    return add


def chosen(t):
    """Pairs chosen at 0.5 after exclusivity."""
    return sl.select_threshold(t.preds, 0.5)


_SEL = ("pr", "excl", "sel", "uni", "truth", "pset AS (SELECT s1_id, cand_id FROM sel)", "ent")
_BLK = ("uni", "truth", "pset AS (SELECT DISTINCT s1_id, cand_id FROM candidates_train)", "ent")
_BEST = "(CASE WHEN tp = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + tp) END)"


@query(with_(*_SEL) + "SELECT s1_id, n_pred, n_true, tp, round(f, 6) AS f05 FROM ent")
def f05_entity(t):
    return rounded(mt.entity_scores(chosen(t), t.truth, t.universe), "f05")


@query(with_(*_SEL) + "SELECT count(*) AS n, round(avg(f), 6) AS macro_f05 FROM ent")
def macro_f05(t):
    return rounded(mt.macro_f05(chosen(t), t.truth, t.universe), "macro_f05")


_REPORT = ["pair_recall", "entity_ceiling", "ceiling_matched", "oracle_f05", "mean_candidates", "p50_candidates", "p95_candidates", "p50_found", "p95_found"]


@query(with_(*_BLK) + f"""SELECT round(sum(tp) / sum(n_true), 6) AS pair_recall, round(avg(CASE WHEN tp = n_true THEN 1 ELSE 0 END), 6) AS entity_ceiling, round(avg(CASE WHEN n_true > 0 THEN CASE WHEN tp = n_true THEN 1 ELSE 0 END END), 6) AS ceiling_matched, round(avg({_BEST}), 6) AS oracle_f05,
    round(avg(n_pred), 6) AS mean_candidates, round(quantile_cont(n_pred, 0.5), 6) AS p50_candidates, round(quantile_cont(n_pred, 0.95), 6) AS p95_candidates, round(quantile_cont(CASE WHEN n_pred > 0 THEN n_pred END, 0.5), 6) AS p50_found, round(quantile_cont(CASE WHEN n_pred > 0 THEN n_pred END, 0.95), 6) AS p95_found FROM ent""")
def blocking_report(t):
    return rounded(mt.blocking_report(t.cands, t.truth, t.universe), *_REPORT)


_LABELLED = "lab AS (SELECT c.*, t.cand_id IS NOT NULL AS is_true, " + " + ".join(f"CAST(blk_{p} AS INTEGER)" for p in PASSES) + " AS nf FROM candidates_train c LEFT JOIN truth t USING (s1_id, cand_id))"
_PER_PASS = " UNION ALL ".join(f"SELECT '{p}' AS pass, count(*) AS n_pairs, count(*) FILTER (is_true) AS n_true, round(count(*) FILTER (is_true) / (SELECT count(*) FROM truth), 6) AS recall, round(count(*) FILTER (is_true AND nf = 1) / (SELECT count(*) FROM truth), 6) AS marginal_recall FROM lab WHERE blk_{p} HAVING count(*) > 0" for p in PASSES)


@query(with_("truth", _LABELLED) + _PER_PASS)
def blocking_report_full(t):
    return rounded(mt.pass_report(t.cands, t.truth), "recall", "marginal_recall")


@query(with_(*_BLK) + "SELECT country, CAST(grouping(country) AS INTEGER) AS level, count(*) AS n_s1, CAST(sum(ent.n_true) AS BIGINT) AS n_true, round(sum(tp) / nullif(sum(ent.n_true), 0), 6) AS recall, round(avg(n_pred), 6) AS mean_candidates FROM ent JOIN uni USING (s1_id) GROUP BY GROUPING SETS ((country), ())")
def blocking_report_country(t):
    return rounded(mt.group_report(t.cands, t.truth, t.universe, "country"), "recall", "mean_candidates")


@query(with_("truth", _LABELLED) + "SELECT n AS top_n, count(*) AS n_pairs, round(count(*) FILTER (is_true) / (SELECT count(*) FROM truth), 6) AS recall FROM lab JOIN (VALUES (1), (2), (3), (5), (10)) AS z(n) ON prune_rank < n GROUP BY n")
def report_topn(t):
    return rounded(mt.top_n_report(t.cands, t.truth), "recall")


@query(with_("rec", "truth", "sd AS (SELECT entity_id, coalesce(country, '') AS c, coalesce(name_core, '') AS n, coalesce(postcode, '') AS p FROM rec)", "lost AS (SELECT s1_id, cand_id FROM truth ANTI JOIN candidates_train USING (s1_id, cand_id))") + """SELECT s1_id, cand_id, round(ned, 6) AS ned, CASE WHEN ac <> bc THEN 'cross_country' WHEN an = '' OR bn = '' THEN 'empty_fields' WHEN ned > 0.6::DOUBLE AND ap <> '' AND ap = bp THEN 'address_only_match' WHEN ned > 0.6::DOUBLE THEN 'name_very_different' ELSE 'other' END AS reason
    FROM (SELECT s1_id, cand_id, a.c AS ac, b.c AS bc, a.n AS an, b.n AS bn, a.p AS ap, b.p AS bp, CASE WHEN greatest(len(cs), 0) = 0 THEN 0.0::DOUBLE ELSE levenshtein(""" + PLAIN.format(x="a.n") + ", " + PLAIN.format(x="b.n") + """) / greatest(len(regexp_extract_all(a.n, '(?s).')), len(regexp_extract_all(b.n, '(?s).'))) END AS ned
    FROM (SELECT s1_id, cand_id, x, y, list_distinct(regexp_extract_all(x.n || y.n, '(?s).')) AS cs, x AS a, y AS b FROM lost JOIN sd x ON x.entity_id = s1_id JOIN sd y ON y.entity_id = cand_id))""")
def misses(t):
    return rounded(mt.misses(t.cands, t.truth, t.records), "ned")


@query(with_("uni", "bst AS (SELECT s1_id, count(*) AS n, max(CAST(bs_tfidf_name AS DOUBLE)) AS best FROM candidates_train GROUP BY s1_id)") + """SELECT *, coalesce(mean_best < 0.5::DOUBLE OR share_low > 0.2::DOUBLE, false) AS weak FROM (SELECT CASE WHEN country IN ('France', 'India') THEN country ELSE 'other' END AS land, count(*) AS n_s1, round(avg(coalesce(n, 0)), 6) AS mean_candidates, round(quantile_cont(coalesce(n, 0), 0.5), 6) AS p50, round(quantile_cont(coalesce(n, 0), 0.95), 6) AS p95,
    round(avg(best), 6) AS mean_best, round(quantile_cont(best, 0.25), 6) AS p25_best, round(quantile_cont(best, 0.5), 6) AS p50_best, round(quantile_cont(best, 0.75), 6) AS p75_best, round(avg(CASE WHEN best IS NOT NULL THEN CAST(best < 0.3::DOUBLE AS INTEGER) END), 6) AS share_low FROM uni LEFT JOIN bst USING (s1_id) GROUP BY 1)""")
def shift_report(t):
    return rounded(mt.shift_report(t.cands, t.universe, ("France", "India")), "mean_candidates", "p50", "p95", "mean_best", "p25_best", "p50_best", "p75_best", "share_low")


@query(with_(*_SEL, "e2 AS (SELECT ent.*, fold, coalesce(country, '') AS country, CASE WHEN ent.n_true >= 3 THEN '3+' ELSE CAST(ent.n_true AS VARCHAR) END AS bucket FROM ent JOIN uni USING (s1_id))")
       + " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value, count(*) AS n, round(avg(f), 6) AS macro_f05, round(avg(CASE WHEN n_pred = 0 THEN 1 ELSE 0 END), 6) AS empty_rate FROM e2 GROUP BY 2" for k, v in (("overall", "'all'"), ("fold", "CAST(fold AS VARCHAR)"), ("country", "country"), ("n_true", "bucket"))))
def evaluate_oof(t):
    return rounded(mt.evaluate(chosen(t), t.truth, t.universe), "macro_f05", "empty_rate")


def _by_source(s: int) -> str:
    cut = f"substr(cand_id, 2, 1) = '{s}'"
    return f"""SELECT {s} AS source, round(avg(CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(h, 0) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * h / (0.25::DOUBLE * b + a) END), 6) AS macro_f05 FROM uni
    LEFT JOIN (SELECT s1_id, count(*) AS a FROM sel WHERE {cut} GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS b FROM truth WHERE {cut} GROUP BY 1) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS h FROM sel JOIN truth USING (s1_id, cand_id) WHERE {cut} GROUP BY 1) USING (s1_id)"""


@query(with_("pr", "excl", "sel", "uni", "truth") + _by_source(2) + " UNION ALL " + _by_source(3))
def evaluate_sources(t):
    return rounded(mt.evaluate_sources(chosen(t), t.truth, t.universe), "macro_f05")


@query(with_(*_SEL) + "SELECT count(*) FILTER (n_true = 0) AS n_singletons, round(avg(CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS INTEGER) END), 6) AS singleton_accuracy, count(*) FILTER (n_true > 0) AS n_matched, round(avg(CASE WHEN n_true > 0 THEN CAST(n_pred = 0 AS INTEGER) END), 6) AS matched_left_empty FROM ent")
def evaluate_singletons(t):
    return rounded(mt.singleton_accuracy(chosen(t), t.truth, t.universe), "singleton_accuracy", "matched_left_empty")


@query(with_(*_SEL) + "SELECT loco_fold, count(*) AS n, round(avg(f), 6) AS macro_f05 FROM ent JOIN uni USING (s1_id) GROUP BY loco_fold")
def evaluate_loco(t):
    return rounded(mt.evaluate_loco(chosen(t), t.truth, t.universe), "macro_f05")


@query(with_(*_SEL) + "SELECT CASE WHEN n_true = 0 THEN 'singleton_matched' WHEN n_pred = 0 THEN 'left_empty' ELSE 'partial_set' END AS reason, count(*) AS n, round(sum(1 - f), 6) AS points_lost FROM ent WHERE f < 1 GROUP BY 1")
def loss_breakdown(t):
    return rounded(mt.loss_breakdown(chosen(t), t.truth, t.universe), "points_lost")


_RICH = "a.business_name AS name_s1, a.business_address AS addr_s1, b.business_name AS name_cand, b.business_address AS addr_cand FROM w LEFT JOIN rec a ON a.entity_id = s1_id LEFT JOIN rec b ON b.entity_id = cand_id"


@query(with_("rec", "pr", "excl", "sel", "truth", "rk AS (SELECT s1_id, cand_id, prob, CAST(rank() OVER (PARTITION BY s1_id ORDER BY prob DESC NULLS LAST) AS INTEGER) AS rank_within_s1 FROM preds_train)", "w AS (SELECT rk.* FROM rk SEMI JOIN sel USING (s1_id, cand_id) ANTI JOIN truth USING (s1_id, cand_id) ORDER BY prob DESC, s1_id, cand_id LIMIT 100)") + f"SELECT s1_id, cand_id, prob, rank_within_s1, {_RICH}")
def error_fp(t):
    return mt.false_positives(chosen(t), t.preds, t.truth, t.records)


@query(with_("rec", "pr", "excl", "sel", "truth", "w AS (SELECT t.s1_id, t.cand_id, p.prob FROM (SELECT * FROM truth ANTI JOIN sel USING (s1_id, cand_id)) t LEFT JOIN preds_train p USING (s1_id, cand_id) ORDER BY prob NULLS FIRST, s1_id, cand_id LIMIT 100)") + f"SELECT s1_id, cand_id, prob, {_RICH}")
def error_fn(t):
    return mt.false_negatives(chosen(t), t.preds, t.truth, t.records)


@query(with_("pr", "truth", "y AS (SELECT p, CASE WHEN t.cand_id IS NULL THEN 0 ELSE 1 END AS y FROM pr LEFT JOIN truth t USING (s1_id, cand_id))", "rk AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM y)") + "SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM rk")
def roc_auc(t):
    scored = t.preds.join(t.truth.select("s1_id", "cand_id", F.lit(1).alias("y")), ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return rounded(mt.roc_auc(scored), "auc", "brier")


# selection


@query(with_("pr") + "SELECT s1_id, cand_id, round(p, 6) AS prob FROM pr")
def sel_validate(t):
    return rounded(sl.validate_scores(t.preds), "prob")


@query(with_("pr", "excl") + "SELECT s1_id, cand_id, round(p, 6) AS prob FROM excl")
def sel_exclusive(t):
    return rounded(sl.exclusive(sl.distinct_pairs(sl.validate_scores(t.preds))), "prob")


@query(with_("pr", "excl", "uni", "ch AS (SELECT s1_id, cand_id FROM excl WHERE p >= CASE WHEN src = 2 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END)") + "SELECT u.s1_id, CAST(count(ch.cand_id) AS INTEGER) AS n_matches, coalesce(string_agg(ch.cand_id, ',' ORDER BY ch.cand_id), '') AS matches FROM uni u LEFT JOIN ch USING (s1_id) GROUP BY u.s1_id")
def sel_threshold(t):
    return sl.id_lists(sl.select_threshold(t.preds, 0.5, per_source={2: 0.4, 3: 0.6}), t.universe)


@query(with_("pr") + "SELECT s1_id, cand_id, round(p, 6) AS prob FROM (SELECT * FROM pr WHERE p >= 0.6::DOUBLE) QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) = 1")
def sel_simple(t):
    return rounded(sl.exclusive(sl.above_threshold(sl.distinct_pairs(sl.validate_scores(t.preds)), 0.6), "keep_first"), "prob")


_GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]


def _curve(source: str, first: str, count: int, divisor: int, step: int) -> str:
    """F0.5 at each threshold of a grid, straight from the definition."""
    return f"""gr AS (SELECT CAST(({first} + i * {step}) AS DOUBLE) / {divisor} AS threshold FROM range({count}) r(i)),
    kept AS (SELECT threshold, s1_id, count(*) AS a, count(t.cand_id) AS h FROM gr JOIN {source} x ON x.p >= gr.threshold LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY threshold, s1_id),
    tr AS (SELECT s1_id, count(*) AS b FROM truth GROUP BY s1_id),
    curve AS (SELECT gr.threshold, avg(CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(h, 0) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * h / (0.25::DOUBLE * b + a) END) AS f FROM gr CROSS JOIN (SELECT s1_id FROM uni) u LEFT JOIN kept USING (threshold, s1_id) LEFT JOIN tr USING (s1_id) GROUP BY gr.threshold)"""


@query(with_("pr", "excl", "uni", "truth", _curve("excl", "5", 91, 100, 1)) + "SELECT round(threshold, 6) AS threshold, round(f, 6) AS macro_f05 FROM curve")
def tune_threshold(t):
    return rounded(sl.threshold_curve(t.preds, t.truth, t.universe, _GRID), "threshold", "macro_f05")


@query(with_("pr", "excl", "uni", "truth", "g(i) AS (SELECT * FROM range(10))", "cells AS (SELECT CAST(a.i + 1 AS DOUBLE) / 11 AS t2, CAST(b.i + 1 AS DOUBLE) / 11 AS t3 FROM g a, g b)",
             "kept AS (SELECT t2, t3, s1_id, count(*) AS a, count(t.cand_id) AS h FROM cells JOIN pr x ON x.p >= CASE WHEN x.src = 2 THEN t2 ELSE t3 END LEFT JOIN truth t USING (s1_id, cand_id) GROUP BY ALL)", "tr AS (SELECT s1_id, count(*) AS b FROM truth GROUP BY s1_id)")
       + "SELECT round(t2, 6) AS t2, round(t3, 6) AS t3, round(avg(CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(h, 0) = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * h / (0.25::DOUBLE * b + a) END), 6) AS macro_f05 FROM cells CROSS JOIN (SELECT s1_id FROM uni) u LEFT JOIN kept USING (t2, t3, s1_id) LEFT JOIN tr USING (s1_id) GROUP BY t2, t3")
def tune_threshold_2d(t):
    return rounded(sl.threshold_plane(t.preds, t.truth, t.universe, [(i + 1) / 11 for i in range(10)]), "t2", "t3", "macro_f05")


@query(with_("pr", "uni", "truth", "one AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) = 1)", _curve("one", "30", 28, 100, 2)) + "SELECT round(threshold, 6) AS threshold, round(f, 6) AS macro_f05 FROM curve ORDER BY round(f, 12) DESC, threshold LIMIT 1")
def tune_quick(t):
    grid = [(30 + 2 * i) / 100 for i in range(28)]
    return rounded(sl.best_threshold(sl.threshold_curve(t.preds, t.truth, t.universe, grid, "keep_first")), "threshold", "macro_f05")


def _named_curve(source: str, first: str, count: int, divisor: int, step: int, name: str) -> str:
    return f"{name} AS (WITH " + _curve(source, first, count, divisor, step) + " SELECT threshold, f FROM curve)"


_ONE = "one AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) = 1)"
_DENSE = "dn AS (SELECT s1_id, cand_id, CAST(bs_dense AS DOUBLE) AS p FROM candidates_train WHERE bs_dense IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY CAST(bs_dense AS DOUBLE) DESC, s1_id) = 1)"


@query(with_("pr", "uni", "truth", _ONE, _DENSE, _named_curve("pr", "30", 28, 100, 2, "c1"), _named_curve("one", "30", 28, 100, 2, "c2"), _named_curve("dn", "880", 20, 1000, 5, "c3"))
       + " UNION ALL ".join(f"SELECT '{k}' AS arm, round(threshold, 6) AS threshold, round(f, 6) AS macro_f05 FROM {c}" for k, c in (("all", "c1"), ("exclusive", "c2"), ("dense_only", "c3"))))
def tune_quick_arms(t):
    """The whole grid with and without exclusivity, and that of the dense score alone."""
    grid = [(30 + 2 * i) / 100 for i in range(28)]
    dense = t.cands.filter("bs_dense is not null").select("s1_id", "cand_id", F.col("bs_dense").cast("double").alias("prob"))
    arms = (("all", t.preds, grid, None), ("exclusive", t.preds, grid, "keep_first"), ("dense_only", dense, [(880 + 5 * i) / 1000 for i in range(20)], "keep_first"))
    out = None
    for name, preds, steps, mode in arms:
        curve = sl.threshold_curve(preds, t.truth, t.universe, steps, mode).select(F.lit(name).alias("arm"), "threshold", "macro_f05")
        out = curve if out is None else out.unionByName(curve)
    return rounded(out, "threshold", "macro_f05")


@query(with_("pr", "uni", "truth", _ONE, "pset AS (SELECT s1_id, cand_id FROM one WHERE p >= 0.5::DOUBLE)", "ent") + "SELECT fold, count(*) AS n, round(avg(f), 6) AS macro_f05 FROM ent JOIN uni USING (s1_id) GROUP BY fold")
def tune_quick_folds(t):
    """F0.5 of each fold at one threshold."""
    picked = sl.select_threshold(t.preds, 0.5, "keep_first")
    return rounded(mt.entity_scores(picked, t.truth, t.universe).join(t.universe.select("s1_id", "fold"), "s1_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("f05").alias("macro_f05")), "macro_f05")


@query(with_("pr", "uni", "truth", "one AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY s1_id, src ORDER BY p DESC, cand_id) = 1)", _curve("one", "30", 66, 100, 1)) + "SELECT round(threshold, 6) AS threshold, round(f, 6) AS macro_f05 FROM curve ORDER BY round(f, 12) DESC, threshold DESC LIMIT 1")
def tune_baseline(t):
    from rowkin.operators.common import top_k

    best = top_k(sl.validate_scores(t.preds).withColumn("src", F.substring("cand_id", 2, 1)), ["s1_id", "src"], "prob", "cand_id", 1)
    grid = [(30 + i) / 100 for i in range(66)]
    return rounded(sl.best_threshold(sl.threshold_curve(best, t.truth, t.universe, grid, None), "high"), "threshold", "macro_f05")


_PB = """, pb AS (SELECT s1_id, 0 AS i, 0 AS a, 1.0::DOUBLE AS v FROM (SELECT DISTINCT s1_id FROM pn)
    UNION ALL SELECT s1_id, i + 1, b, sum(w) FROM (SELECT pb.s1_id, i, a + z.u AS b, v * CASE WHEN z.u = 1 THEN p ELSE 1 - p END AS w FROM pb JOIN pn ON pn.s1_id = pb.s1_id AND pn.n = pb.i + 1, (VALUES (0), (1)) z(u)) GROUP BY s1_id, i, b)"""


@query(with_("pr", "pn AS (SELECT s1_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS n FROM pr)").replace("WITH ", "WITH RECURSIVE ", 1) + _PB + "SELECT s1_id, CAST(a AS INTEGER) AS k, round(v, 6) AS prob FROM pb WHERE i = (SELECT max(n) FROM pn WHERE pn.s1_id = pb.s1_id)")
def poisson_binomial(t):
    lists = sl.validate_scores(t.preds).groupBy("s1_id").agg(F.sort_array(F.collect_list("prob"), asc=False).alias("p"))
    return lists.select("s1_id", F.posexplode(sl.poisson_binomial(F.col("p"))).alias("k", "prob")).select("s1_id", "k", F.round("prob", 6).alias("prob"))


@query(with_("pr", "pn AS (SELECT s1_id, cand_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS n FROM pr)", "sz AS (SELECT s1_id, max(n) AS m FROM pn GROUP BY s1_id)").replace("WITH ", "WITH RECURSIVE ", 1) + """,
    dp AS (SELECT s1_id, k, 0 AS i, 0 AS a, 0 AS b, 1.0::DOUBLE AS v FROM sz, LATERAL (SELECT unnest(range(m + 1)) AS k)
      UNION ALL SELECT s1_id, k, i + 1, a2, b2, sum(w) FROM (SELECT dp.s1_id, k, i, a + CASE WHEN i < k THEN u ELSE 0 END AS a2, b + CASE WHEN i >= k THEN u ELSE 0 END AS b2, v * CASE WHEN u = 1 THEN p ELSE 1 - p END AS w FROM dp JOIN pn ON pn.s1_id = dp.s1_id AND pn.n = dp.i + 1, (VALUES (0), (1)) z(u)) GROUP BY ALL),
    ef AS (SELECT dp.s1_id, k, round(sum(CASE WHEN k = 0 THEN CASE WHEN b = 0 THEN v ELSE 0 END ELSE v * 1.25::DOUBLE * a / (0.25::DOUBLE * (a + b) + k) END), 12) AS ef FROM dp JOIN sz ON sz.s1_id = dp.s1_id AND dp.i = sz.m GROUP BY dp.s1_id, k),
    best AS (SELECT * FROM ef QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY ef DESC, k) = 1)
    SELECT best.s1_id, CAST(k AS INTEGER) AS k, round(ef, 6) AS expected_f, coalesce((SELECT string_agg(cand_id, ',' ORDER BY n) FROM pn WHERE pn.s1_id = best.s1_id AND n <= k), '') AS matches FROM best""")
def sel_expected_f(t):
    out = sl.expected_f_choices(t.preds)
    return out.select("s1_id", "k", F.round("expected_f", 6).alias("expected_f"), F.array_join("cand_ids", ",").alias("matches"))


@query(with_("pr") + "SELECT s1_id, round(max(p), 6) AS max_p, round(coalesce(list_sort(list(p), 'DESC')[2], 0), 6) AS second_p, count(*) FILTER (p > 0.5::DOUBLE) AS n_above_05 FROM pr GROUP BY s1_id")
def gate_features(t):
    return rounded(sl.gate_features(t.preds), "max_p", "second_p")


@query()
def gate(t):
    allowed, _ = ln.fit_gate(sl.gate_features(t.preds), t.universe)
    picked = sl.select_expected_f(t.preds).join(allowed.filter("allow"), "s1_id", "left_semi")
    return picked.select("s1_id", "cand_id")


def _isotonic(rows: str, out: str) -> str:
    """``out`` (part, p, v): the isotonic fit of y on p within each part of ``rows``, by its max-min formula."""
    return f"""{out}_g AS (SELECT part, p, count(*) AS n, sum(y) AS s FROM {rows} GROUP BY part, p),
    {out}_i AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY p) AS i, sum(n) OVER (PARTITION BY part ORDER BY p) AS cn, sum(s) OVER (PARTITION BY part ORDER BY p) AS cs FROM {out}_g),
    {out}_m AS (SELECT j.part, j.i AS j, k.i AS k, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) OVER (PARTITION BY j.part, j.i ORDER BY k.i DESC) AS m FROM {out}_i j JOIN {out}_i k ON k.part = j.part AND k.i >= j.i),
    {out} AS (SELECT x.part, x.p, z.v FROM (SELECT part, k, max(m) AS v FROM {out}_m GROUP BY part, k) z JOIN {out}_i x ON x.part = z.part AND x.i = z.k)"""


_Y = "yy AS (SELECT pr.s1_id, pr.cand_id, p, fold, CASE WHEN t.cand_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM pr LEFT JOIN truth t USING (s1_id, cand_id))"


@query(with_("pr", "truth", _Y, "tr AS (SELECT f.fold AS part, yy.p, yy.y FROM (SELECT DISTINCT fold FROM yy) f JOIN yy ON yy.fold <> f.fold)", _isotonic("tr", "fit")) + """SELECT s1_id, cand_id, round(CASE WHEN lo.p IS NULL THEN hi.v WHEN hi.p IS NULL OR hi.p = lo.p THEN lo.v ELSE lo.v + (hi.v - lo.v) * (yy.p - lo.p) / (hi.p - lo.p) END, 6) AS prob_calibrated
    FROM yy ASOF LEFT JOIN fit lo ON lo.part = yy.fold AND yy.p >= lo.p ASOF LEFT JOIN fit hi ON hi.part = yy.fold AND yy.p <= hi.p""")
def calibrate_oof(t):
    return rounded(ln.calibrate_oof(t.preds, t.truth).select("s1_id", "cand_id", "prob_calibrated"), "prob_calibrated")


@query(with_("pr", "truth", _Y, "tr AS (SELECT 0 AS part, p, y FROM yy)", _isotonic("tr", "fit")) + "SELECT s1_id, cand_id, round(v, 6) AS prob FROM yy JOIN fit ON fit.p = yy.p")
def calibrate_all(t):
    return ln.apply_calibrator(ln.fit_calibrator(t.preds, t.truth), t.preds.filter("prob is not null")).select("s1_id", "cand_id", F.round("prob", 6).alias("prob"))


@query()
def tune_select(t):
    """Macro F0.5 of the methods compared: best threshold, expected F, expected F on calibrated scores, and that behind the gate; the best is marked."""
    best = sl.best_threshold(sl.threshold_curve(t.preds, t.truth, t.universe, _GRID)).select(F.lit("threshold").alias("method"), "macro_f05")
    calibrated = ln.calibrate_oof(t.preds, t.truth).select("s1_id", "cand_id", F.col("prob_calibrated").alias("prob"))
    out = best
    for name, preds in (("expected_f", t.preds), ("expected_f_calibrated", calibrated)):
        out = out.unionByName(mt.macro_f05(sl.select_expected_f(preds), t.truth, t.universe).select(F.lit(name).alias("method"), "macro_f05"))
    allowed, _ = ln.fit_gate(sl.gate_features(t.preds), t.universe)
    gated = sl.select_expected_f(calibrated).join(allowed.filter("allow"), "s1_id", "left_semi")
    out = rounded(out.unionByName(mt.macro_f05(gated, t.truth, t.universe).select(F.lit("expected_f_gate").alias("method"), "macro_f05")), "macro_f05")
    out = cut(out, "methods")
    top = out.orderBy(F.desc("macro_f05"), "method").limit(1).select("method", F.lit(True).alias("chosen"))
    return out.join(top, "method", "left").select("method", "macro_f05", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def _model_inputs(t, cands=None):
    rows, names = ln.prune_inputs(t.cands if cands is None else cands)
    rows = rows.join(t.universe.select("s1_id", "fold"), "s1_id").join(t.truth.select("s1_id", "cand_id", F.lit(1).alias("y")), ["s1_id", "cand_id"], "left")
    return rows.withColumn("y", F.coalesce("y", F.lit(0))), names


@query()
def train_gbdt(t):
    rows, names = _model_inputs(t)
    oof, _, _ = ln.train_boosted(rows, names, [0, 1, 2, 3, 4])
    return oof


@query()
def train_gbdt_importance(t):
    """Inputs by their share of the gain in the model of all rows, with the rounds that early stopping led to."""
    rows, names = _model_inputs(t)
    _, _, found = ln.train_boosted(rows, names, [0, 1, 2, 3, 4])
    return t.spark.createDataFrame([(k, float(v), found["rounds"]) for k, v in found["importance"].items()], "input string, gain double, rounds int")


@query()
def predict_submit(t):
    """Lists of every source-1 record of split test; candidates of both splits are made by the same passes, so a score means the same in both."""
    test = Tables(t.spark, t.sf_dir, "test")
    rows, names = _model_inputs(t, cut(bl.generate(t.records), "submit_train"))
    oof, models, _ = ln.train_boosted(rows, names, [0, 1, 2, 3, 4])
    oof = cut(oof, "submit_oof")
    best = sl.best_threshold(sl.threshold_curve(oof, t.truth, t.universe, _GRID)).first()
    unseen, _ = ln.prune_inputs(bl.generate(test.records))
    return sl.id_lists(sl.select_threshold(ln.predict(models, unseen, names), best["threshold"]), test.first)


# profiles

_FLAGS = {f"n_{k}": v.format(c="n") for k, v in NAME_SQL.items()}


@query(f"""SELECT split, source, count(*) AS n_rows, count(*) FILTER (trim(n) = '') AS empty_name, count(*) FILTER (trim(a) = '') AS empty_addr, round(avg(len(regexp_split_to_array(trim(n), '\\s+'))), 6) AS mean_tokens, CAST(max(length(n)) AS INTEGER) AS max_len, {', '.join(f"round(quantile_cont(length(n), {q}), 6) AS len_p{int(100 * q):02d}" for q in pf.LEVELS)},
    {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _FLAGS.items())}, count(*) FILTER ({' OR '.join(f'({v})' for v in _FLAGS.values())}) AS n_any
    FROM (SELECT split, source, coalesce(business_name, '') AS n, coalesce(business_address, '') AS a FROM records) GROUP BY split, source""")
def eda_profile(t):
    return rounded(pf.profile(t.raw("records")), "mean_tokens", *[f"len_p{int(100 * q):02d}" for q in pf.LEVELS])


@query("SELECT split, source, country, CAST(grouping(split, source, country) AS INTEGER) AS level, count(*) AS n_rows FROM records GROUP BY ROLLUP (split, source, country)")
def eda_countries(t):
    return pf.country_counts(t.raw("records"))


@query("SELECT source, token, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS INTEGER) AS place FROM (SELECT source, lower(regexp_extract(business_name, '(\\S+)', 1)) AS token, count(*) AS n FROM records GROUP BY ALL) WHERE token <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, token) <= 30")
def eda_first_tokens(t):
    return pf.first_tokens(t.raw("records"))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(business_name), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\p{Nd}+$'))) AS token FROM records WHERE country = 'France') GROUP BY token ORDER BY n DESC, token LIMIT 50")
def eda_france(t):
    return pf.token_frequencies(t.raw("records"), "France")


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(business_address), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\p{Nd}+$'))) AS token FROM records WHERE country = 'France') GROUP BY token ORDER BY n DESC, token LIMIT 50")
def eda_address_tokens(t):
    return pf.token_frequencies(t.raw("records"), "France", column="business_address")


@query(f"WITH {SCRIPT_OF} SELECT country, script, count(*) AS n FROM script_of GROUP BY country, script")
def eda_scripts(t):
    return pf.script_counts(t.raw("records"))


@query("SELECT scripts, n FROM (" + SCAN_SQL["script_nonlatin"] + ") WHERE scripts <> '' ORDER BY n DESC, scripts LIMIT 8")
def eda_script_sets(t):
    return pf.script_sets(t.raw("records").filter("business_name is not null"))


@query(with_("truth") + "SELECT CAST(substr(cand_id, 2, 1) AS INTEGER) AS source, count(*) AS n_cands, count(*) FILTER (n >= 2) AS claimed_2, count(*) FILTER (n >= 3) AS claimed_3, max(n) AS max_fan_in FROM (SELECT cand_id, count(DISTINCT s1_id) AS n FROM truth GROUP BY cand_id) GROUP BY 1")
def eda_exclusivity(t):
    return pf.exclusivity(t.truth)


@query(with_("rec", "truth") + "SELECT a.country AS country_s1, b.country AS country_cand, coalesce(lower(trim(a.country)) = lower(trim(b.country)), false) AS same_folded, count(*) AS n FROM truth JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = cand_id GROUP BY ALL")
def eda_crosstab(t):
    return pf.country_crosstab(t.truth, t.records)


@query(with_("uni", "truth", "k AS (SELECT u.country, CAST(least(count(t.cand_id), 5) AS INTEGER) AS bucket FROM uni u LEFT JOIN truth t USING (s1_id) GROUP BY u.s1_id, u.country)") + "SELECT country, bucket, CAST(grouping(country) AS INTEGER) AS level, count(*) AS n FROM k GROUP BY GROUPING SETS ((country, bucket), (bucket))")
def eda_histogram(t):
    return pf.match_histogram(t.truth, t.universe)


@query(with_("uni", "truth", "k AS (SELECT u.s1_id, CAST(least(count(*) FILTER (substr(t.cand_id, 2, 1) = '2'), 4) AS INTEGER) AS n2, CAST(least(count(*) FILTER (substr(t.cand_id, 2, 1) = '3'), 4) AS INTEGER) AS n3 FROM uni u LEFT JOIN truth t USING (s1_id) GROUP BY u.s1_id)") + "SELECT n2, n3, count(*) AS n FROM k GROUP BY n2, n3")
def eda_same_source(t):
    return pf.repeated_sources(t.truth, t.universe)


@query(with_("rec", "truth", "pl AS (SELECT source, country, t.cand_id IS NULL AS free FROM rec LEFT JOIN (SELECT DISTINCT cand_id FROM truth) t ON t.cand_id = entity_id WHERE source IN (2, 3))") + "SELECT source, country, CAST(grouping(country) AS INTEGER) AS level, count(*) AS n_rows, count(*) FILTER (free) AS n_distractors FROM pl GROUP BY GROUPING SETS ((source, country), (source))")
def eda_distractors(t):
    return pf.distractors(t.records, t.truth)


@query()
def eda_pair_samples(t):
    sample = ln.sample_per_group(t.truth.withColumn("source", F.substring("cand_id", 2, 1)), "source", "cand_id", 20)
    return mt.enrich(sample, t.records)


@query(with_("truth", "x AS (SELECT CAST(substr(s1_id, 4) AS BIGINT) AS a, CAST(substr(cand_id, 4) AS BIGINT) AS b FROM truth)", "r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x)") + "SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r")
def eda_spearman(t):
    return rounded(pf.id_spearman(t.truth), "spearman")
