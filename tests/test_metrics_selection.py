"""Worked examples and invariants of metrics and selection."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowkin.operators import metrics as mt
from rowkin.operators import selection as sl

PAIR = "s1_id string, cand_id string"


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def universe(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "s1_id string")


def preds(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, cand_id string, prob double")


def plain_f05(pred, true):
    if not pred and not true:
        return 1.0
    tp = len(pred & true)
    return 0.0 if not tp else 1.25 * tp / (0.25 * len(true) + len(pred))


def test_worked_example(spark):
    p = pairs(spark, [("S1-1", "S2-00047"), ("S1-1", "S2-00193"), ("S1-1", "S3-00812")])
    t = pairs(spark, [("S1-1", "S2-00047"), ("S1-1", "S3-00812")])
    assert round(mt.macro_f05(p, t, universe(spark, ["S1-1"])).first()["macro_f05"], 3) == 0.714


@pytest.mark.parametrize(("pred", "true", "want"), [([], [], 1.0), ([], ["S2-1"], 0.0), (["S2-1"], [], 0.0), (["S2-1", "S3-1"], ["S2-1", "S3-1"], 1.0)])
def test_empty_and_perfect(spark, pred, true, want):
    got = mt.macro_f05(pairs(spark, [("S1-1", c) for c in pred]), pairs(spark, [("S1-1", c) for c in true]), universe(spark, ["S1-1"])).first()
    assert got["macro_f05"] == want


def test_missing_prediction_is_empty(spark):
    e = mt.entity_scores(pairs(spark, [("S1-1", "S2-1")]), pairs(spark, [("S1-1", "S2-1")]), universe(spark, ["S1-1", "S1-2"]))
    assert {r["s1_id"]: r["f05"] for r in e.collect()} == {"S1-1": 1.0, "S1-2": 1.0}


def test_empty_universe(spark):
    assert mt.macro_f05(pairs(spark, []), pairs(spark, []), universe(spark, [])).first()["macro_f05"] == 0.0


def test_blocking_report(spark):
    c = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")])
    t = pairs(spark, [("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-3")])
    r = mt.blocking_report(c, t, universe(spark, ["S1-1", "S1-2", "S1-3"])).first()
    assert [round(r[k], 6) for k in ("pair_recall", "entity_ceiling", "oracle_f05", "mean_candidates")] == [0.666667, 0.666667, 0.666667, 1.0]


def test_expected_f(spark):
    p = preds(spark, [("S1-1", "S2-1", 0.6), ("S1-2", "S2-2", 0.4), ("S1-3", "S2-3", 0.99), ("S1-3", "S2-4", 0.70)])
    got = {r["s1_id"]: (r["cand_ids"], round(r["expected_f"], 4)) for r in sl.expected_f_choices(p).collect()}
    assert got == {"S1-1": (["S2-1"], 0.6), "S1-2": ([], 0.6), "S1-3": (["S2-3"], 0.8745)}


def test_expected_f_brute_force(spark):
    random.seed(3)
    rows = [(f"S1-{i}", f"S2-{i}{j}", round(random.random(), 3)) for i in range(6) for j in range(i + 1)]
    got = {r["s1_id"]: (r["k"], r["expected_f"]) for r in sl.expected_f_choices(preds(spark, rows)).collect()}
    for i in range(6):
        p = sorted((x[2] for x in rows if x[0] == f"S1-{i}"), reverse=True)
        best = (-1.0, 0)
        for k in range(len(p) + 1):
            ef = 0.0
            for y in itertools.product((0, 1), repeat=len(p)):
                w = 1.0
                for a, b in zip(p, y, strict=True):
                    w *= a if b else 1 - a
                ef += w * plain_f05(set(range(k)), {j for j, b in enumerate(y) if b})
            if ef > best[0] + 1e-12:
                best = (ef, k)
        assert got[f"S1-{i}"][0] == best[1]
        assert abs(got[f"S1-{i}"][1] - best[0]) < 1e-9


def test_exclusive_modes(spark):
    p = preds(spark, [("S1-1", "S2-1", 0.9), ("S1-2", "S2-1", 0.9), ("S1-1", "S2-2", 0.8), ("S1-2", "S2-2", 0.3)])
    assert {(r[0], r[1]) for r in sl.exclusive(p).collect()} == {("S1-1", "S2-2")}
    assert {(r[0], r[1]) for r in sl.exclusive(p, "keep_first").collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-2")}


def test_validate_scores(spark):
    bad = preds(spark, [("S1-1", "S2-1", 1.5)])
    with pytest.raises(ValueError):
        sl.validate_scores(bad)
    with pytest.raises(ValueError):
        sl.validate_scores(bad.drop("prob"))
    assert sl.validate_scores(preds(spark, [("S1-1", "S2-1", None)])).count() == 0


def test_threshold_curve_and_plane_against_definition(spark):
    random.seed(7)
    rows = [(f"S1-{random.randrange(6)}", f"S{random.choice((2, 3))}-{j}", random.choice((None, round(random.random(), 2)))) for j in range(40)]
    truth = [(a, b) for a, b, _ in rows if random.random() < 0.4]
    ids = [f"S1-{i}" for i in range(8)]
    p, t, u = preds(spark, rows), pairs(spark, truth), universe(spark, ids)

    def plain(keep):
        return sum(plain_f05({b for a, b, s in rows if a == i and s is not None and keep(b, s)}, {b for a, b in truth if a == i}) for i in ids) / len(ids)

    grid = [0.0, 0.2, 0.45, 0.7, 0.99]
    for r in sl.threshold_curve(p, t, u, grid, None).collect():
        assert abs(r["macro_f05"] - plain(lambda b, s, r=r: s >= r["threshold"])) < 1e-9
    for r in sl.threshold_plane(p, t, u, grid).collect():
        assert abs(r["macro_f05"] - plain(lambda b, s, r=r: s >= (r["t2"] if b[1] == "2" else r["t3"]))) < 1e-9


def test_id_lists_restore_empty(spark):
    out = sl.id_lists(pairs(spark, [("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")]), universe(spark, ["S1-1", "S1-2"]))
    assert {r["s1_id"]: r["matches"] for r in out.collect()} == {"S1-1": "S2-1,S3-2", "S1-2": ""}


def test_null_truth_and_clashing_columns(spark):
    p = preds(spark, [("S1-1", "S2-1", 0.9)]).withColumn("n_true", F.lit(5)).withColumn("place", F.lit("x"))
    t = pairs(spark, [("S1-1", "S2-1"), (None, "S2-9")]).withColumn("prob", F.lit(1.0))
    u = universe(spark, ["S1-1"]).withColumn("n_true", F.lit(3))
    assert mt.macro_f05(p, t, u).first()["macro_f05"] == 1.0
    assert sl.threshold_curve(p, t, u, [0.5]).first()["macro_f05"] == 1.0
