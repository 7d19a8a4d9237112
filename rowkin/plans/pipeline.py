"""The pipeline from records to match lists, stage by stage, and its evaluation.

    python -m rowkin.plans.pipeline run TABLES OUT
    python -m rowkin.plans.pipeline evaluate TABLES OUT
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators import blocking as bl
from rowkin.operators import features as ft
from rowkin.operators import learning as ln
from rowkin.operators import metrics as mt
from rowkin.operators import selection as sl
from rowkin.operators.common import cumulative
from rowkin.plans.tables import Tables
from rowkin.session import build_session
from rowkin.sources import files

#: Thresholds tried.
GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]


def pair_inputs(cands: DataFrame, records: DataFrame) -> tuple[DataFrame, list[str]]:
    """Context features of candidates and their names."""
    rows = ft.context_features(cands, records)
    return rows, [c for c in rows.columns if c.startswith("fc_")]


def labelled(rows: DataFrame, t: Tables) -> DataFrame:
    """``rows`` of records that have a fold, with ``fold`` and ``y``."""
    return rows.join(t.universe.select("s1_id", "fold"), "s1_id").join(t.truth.select("s1_id", "cand_id", F.lit(1).alias("y")), ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def write_lists(spark: SparkSession, universe: DataFrame, records: DataFrame, chosen: DataFrame, cands: DataFrame, out: str) -> None:
    """The two list files of a split, one line per record of ``universe``, validated."""
    order = cumulative(universe.select("s1_id", F.lit(1).alias("one")), "s1_id", "one").select("s1_id", F.col("upto").alias("row_no"))
    pool = records.filter("source in (2, 3)").select("entity_id")
    for name, pairs, column in (("matching_results", chosen, "matched_entity_ids"), ("candidate_pairs", cands, "candidate_entity_ids")):
        files.write_id_lists(files.id_list_frame(order, pairs.select("s1_id", "cand_id"), pool, list_col=column), f"{out}/{name}.tsv")
    faults = files.validate_id_lists(spark, f"{out}/matching_results.tsv", f"{out}/candidate_pairs.tsv", order, pool)
    if faults:
        raise ValueError(f"result files: {faults}")


def run(spark: SparkSession, tables: str, out: str, rounds: int = 200) -> dict:
    """Candidates, features, out-of-fold scores, calibration, threshold and match lists; every stage is written below ``out``, and the lists of split test below ``out``/test."""
    t = Tables(spark, tables)
    neighbours = t.cands.filter("blk_dense").select("s1_id", "cand_id", F.col("bs_dense").alias("score"))
    files.write_stage(bl.generate(t.records, neighbours=neighbours), f"{out}/candidates")
    cands = spark.read.parquet(f"{out}/candidates")
    rows, names = pair_inputs(cands, t.records)
    files.write_stage(rows, f"{out}/features")
    rows = labelled(spark.read.parquet(f"{out}/features"), t)
    folds = [r[0] for r in t.universe.select("fold").distinct().orderBy("fold").collect()]
    oof, _, found = ln.train_boosted(rows, names, folds, most=rounds)
    files.save_json(f"{out}/meta.json", found)
    files.write_stage(ln.calibrate_oof(oof, t.truth, folds).select("s1_id", "cand_id", "fold", F.col("prob_calibrated").alias("prob")), f"{out}/preds")
    preds = spark.read.parquet(f"{out}/preds")
    best = sl.best_threshold(sl.threshold_curve(preds, t.truth, t.universe, GRID)).first()
    params = {"method": "threshold", "threshold": best["threshold"], "exclusive": True, "macro_f05": best["macro_f05"]}
    files.save_json(f"{out}/params.json", params)
    write_lists(spark, t.universe, t.records, sl.select_threshold(preds, best["threshold"]), cands, out)
    submit(spark, tables, f"{out}/test", rounds)
    return params


def submit(spark: SparkSession, tables: str, out: str, rounds: int = 200) -> dict:
    """Match lists of every source-1 record of split test, written below ``out``.

    Vector neighbours are given for train only, so the model, its calibration and its threshold come from train candidates made without
    them, by the passes that make the test candidates.
    """
    train, test = Tables(spark, tables), Tables(spark, tables, "test")
    names: list[str] = []
    for t in (train, test):
        files.write_stage(bl.generate(t.records), f"{out}/candidates_{t.split}")
        rows, names = pair_inputs(spark.read.parquet(f"{out}/candidates_{t.split}"), t.records)
        files.write_stage(rows, f"{out}/features_{t.split}")
    folds = [r[0] for r in train.universe.select("fold").distinct().orderBy("fold").collect()]
    oof, model, found = ln.train_boosted(labelled(spark.read.parquet(f"{out}/features_train"), train), names, folds, most=rounds)
    files.save_json(f"{out}/meta.json", found)
    files.write_stage(oof, f"{out}/oof")
    oof = spark.read.parquet(f"{out}/oof")
    best = sl.best_threshold(sl.threshold_curve(ln.calibrate_oof(oof, train.truth, folds).select("s1_id", "cand_id", F.col("prob_calibrated").alias("prob")), train.truth, train.universe, GRID)).first()
    scored = ln.apply_calibrator(ln.fit_calibrator(oof, train.truth), ln.predict(model, spark.read.parquet(f"{out}/features_test"), names))
    files.write_stage(scored.select("s1_id", "cand_id", "prob"), f"{out}/preds")
    params = {"method": "threshold", "threshold": best["threshold"], "exclusive": True, "macro_f05_train": best["macro_f05"]}
    files.save_json(f"{out}/params.json", params)
    write_lists(spark, test.first, test.records, sl.select_threshold(spark.read.parquet(f"{out}/preds"), best["threshold"]), spark.read.parquet(f"{out}/candidates_test"), out)
    return params


def evaluate(spark: SparkSession, tables: str, out: str) -> DataFrame:
    """Scores of the written choice overall and by group; appends the overall figures to ``out``/experiments.csv."""
    t = Tables(spark, tables)
    params = files.load_json(f"{out}/params.json")
    preds = spark.read.parquet(f"{out}/preds")
    chosen = sl.select_threshold(preds, params["threshold"], "drop_ties" if params["exclusive"] else None)
    report = mt.evaluate(chosen, t.truth, t.universe)
    on_cands = mt.blocking_report(spark.read.parquet(f"{out}/candidates"), t.truth, t.universe).first()
    overall = report.filter("kind = 'overall'").first()
    files.append_log(f"{out}/experiments.csv", {"macro_f05": round(overall["macro_f05"], 6), "candidate_recall": round(on_cands["pair_recall"], 6), "candidate_oracle_f05": round(on_cands["oracle_f05"], 6), **params})
    return report


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=["run", "evaluate"])
    parser.add_argument("tables")
    parser.add_argument("out")
    args = parser.parse_args(argv)
    os.makedirs(args.out, exist_ok=True)
    spark = build_session()
    if args.stage == "run":
        print(run(spark, args.tables, args.out))
    else:
        print(files.markdown_table(evaluate(spark, args.tables, args.out).orderBy("kind", "value")))


if __name__ == "__main__":
    main()
