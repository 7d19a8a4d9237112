"""Learning on pairs with pyspark.ml: fold assignment, pruning model, calibration, gate and boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators.common import PASSES
from rowkin.session import cut


def stratified_folds(universe: DataFrame, n_folds: int = 5) -> DataFrame:
    """``(s1_id, fold)``: within each stratum of country and capped number of matches, ids in hash order are dealt out in turn.

    Sizes within a stratum differ by at most one; every record gets a fold.
    """
    stratum = F.concat_ws("_", F.coalesce("country", F.lit("")), F.least("n_true", F.lit(3)).cast("string"))
    w = Window.partitionBy("stratum").orderBy(F.crc32(F.col("s1_id").cast("binary")), "s1_id")
    return universe.withColumn("stratum", stratum).select("s1_id", ((F.row_number().over(w) - 1) % n_folds).cast("int").alias("fold"))


def loco_folds(universe: DataFrame) -> DataFrame:
    """``(s1_id, loco_fold)``: the place of the record's country among the sorted countries, null for no country."""
    lands = universe.select("country").filter("country is not null").distinct()
    codes = lands.select("country", (F.row_number().over(Window.orderBy("country")) - 1).cast("smallint").alias("loco_fold"))  # one row per country
    return universe.select("s1_id", "country").join(codes, "country", "left").select("s1_id", "loco_fold")


def group_folds(df: DataFrame, k: int, key: str = "s1_id") -> DataFrame:
    """``df`` with ``gfold``: folds that never split a key."""
    return df.withColumn("gfold", (F.crc32(F.col(key).cast("string").cast("binary")) % k).cast("int"))


def in_sample(key: Column | str, share: float) -> Column:
    """Fixed sample by the key's crc32."""
    return F.crc32(F.col(key).cast("binary") if isinstance(key, str) else key.cast("binary")) % 10000 < share * 10000


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group in order of a seeded hash of the key."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def explode_labels(truth: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, label)`` of ``(s1_id, matches)``, repeated ids once."""
    return truth.select("s1_id", F.explode(F.array_distinct("matches")).alias("cand_id")).distinct().withColumn("label", F.lit(1))


def prune_inputs(cands: DataFrame, passes: tuple[str, ...] = PASSES) -> tuple[DataFrame, list[str]]:
    """Model inputs of candidates: scores with -1 for missing, flags and the number of passes."""
    out = cands
    names = []
    for p in passes:
        out = out.withColumn(f"x_bs_{p}", F.coalesce(F.col(f"bs_{p}").cast("double"), F.lit(-1.0))).withColumn(f"x_blk_{p}", F.col(f"blk_{p}").cast("double"))
        names += [f"x_bs_{p}", f"x_blk_{p}"]
    out = out.withColumn("x_n_passes", reduce(lambda a, b: a + b, [F.col(f"x_blk_{p}") for p in passes]))
    return out, [*names, "x_n_passes"]


def fit_logistic(df: DataFrame, names: Sequence[str], label: str = "y", strength: float = 1.0) -> dict:
    """Balanced logistic regression on standardised inputs as plain numbers: names, mean, scale, coef, intercept."""
    counts = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    n, pos = counts[0], counts[1] or 0.0
    weight = F.when(F.col(label) == 1, n / (2.0 * max(pos, 1.0))).otherwise(n / (2.0 * max(n - pos, 1.0)))
    vec = VectorAssembler(inputCols=list(names), outputCol="raw").transform(df.withColumn("__w", weight).withColumn("__y", F.col(label).cast("double")))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vec)
    model = LogisticRegression(featuresCol="scaled", labelCol="__y", weightCol="__w", regParam=1.0 / (strength * max(n, 1)), standardization=False, maxIter=50).fit(scaler.transform(vec))
    scale = [s if s > 0 else 1.0 for s in scaler.std.toArray().tolist()]
    return {"names": list(names), "mean": scaler.mean.toArray().tolist(), "scale": scale, "coef": model.coefficients.toArray().tolist(), "intercept": float(model.intercept)}


def logistic_score(params: dict) -> Column:
    """The model's probability as a column expression."""
    z = F.lit(params["intercept"])
    for name, m, s, c in zip(params["names"], params["mean"], params["scale"], params["coef"], strict=True):
        z = z + (F.col(name) - m) / s * c
    return 1 / (1 + F.exp(-z))


def learned_prune(cands: DataFrame, truth: DataFrame, top_n: int = 50, n_folds: int = 5, min_passes: int = 3) -> tuple[DataFrame, dict]:
    """Candidates with out-of-fold model scores as ``prune_score`` and new ranks, cut to ``top_n`` or enough passes; and the final model."""
    rows, names = prune_inputs(group_folds(cands.drop("prune_score", "prune_rank"), n_folds))
    rows = rows.join(truth.select("s1_id", "cand_id", F.lit(1).alias("y")), ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    rows = cut(rows, "prune")  # read by every fit
    parts = [rows.filter(F.col("gfold") == k).withColumn("prune_score", logistic_score(fit_logistic(rows.filter(F.col("gfold") != k), names))) for k in range(n_folds)]
    scored = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("s1_id").orderBy(F.desc("prune_score"), "cand_id")
    ranked = scored.withColumn("prune_rank", F.row_number().over(w) - 1).filter((F.col("prune_rank") < top_n) | (F.col("x_n_passes") >= min_passes))
    return ranked.select(*[c for c in cands.columns if c not in ("prune_score", "prune_rank")], "prune_score", "prune_rank"), fit_logistic(rows, names)


def calibrate_oof(preds: DataFrame, truth: DataFrame, folds: Sequence[int] | None = None) -> DataFrame:
    """``preds`` with ``prob_calibrated``: isotonic regression fitted on the other folds; where these hold one class only, the score itself."""
    rows = preds.filter("prob is not null").join(truth.select("s1_id", "cand_id", F.lit(1.0).alias("y")), ["s1_id", "cand_id"], "left")
    rows = cut(rows.withColumn("y", F.coalesce("y", F.lit(0.0))).withColumn("p", F.col("prob").cast("double")), "calibrate")
    folds = folds if folds is not None else [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for k in folds:
        train, own = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        low, high = train.agg(F.min("y"), F.max("y")).first()
        if low is None or low == high:
            parts.append(own.withColumn("prob_calibrated", F.col("p")))
            continue
        model = IsotonicRegression(featuresCol="p", labelCol="y").fit(train)
        parts.append(model.transform(own).withColumn("prob_calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction"))
    return reduce(DataFrame.unionByName, parts).drop("y", "p")


def fit_calibrator(preds: DataFrame, truth: DataFrame):
    """The calibrator of all rows, or None for one class."""
    rows = preds.filter("prob is not null").join(truth.select("s1_id", "cand_id", F.lit(1.0).alias("y")), ["s1_id", "cand_id"], "left")
    rows = rows.select(F.coalesce("y", F.lit(0.0)).alias("y"), F.col("prob").cast("double").alias("p"))
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    return None if low is None or low == high else IsotonicRegression(featuresCol="p", labelCol="y").fit(rows)


def apply_calibrator(model, preds: DataFrame) -> DataFrame:
    """``preds`` with calibrated scores in ``prob``; without a model they stay."""
    if model is None:
        return preds
    out = model.transform(preds.withColumn("p", F.col("prob").cast("double")))
    return out.withColumn("prob", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("p", "prediction")


def fit_gate(features: DataFrame, universe: DataFrame, n_folds: int = 5) -> tuple[DataFrame, dict]:
    """``(s1_id, allow)`` cross-fitted over records (allow from 0.5 on) and the model of all rows; the target is whether a record has a match."""
    names = [c for c in features.columns if c != "s1_id"]
    rows = group_folds(features.join(universe.select("s1_id", (F.col("n_true") > 0).cast("int").alias("y")), "s1_id"), n_folds)
    rows = cut(rows.select("s1_id", "y", "gfold", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]), "gate")
    parts = [rows.filter(F.col("gfold") == k).withColumn("allow", logistic_score(fit_logistic(rows.filter(F.col("gfold") != k), names)) >= 0.5) for k in range(n_folds)]
    return reduce(DataFrame.unionByName, parts).select("s1_id", "allow"), fit_logistic(rows, names)


def train_boosted(features: DataFrame, names: Sequence[str], folds: Sequence[int], label: str = "y", most: int = 200, depth: int = 5, rate: float = 0.1, seeds: Sequence[int] = (42,), tolerance: float = 0.001) -> tuple[DataFrame, list, dict]:
    """Out-of-fold scores ``(s1_id, cand_id, fold, prob)`` of boosted trees, the models of all rows, one per seed, and what was found out.

    Each fold's model is trained on the other folds until the loss on the fold itself improves by less than ``tolerance`` of itself, at most
    ``most`` rounds. The models of all rows have 1.1 times the mean rounds of the folds. Scores are the mean over the seeds. Missing inputs
    are -1 with a flag of their own. The record holds names, rounds per fold, rounds, and the importance of each input (share of the gain).
    """
    inputs = [*names, *[f"{c}_missing" for c in names]]
    vec = cut(_vectorised(features.withColumn("y", F.col(label).cast("double")), names).select("s1_id", "cand_id", "fold", "y", "features"), "boost")
    kind = dict(labelCol="y", featuresCol="features", maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="auto")
    parts, rounds = [], []
    for k in folds:
        own = vec.filter(F.col("fold") == k)
        marked = vec.withColumn("__held", F.col("fold") == k)
        scored = own.select("s1_id", "cand_id", "fold", "features").withColumn("prob", F.lit(0.0))
        for seed in seeds:
            model = GBTClassifier(maxIter=most, seed=seed, validationIndicatorCol="__held", validationTol=tolerance, **kind).fit(marked)
            rounds.append(model.getNumTrees)
            scored = model.transform(scored).withColumn("prob", F.col("prob") + vector_to_array("probability")[1] / len(seeds)).drop("rawPrediction", "probability", "prediction")
        parts.append(scored.drop("features"))
    n = max(1, int(sum(rounds) / max(1, len(rounds)) * 1.1)) if rounds else most
    models = [GBTClassifier(maxIter=n, seed=seed, **kind).fit(vec) for seed in seeds]
    gain = [sum(m.featureImportances[i] for m in models) / len(models) for i in range(len(inputs))]
    found = {"names": list(names), "fold_rounds": rounds, "rounds": n, "depth": depth, "rate": rate, "seeds": list(seeds), "importance": dict(sorted(zip(inputs, gain, strict=True), key=lambda x: (-x[1], x[0])))}
    return reduce(DataFrame.unionByName, parts), models, found


def _vectorised(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in names}).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in names})
    return VectorAssembler(inputCols=[*names, *[f"{c}_missing" for c in names]], outputCol="features").transform(rows)


def predict(models, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(s1_id, cand_id, prob)``: the mean score of one or several boosted models."""
    models = models if isinstance(models, (list, tuple)) else [models]
    scored = _vectorised(features.select("s1_id", "cand_id", *names), names).select("s1_id", "cand_id", "features").withColumn("prob", F.lit(0.0))
    for model in models:
        scored = model.transform(scored).withColumn("prob", F.col("prob") + vector_to_array("probability")[1] / len(models)).drop("rawPrediction", "probability", "prediction")
    return scored.select("s1_id", "cand_id", "prob")
