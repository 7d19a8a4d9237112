"""Choosing a match set per record from scored pairs (s1_id, cand_id, prob)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of a record that take part in expected-F selection.
MAX_PAIRS = 50


def validate_scores(preds: DataFrame, column: str = "prob", keep: Sequence[str] = ()) -> DataFrame:
    """``(s1_id, cand_id, prob, <keep>)`` with numeric scores, nulls dropped; a score outside [0, 1] raises."""
    missing = {"s1_id", "cand_id", column} - set(preds.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    out = preds.select("s1_id", "cand_id", F.expr(f"try_cast(`{column}` as double)").alias("prob"), *keep).filter("prob is not null")
    if out.filter((F.col("prob") < 0) | (F.col("prob") > 1)).limit(1).count():
        raise ValueError("scores outside [0, 1]")
    return out


def exclusive(pairs: DataFrame, mode: str = "drop_ties") -> DataFrame:
    """Each candidate stays with its best record; ties drop all (``drop_ties``) or keep the smallest s1_id (``keep_first``)."""
    if mode == "keep_first":
        w = Window.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id")
        return pairs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    w = Window.partitionBy("cand_id")
    best = pairs.withColumn("__m", F.max("prob").over(w)).withColumn("__t", F.count_if(F.col("prob") == F.col("__m")).over(w))
    return best.filter((F.col("prob") == F.col("__m")) & (F.col("__t") == 1)).drop("__m", "__t")


def distinct_pairs(preds: DataFrame) -> DataFrame:
    """One row per pair: its greatest score."""
    return preds.groupBy("s1_id", "cand_id").agg(F.max("prob").alias("prob"))


def above_threshold(pairs: DataFrame, threshold: float, per_source: dict[int, float] | None = None) -> DataFrame:
    """Pairs whose score reaches the threshold, or that of the candidate's source."""
    limit: Column = F.lit(threshold)
    for s, t in (per_source or {}).items():
        limit = F.when(F.substring("cand_id", 2, 1) == str(s), F.lit(t)).otherwise(limit)
    return pairs.filter(F.col("prob") >= limit)


def select_threshold(preds: DataFrame, threshold: float, exclusive_mode: str | None = "drop_ties", per_source: dict[int, float] | None = None) -> DataFrame:
    """``(s1_id, cand_id, prob)`` chosen by a threshold after exclusivity; a null score is never chosen."""
    pairs = distinct_pairs(preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("prob")))
    if exclusive_mode:
        pairs = exclusive(pairs, exclusive_mode)
    return above_threshold(pairs, threshold, per_source)


def id_lists(selected: DataFrame, universe: DataFrame) -> DataFrame:
    """``(s1_id, n_matches, matches)``: sorted comma list of every record's chosen ids, "" for none."""
    lists = selected.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("ids"))
    return universe.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_matches"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("matches"))


def threshold_curve(preds: DataFrame, truth: DataFrame, universe: DataFrame, grid: Sequence[float], exclusive_mode: str | None = "drop_ties") -> DataFrame:
    """``(threshold, macro_f05)`` over a grid in one pass.

    A record's set only changes where a threshold passes one of its scores. Each pair is mapped to the last grid place that keeps it; sums
    over places then give sizes and hits per record at every place it changes, and differences of F0.5 are added up along the grid. So
    a pair gives one row, whatever the grid's size.
    """
    grid = sorted(grid)
    n = universe.select("s1_id").distinct().count()
    pairs = distinct_pairs(preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("prob")))
    if exclusive_mode:
        pairs = exclusive(pairs, exclusive_mode)
    place = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= F.col("prob")))
    tagged = pairs.withColumn("place", place).join(truth.select("s1_id", "cand_id", F.lit(1).alias("t")), ["s1_id", "cand_id"], "left")
    steps = tagged.groupBy("s1_id", "place").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.coalesce("t", F.lit(0))).alias("tp"))
    total = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = universe.select("s1_id").distinct().join(total, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    down = Window.partitionBy("s1_id").orderBy(F.desc("place"))
    known = steps.join(base, "s1_id").withColumn("sp", F.sum("n_pred").over(down)).withColumn("st", F.sum("tp").over(down))
    score = F.when((F.col("n_true") == 0), 0.0).when(F.col("st") == 0, 0.0).otherwise(1.25 * F.col("st") / (0.25 * F.col("n_true") + F.col("sp")))
    known = known.withColumn("f", score)
    before = F.coalesce(F.lag("f").over(down), F.when(F.col("n_true") == 0, 1.0).otherwise(0.0))
    # at grid place p (threshold grid[p-1]) a pair with place >= p is kept
    gains = known.withColumn("gain", F.col("f") - before).groupBy("place").agg(F.sum("gain").alias("gain"))
    empty = base.agg(F.sum(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0))).first()[0] or 0.0
    spark = preds.sparkSession
    axis = spark.createDataFrame([(i + 1, float(g)) for i, g in enumerate(grid)], "p int, threshold double")
    summed = gains.filter("place > 0").select(F.explode(F.sequence(F.lit(1), "place")).alias("p"), "gain").groupBy("p").agg(F.sum("gain").alias("g"))
    reached = axis.join(summed, "p", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    return reached.select("threshold", ((F.col("g") + F.lit(empty)) / F.lit(n)).alias("macro_f05"))


def threshold_plane(preds: DataFrame, truth: DataFrame, universe: DataFrame, grid: Sequence[float]) -> DataFrame:
    """``(t2, t3, macro_f05)`` for every pair of thresholds of sources 2 and 3, by corner differences.

    A record's F0.5 is constant on rectangles of the plane. Each rectangle gives four signed corner values, which are added up over all
    records and then summed along both axes: one pass instead of one selection per cell.
    """
    grid = sorted(grid)
    m = len(grid)
    n = universe.select("s1_id").distinct().count()
    pairs = distinct_pairs(preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("prob")))
    place = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= F.col("prob")))
    tagged = pairs.withColumn("place", place).join(truth.select("s1_id", "cand_id", F.lit(1).alias("t")), ["s1_id", "cand_id"], "left").withColumn("src", F.substring("cand_id", 2, 1).cast("int"))
    steps = tagged.filter("place > 0").groupBy("s1_id", "src", "place").agg(F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("t", F.lit(0))).alias("h"))
    down = Window.partitionBy("s1_id", "src").orderBy(F.desc("place"))
    steps = steps.withColumn("k", F.sum("k").over(down)).withColumn("h", F.sum("h").over(down)).withColumn("low", F.coalesce(F.lead("place").over(down), F.lit(0)))

    def spans(s: int) -> DataFrame:
        """Per record the spans [low, place) of grid places with constant k and h, and the span above all scores."""
        own = steps.filter(F.col("src") == s).select("s1_id", "low", F.col("place").alias("high"), "k", "h")
        top = own.groupBy("s1_id").agg(F.max("high").alias("low")).select("s1_id", "low", F.lit(m).alias("high"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h")).filter(F.col("low") < m)
        none = universe.select("s1_id").distinct().join(own.select("s1_id").distinct(), "s1_id", "left_anti").select("s1_id", F.lit(0).alias("low"), F.lit(m).alias("high"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
        both = own.unionByName(top).unionByName(none)
        return both.select("s1_id", *[F.col(c).alias(f"{c}{s}") for c in ("low", "high", "k", "h")])

    total = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    cells = spans(2).join(spans(3), "s1_id").join(total, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    k, h = F.col("k2") + F.col("k3"), F.col("h2") + F.col("h3")
    f = F.when((F.col("n_true") == 0) & (k == 0), 1.0).when(h == 0, 0.0).otherwise(1.25 * h / (0.25 * F.col("n_true") + k))
    corners = cells.withColumn("f", f).select(F.explode(F.array(
        F.struct(F.col("low2").alias("i"), F.col("low3").alias("j"), F.col("f").alias("v")), F.struct(F.col("high2").alias("i"), F.col("low3").alias("j"), (-F.col("f")).alias("v")),
        F.struct(F.col("low2").alias("i"), F.col("high3").alias("j"), (-F.col("f")).alias("v")), F.struct(F.col("high2").alias("i"), F.col("high3").alias("j"), F.col("f").alias("v")),
    )).alias("c")).select("c.*").filter((F.col("i") < m) & (F.col("j") < m)).groupBy("i", "j").agg(F.sum("v").alias("v"))
    spark = preds.sparkSession
    places = spark.range(m * m).select((F.col("id") / m).cast("int").alias("i"), (F.col("id") % m).cast("int").alias("j"))
    full = places.join(corners, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    full = full.withColumn("v", F.sum("v").over(Window.partitionBy("i").orderBy("j")))
    full = full.withColumn("v", F.sum("v").over(Window.partitionBy("j").orderBy("i")))
    at = F.array(*[F.lit(float(g)) for g in grid])
    return full.select(F.get(at, F.col("i")).alias("t2"), F.get(at, F.col("j")).alias("t3"), (F.col("v") / F.lit(n)).alias("macro_f05"))


def best_threshold(curve: DataFrame, ties: str = "low") -> DataFrame:
    """The row of greatest macro_f05 (rounded to 12 digits); ties to the lowest or highest threshold."""
    order = F.asc("threshold") if ties == "low" else F.desc("threshold")
    return curve.orderBy(F.desc(F.round("macro_f05", 12)), order).limit(1)


def poisson_binomial(p: Column) -> Column:
    """Distribution of the number of successes of independent trials with the probabilities of an array."""
    return F.aggregate(
        p,
        F.array(F.lit(1.0)),
        lambda d, x: F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda stay, up: stay * (1 - x) + up * x),
    )


def expected_f(chosen: Column, rest: Column, miss_rate: float = 0.0) -> Column:
    """Expected F0.5 of choosing the pairs of ``chosen`` while those of ``rest`` may be true too.

    ``miss_rate`` adds as many further possible matches outside the candidates as ``rest`` has; it does not count for an empty choice,
    whose value is the probability that nothing is true.
    """
    k = F.size(chosen)
    others = F.concat(rest, F.transform(rest, lambda _: F.lit(float(miss_rate)))) if miss_rate > 0 else rest
    a, b = poisson_binomial(chosen), poisson_binomial(others)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
        F.lit(0.0),
        lambda s, i: s + F.get(a, i) * F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.lit(0.0), lambda t, j: t + F.get(b, j) * (1.25 * i / (0.25 * (i + j) + k))),
    )
    nothing = F.aggregate(rest, F.lit(1.0), lambda s, x: s * (1 - x))
    return F.when(k == 0, nothing).otherwise(total)


def expected_f_choices(preds: DataFrame, exclusive_mode: str | None = None, miss_rate: float = 0.0, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``(s1_id, k, expected_f, cand_ids)``: for each record the prefix of its pairs by score that maximises expected F0.5, the shorter of equal ones."""
    pairs = distinct_pairs(preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("prob")))
    if exclusive_mode:
        pairs = exclusive(pairs, exclusive_mode)
    w = Window.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id")
    top = pairs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_pairs)
    lists = top.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("n", "cand_id", "prob"))).alias("l")).select("s1_id", F.col("l.prob").alias("p"), F.col("l.cand_id").alias("ids"))
    values = F.transform(
        F.sequence(F.lit(0), F.size("p")),
        lambda k: F.struct(F.round(expected_f(F.slice("p", F.lit(1), k), F.slice("p", k + 1, F.greatest(F.size("p") - k, F.lit(0))), miss_rate), 12).alias("ef"), (-k).alias("k")),
    )
    best = F.array_max(values)
    return lists.withColumn("best", best).select("s1_id", (-F.col("best.k")).alias("k"), F.col("best.ef").alias("expected_f"), F.slice("ids", F.lit(1), -F.col("best.k")).alias("cand_ids"))


def select_expected_f(preds: DataFrame, **options) -> DataFrame:
    """``(s1_id, cand_id)`` chosen by expected F0.5."""
    return expected_f_choices(preds, **options).select("s1_id", F.explode("cand_ids").alias("cand_id"))


def gate_features(preds: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """``(s1_id, max_p, second_p, n_above_05 [, n_close])`` per record."""
    p = preds.filter("prob is not null").select("s1_id", "cand_id", F.col("prob").cast("double").alias("p"))
    out = p.groupBy("s1_id").agg(F.max("p").alias("max_p"), F.coalesce(F.get(F.sort_array(F.collect_list("p"), asc=False), F.lit(1)), F.lit(0.0)).alias("second_p"), F.count_if(F.col("p") > 0.5).alias("n_above_05"))
    if context is None:
        return out
    return out.join(context.groupBy("s1_id").agg(F.max("fc_n_close").alias("n_close")), "s1_id", "left")
