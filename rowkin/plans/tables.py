"""The project's tables as the operators take them, and the same as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators.common import latest
from rowkin.session import table


class Tables:
    """Tables below ``sf_dir``; deliveries are reduced to the last one, pairs to distinct ones."""

    def __init__(self, spark: SparkSession, sf_dir: str, split: str = "train"):
        self.spark, self.sf_dir, self.split = spark, sf_dir, split

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def records(self) -> DataFrame:
        return latest(self.raw("records").filter(F.col("split") == self.split), ["split", "entity_id"])

    @cached_property
    def universe(self) -> DataFrame:
        return latest(self.raw("folds"), ["s1_id"])

    @cached_property
    def first(self) -> DataFrame:
        """Every record of source 1 in the split, also where no folds or labels are given."""
        return self.records.filter("source = 1").select(F.col("entity_id").alias("s1_id"))

    @cached_property
    def truth(self) -> DataFrame:
        return self.raw("labels").select("s1_id", "cand_id").distinct()

    @cached_property
    def cands(self) -> DataFrame:
        return self.raw("candidates_train")

    @cached_property
    def preds(self) -> DataFrame:
        return self.raw("preds_train")

    @cached_property
    def vectors(self) -> DataFrame:
        """Embeddings cut into three sources by id; the label stands for the country."""
        return self.raw("embeddings").select(
            F.concat(F.lit("S"), F.col("vec_id") % 3 + 1, F.lit("-"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("id"), (F.col("vec_id") % 3 + 1).cast("int").alias("source"), F.col("label").cast("string").alias("country"), F.col("embedding").alias("v")
        )


SQL = {
    "rec": "rec AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY split, entity_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM records WHERE split = 'train') WHERE rn = 1)",
    "uni": "uni AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM folds) WHERE rn = 1)",
    "truth": "truth AS (SELECT DISTINCT s1_id, cand_id FROM labels)",
    "pr": "pr AS (SELECT s1_id, cand_id, CAST(prob AS DOUBLE) AS p, CAST(substr(cand_id, 2, 1) AS INTEGER) AS src, fold FROM preds_train WHERE prob IS NOT NULL)",
    "vec": "vec AS (SELECT 'S' || (vec_id % 3 + 1) || '-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS id, CAST(vec_id % 3 + 1 AS INTEGER) AS source, CAST(label AS VARCHAR) AS country, embedding AS v FROM embeddings)",
    # threshold choice at 0.5 with ties dropped
    "excl": "excl AS (SELECT s1_id, cand_id, p, src FROM (SELECT *, max(p) OVER (PARTITION BY cand_id) AS m FROM pr) QUALIFY p = m AND count(*) FILTER (p = m) OVER (PARTITION BY cand_id) = 1)",
    "sel": "sel AS (SELECT s1_id, cand_id FROM excl WHERE p >= 0.5::DOUBLE)",
    "ent": """ent AS (SELECT u.s1_id, coalesce(n_pred, 0) AS n_pred, coalesce(t.n_true, 0) AS n_true, coalesce(tp, 0) AS tp,
        CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(t.n_true, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(tp, 0) = 0 THEN 0.0::DOUBLE
             ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * t.n_true + n_pred) END AS f
        FROM uni u LEFT JOIN (SELECT s1_id, count(*) AS n_pred FROM pset GROUP BY s1_id) q USING (s1_id)
        LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM truth GROUP BY s1_id) t USING (s1_id)
        LEFT JOIN (SELECT s1_id, count(*) AS tp FROM pset JOIN truth USING (s1_id, cand_id) GROUP BY s1_id) h USING (s1_id))""",
}


def with_(*names: str) -> str:
    """A WITH clause of the named parts; what has a blank in it stands for itself."""
    return "WITH " + ",\n".join(SQL.get(n, n) for n in names) + "\n"
