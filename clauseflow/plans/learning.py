"""K*: features, folds, models, held-out metrics and scoring on the risk reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.operators import ml as ML
from clauseflow.plans.base import quoted
from clauseflow.plans.compliance import REPORT_SQL, reports
from clauseflow.plans.registry import query, table
from clauseflow.plans.reports import binary_sql, div, r6
from clauseflow.session import scratch_path

MATRIX_SQL = f"""mx AS (SELECT doc_id, d.source AS notice_id, (l.quality = 0)::INT AS y,
  {', '.join(f'CASE WHEN length(d.text) >= 20 THEN round({c}, 6) ELSE 0.0 END AS {c}' for c in L.FEATURE_COLUMNS)}
  FROM ft JOIN labels l USING (doc_id) JOIN documents d USING (doc_id))"""


def matrix(spark, sf):
    """17 features and target per evaluation episode; a failed record gives zero features."""
    r = reports(spark, sf).select("doc_id", "features.*", "chars")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("notice_id"))
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("y"))
    ok = F.col("chars") >= 20
    cols = [
        F.when(ok, F.round(F.coalesce(c, F.lit(0.0)), 6)).otherwise(F.lit(0.0)).alias(c)
        for c in L.FEATURE_COLUMNS
    ]
    return r.join(lab, "doc_id").join(d, "doc_id").select("doc_id", "notice_id", "y", *cols)


@query("k01_feature_matrix", f"{REPORT_SQL}, {MATRIX_SQL} SELECT * FROM mx")
def k01(spark, sf):
    return matrix(spark, sf)


@query("k02_group_folds", """
WITH g AS (SELECT source AS notice_id, round(avg((quality = 0)::INT), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT notice_id, share, ((row_number() OVER (ORDER BY share, md5(notice_id)) - 1) % 5)::INTEGER AS fold FROM g""")
def k02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("notice_id"))
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("y"))
    return ML.group_folds(lab.join(d, "doc_id"), "notice_id", "y", 5)


#: The grids that are compared: penalty kind and C, size of a forest, rounds of boosting, C of the SVM.
GRIDS = {
    "lr": [{"C": c, "elasticNetParam": e, "maxIter": 500} for c in (0.01, 0.1, 1.0, 10.0) for e in (1.0, 0.0)],
    "rf": [
        {"numTrees": n, "maxDepth": d, "minInstancesPerNode": m}
        for n in (100, 300) for d in (5, 10, 30) for m in (5, 10)
    ],
    "gbt": [{"maxIter": 10, "maxDepth": d} for d in (2, 3)],
    "svm": [{"C": c, "maxIter": 500, "tol": 1e-4} for c in (0.1, 1.0, 10.0)],
}


def _grid_fit(kind: str):
    """Held-out macro F1, accuracy and AUC of every grid point, pooled over five group folds."""

    def run(spark, sf):
        held = ML.held_out_grid(matrix(spark, sf), "doc_id", "notice_id", kind, GRIDS[kind])
        names = F.create_map(*[x for i, p in enumerate(GRIDS[kind]) for x in (F.lit(i), F.lit(str(p)))])
        return ML.grid_metrics(held).select(
            "point", names[F.col("point")].alias("params"), "tp", "fp", "fn", "tn",
            *[F.round(c, 4).alias(c) for c in ("accuracy", "f1_macro", "auc")],
        )

    return run


query("k03_logistic_regression")(_grid_fit("lr"))
query("k04_random_forest")(_grid_fit("rf"))
query("k05_boosted_trees")(_grid_fit("gbt"))
query("k06_linear_svm")(_grid_fit("svm"))


@query("k07_nested_search")
def k07(spark, sf):
    """Pooled held-out metrics of the nested search (LR, whole grid)."""
    m = ML.training_set(matrix(spark, sf))
    n = m.count() * 8 // 15  # rows of an inner training part
    grid = [ML.fit_params("lr", p, n) for p in GRIDS["lr"]]
    pooled = ML.nested_search(m, "notice_id", "lr", grid, outer=5, inner=3)
    out = ML.held_out_metrics(pooled, "y", "prediction", "score")
    return out.select("tp", "fp", "fn", "tn",
                      *[F.round(c, 4).alias(c) for c in ("accuracy", "f1_macro", "f1_pos", "kappa", "auc")])


@query("k08_held_out_metrics", f"""{REPORT_SQL}, z AS (SELECT (quality = 0)::INT AS y, round(risk_score, 6) AS s, (risk_score >= 0.9)::INT AS p FROM sc JOIN labels USING (doc_id)),
 c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM z),
 rk AS (SELECT y, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE) AS r FROM z),
 au AS (SELECT sum(r) FILTER (y = 1) AS sr, (count(*) FILTER (y = 1))::DOUBLE AS np, (count(*) FILTER (y = 0))::DOUBLE AS nq FROM rk)
SELECT tp, fp, fn, tn, {', '.join(f'{r6(e)} AS {n}' for n, e in binary_sql().items())}, {r6(div('sr - np * (np + 1) / 2', 'np * nq'))} AS auc FROM c, au""")
def k08(spark, sf):
    r = reports(spark, sf).select("doc_id", "risk_score")
    lab = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("y"))
    z = r.join(lab, "doc_id").withColumn("p", (F.col("risk_score") >= 0.9).cast("int"))
    m = ML.held_out_metrics(z, "y", "p", "risk_score")
    return m.select("tp", "fp", "fn", "tn",
                    *[F.round(c, 6).alias(c) for c in ("accuracy", "f1_pos", "f1_neg", "f1_macro", "kappa", "auc")])


@query("k09_permutation_importance")
def k09(spark, sf):
    m = ML.training_set(matrix(spark, sf))
    model = ML.estimator("rf", numTrees=20, maxDepth=5).fit(m)
    imp = ML.permutation_importance(model, m, "doc_id")
    return imp.select("feature", F.round("mean_drop", 6).alias("mean_drop"), F.round("std_drop", 6).alias("std_drop"))


@query("k10_deployed_scorer")
def k10(spark, sf):
    """Balanced logistic regression: mean accuracy and AUC over stratified folds, AUC in sample."""
    r = ML.scorer_report(matrix(spark, sf), "doc_id")
    return r.select(
        *[F.round(c, 4).alias(c) for c in ("cv_accuracy_mean", "cv_roc_auc_mean", "in_sample_roc_auc", "pos_rate")],
        "n_train",
    )


@query("k11_batch_scoring")
def k11(spark, sf):
    """Fitted model stored, loaded back and applied to every document."""
    path = scratch_path(spark, "risk-model")
    ML.train_scorer(ML.training_set(matrix(spark, sf)), path=path)
    model = PipelineModel.load(path)
    every = reports(spark, sf).select("doc_id", "features.*")
    return ML.score(model, every).select("doc_id", F.round("score", 4).alias("risk_score"), "prediction")
