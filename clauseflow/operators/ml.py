"""Risk models with Spark ML: folds, training, nested search, held-out metrics, importance."""

from __future__ import annotations

import math
import random
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseflow import lexicon as L
from clauseflow.operators import forest, logistic
from clauseflow.operators.metrics import binary_scores
from clauseflow.operators.report import RiskModel
from clauseflow.operators.windows import hash_order, ordered_index
from clauseflow.functions.scalar import ratio
from clauseflow.session import cut_lineage, scratch_path


def group_folds(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """(group, fold): a group never spans folds and label shares are spread over the folds.

    Groups are ordered by positive share (hash order inside equal shares) and dealt round
    robin.  Numbering runs on one row per group, in buckets of share and hash prefix.
    """
    g = df.groupBy(group).agg(F.round(F.avg(F.col(label).cast("double")), 6).alias("share"))
    h = hash_order(group)
    idx = ordered_index(
        g, [F.asc("share"), h.asc()], F.struct("share", F.substring(h, 1, 2).alias("h"))
    )
    return idx.select(group, "share", (F.col("row_idx") % k).cast("int").alias("fold"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """(key, fold): rows in hash order inside each label, dealt round robin.

    Every fold has each label's share to within one row.
    """
    h = hash_order(key)
    idx = ordered_index(
        df.select(key, label), [F.asc(label), h.asc()], F.struct(label, F.substring(h, 1, 2).alias("h"))
    )
    return idx.select(key, (F.col("row_idx") % k).cast("int").alias("fold"))


ROWS_PER_TASK = 50_000


def training_set(df: DataFrame) -> DataFrame:
    """Materialised input of the iterative trainers, split by its size.

    A trainer runs one job per iteration, so a small set should not pay for many tasks; a
    large one keeps the partitions it has.
    """
    stored = cut_lineage(df)
    parts = min(stored.rdd.getNumPartitions(), stored.count() // ROWS_PER_TASK + 1)
    return stored.coalesce(parts)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weight n / (2 * n_class)."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    n, p = c["n"], c["p"] or 0
    pos = n / (2.0 * p) if p else 1.0
    neg = n / (2.0 * (n - p)) if n > p else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(pos)).otherwise(F.lit(neg)))


def estimator(kind: str, label: str = "y", **params) -> Estimator:
    """Feature assembly (standardised for linear models) and one classifier."""
    raw = VectorAssembler(inputCols=list(L.FEATURE_COLUMNS), outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    plain = VectorAssembler(inputCols=list(L.FEATURE_COLUMNS), outputCol="features")
    if kind == "lr":
        return Pipeline(stages=[raw, scale, LogisticRegression(labelCol=label, **params)])
    if kind == "svm":
        return Pipeline(stages=[raw, scale, LinearSVC(labelCol=label, **params)])
    if kind == "rf":
        return Pipeline(stages=[plain, RandomForestClassifier(labelCol=label, seed=42, **params)])
    if kind == "gbt":
        return Pipeline(stages=[plain, GBTClassifier(labelCol=label, seed=42, **params)])
    raise ValueError(kind)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Batch scoring: ``score`` is the positive probability (margin for the SVM)."""
    out = model.transform(df)
    src = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(src)[1]).drop(
        "raw", "features", "rawPrediction", "probability"
    )


def _counts(label: Column, pred: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & (pred == 1)).alias("tp"),
        F.count_if((label == 0) & (pred == 1)).alias("fp"),
        F.count_if((label == 1) & (pred == 0)).alias("fn"),
        F.count_if((label == 0) & (pred == 0)).alias("tn"),
    ]


def macro_f1(scored: DataFrame, label: str = "y") -> float:
    c = scored.agg(*_counts(F.col(label), F.col("prediction")))
    s = binary_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    return float(c.select(s["f1_macro"].alias("v")).first()["v"])


def rank_auc(df: DataFrame, label: str, value: str) -> DataFrame:
    """ROC AUC by the rank-sum formula with average ties.

    Rows are folded to one row per distinct (rounded) score before the running sum.
    """
    h = df.groupBy(F.round(value, 6).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("q").over(w), F.lit(0))
    a = h.withColumn("below", below).agg(
        F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"),
        F.sum("p").alias("np"), F.sum("q").alias("nq"),
    )
    return a.select(ratio(F.col("u"), F.col("np") * F.col("nq")).alias("auc"))


def held_out_metrics(df: DataFrame, label: str, pred: str, value: str) -> DataFrame:
    """Accuracy, class and macro F1, kappa, AUC and the confusion table in one row."""
    c = df.agg(*_counts(F.col(label), F.col(pred)))
    s = binary_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    flat = c.select("tp", "fp", "fn", "tn", *[v.alias(k) for k, v in s.items()])
    return flat.crossJoin(rank_auc(df, label, value))  # two single-row tables


def nested_search(
    df: DataFrame, group: str, kind: str, grid: list[dict], outer: int = 5, inner: int = 3,
    label: str = "y",
) -> DataFrame:
    """Nested grid search on macro F1; returns pooled held-out predictions.

    Rows: every input row once, with fold, chosen grid position, prediction and score.
    """
    folds = group_folds(df, group, label, outer).select(group, "fold")
    if kind == "lr":
        return _nested_logistic(df, folds, group, grid, outer, inner, label)
    data = training_set(df.join(folds, group)).cache()
    pooled = None
    for f in range(outer):
        train = data.where(F.col("fold") != f).drop("fold")
        best, model = _search(train, group, kind, grid, inner, label)
        part = score(model, data.where(F.col("fold") == f)).withColumn("chosen", F.lit(best))
        pooled = part if pooled is None else pooled.unionByName(part)
    return training_set(pooled)


def _folds_scored(data: DataFrame, models: list, fold: str, points: int) -> DataFrame:
    """Rows with ``scores``: one probability for each point, by the models of the row's own fold."""
    listed = F.array(*[logistic.literal(models[i : i + points]) for i in range(0, len(models), points)])
    return logistic.probabilities(data, list(L.FEATURE_COLUMNS), F.get(listed, F.col(fold)), "scores")


def _nested_logistic(
    df: DataFrame, folds: DataFrame, group: str, grid: list[dict], outer: int, inner: int, label: str
) -> DataFrame:
    """:func:`nested_search` of logistic regressions: all inner models in one go, then all outer ones."""
    feats = list(L.FEATURE_COLUMNS)
    base = training_set(df.join(folds, group))
    parts = folds
    for f in range(outer):
        own = group_folds(base.where(F.col("fold") != f), group, label, inner)
        parts = parts.join(own.select(group, F.col("fold").alias(f"inner_{f}")), group, "left")
    data = training_set(base.drop("fold").join(parts, group)).cache()
    trains = F.array(
        *[(F.col("fold") != f) & (F.col(f"inner_{f}") != g) for f in range(outer) for g in range(inner)],
        *[F.col("fold") != f for f in range(outer)],
    )
    trains = F.transform(trains, lambda x: F.coalesce(x, F.lit(False)))  # no inner fold outside its part
    points = len(grid)
    best = [0] * outer
    if points > 1:
        jobs = [(f * inner + g, p) for f in range(outer) for g in range(inner) for p in grid]
        models = logistic.fit_many(data, feats, label, trains, jobs)
        counted = None
        for f in range(outer):
            own = models[f * inner * points : (f + 1) * inner * points]
            part = _folds_scored(data.where(F.col("fold") != f), own, f"inner_{f}", points)
            part = part.select(F.lit(f).alias("of"), F.col(f"inner_{f}").alias("part"), label, F.posexplode("scores"))
            counted = part if counted is None else counted.unionByName(part)
        c = counted.groupBy("of", "part", F.col("pos").alias("point")).agg(
            *_counts(F.col(label), (F.col("col") > 0.5).cast("int"))
        )
        value = binary_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])["f1_macro"]
        means = {
            (r["of"], r["point"]): r["v"]
            for r in c.groupBy("of", "point").agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("v")).collect()
        }
        best = [max(range(points), key=lambda i: (round(means.get((f, i), 0.0), 12), -i)) for f in range(outer)]
    final = logistic.fit_many(data, feats, label, trains, [(outer * inner + f, grid[best[f]]) for f in range(outer)])
    scored = _folds_scored(data, final, "fold", 1).withColumn("score", F.get("scores", F.lit(0)))
    pooled = scored.withColumn("prediction", (F.col("score") > 0.5).cast("double")).withColumn(
        "chosen", F.get(F.array(*[F.lit(b) for b in best]), F.col("fold"))
    )
    stored = training_set(pooled.drop("scores", *[f"inner_{f}" for f in range(outer)]))
    data.unpersist()
    return stored


def fit_params(kind: str, point: dict, n: int) -> dict:
    """Spark's parameters of a grid point that is stated in terms of C, the inverse penalty of a
    summed loss: the mean loss of n rows takes the penalty 1 / (C n)."""
    if kind in ("lr", "svm"):
        return {"regParam": 1.0 / (point["C"] * max(n, 1)), **{k: v for k, v in point.items() if k != "C"}}
    return point


def held_out_grid(
    df: DataFrame, key: str, group: str, kind: str, grid: list[dict], folds: int = 5, label: str = "y",
    parallel: int = 8,
) -> DataFrame:
    """(point, fold, key, label, prediction, score): every row predicted by every grid point, by a
    model of the folds it is not in. A group never spans folds.

    The matrix is stored once. Logistic regressions are fitted all together, forests grow from counts
    of equal rows and share their trees; other fits share nothing else and run side by side, each adding its held-out part to one table, from which every
    metric can be had.
    """
    spark = df.sparkSession
    parts = group_folds(df, group, label, folds).select(group, "fold")
    data = training_set(df.join(parts, group)).cache()
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    if kind == "lr":
        present = sorted(sizes)
        jobs = [
            (at, fit_params(kind, p, sum(n for g, n in sizes.items() if g != f)))
            for at, f in enumerate(present) for p in grid
        ]
        trains = F.array(*[F.col("fold") != f for f in present])
        models = logistic.fit_many(data, list(L.FEATURE_COLUMNS), label, trains, jobs)
        own = data.withColumn("_at", F.array_position(F.array(*[F.lit(f) for f in present]), F.col("fold")) - 1)
        held = _folds_scored(own, models, "_at", len(grid)).select(
            F.posexplode("scores").alias("point", "score"), "fold", key, label
        )
        stored = cut_lineage(
            held.select("point", "fold", key, label, (F.col("score") > 0.5).cast("int").alias("prediction"), "score")
        )
        data.unpersist()
        return stored
    if kind == "rf":
        made = forest.held_out_probabilities(data, list(L.FEATURE_COLUMNS), key, label, grid, sorted(sizes))
        if made is not None:
            held = made.select("fold", key, F.col("y").alias(label), F.posexplode("scores").alias("point", "score"))
            stored = cut_lineage(
                held.select("point", "fold", key, label, (F.col("score") > 0.5).cast("int").alias("prediction"), "score")
            )
            data.unpersist()
            return stored
    path = scratch_path(spark, f"held-out-{kind}")

    def run(job: tuple[int, int]) -> None:
        at, f = job
        params = fit_params(kind, grid[at], sum(n for g, n in sizes.items() if g != f))
        model = estimator(kind, label, **params).fit(data.where(F.col("fold") != f))
        part = score(model, data.where(F.col("fold") == f)).select(
            F.lit(at).alias("point"), "fold", key, label, F.col("prediction").cast("int").alias("prediction"), "score"
        )
        part.coalesce(1).write.parquet(f"{path}/{at}-{f}")  # jobs at one folder would clear each other's work

    jobs = [(at, f) for at in range(len(grid)) for f in sorted(sizes)]
    with ThreadPool(parallel) as pool:
        pool.map(run, jobs, chunksize=1)
    data.unpersist()
    return spark.read.parquet(*[f"{path}/{at}-{f}" for at, f in jobs])


def grid_metrics(held: DataFrame, label: str = "y") -> DataFrame:
    """Pooled accuracy, macro F1 and AUC of each grid point, from the table of predictions."""
    c = held.groupBy("point").agg(*_counts(F.col(label), F.col("prediction")))
    s = binary_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    flat = c.select("point", "tp", "fp", "fn", "tn", s["accuracy"].alias("accuracy"), s["f1_macro"].alias("f1_macro"))
    h = held.groupBy("point", F.round("score", 6).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")
    )
    w = Window.partitionBy("point").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    auc = h.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0))).groupBy("point").agg(
        ratio(
            F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q").cast("double")
        ).alias("auc")
    )
    return flat.join(auc, "point")


class MacroF1(Evaluator):
    """Macro F1 of a binary prediction (Spark's own ``f1`` is class-weighted)."""

    def __init__(self, label: str = "y"):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        return macro_f1(dataset, self.label)

    def isLargerBetter(self) -> bool:
        return True


def _search(train: DataFrame, group: str, kind: str, grid, inner: int, label: str):
    """(best grid position, its model refitted on the whole training part)."""
    if len(grid) == 1:
        return 0, estimator(kind, label, **grid[0]).fit(train)
    folds = group_folds(train, group, label, inner).select(group, F.col("fold").alias("inner"))
    data = training_set(train.join(folds, group)).cache()
    pipe = estimator(kind, label)
    clf = pipe.getStages()[-1]
    cv = CrossValidator(
        estimator=pipe, evaluator=MacroF1(label), numFolds=inner, foldCol="inner", parallelism=4,
        estimatorParamMaps=[{clf.getParam(k): v for k, v in g.items()} for g in grid],
    ).fit(data)
    data.unpersist()
    best = max(range(len(grid)), key=lambda i: (cv.avgMetrics[i], -i))
    return best, cv.bestModel


def permutation_importance(
    model: Model, df: DataFrame, key: str, label: str = "y", repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the macro-F1 drop per feature, in one scoring job.

    Rows get a hash-ordered index; in each repeat a row takes its donor's value of one
    feature, the donor index being an affine permutation of the index.
    """
    feats = list(L.FEATURE_COLUMNS)
    idx = ordered_index(
        df.select(key, label, *feats), [hash_order(key).asc()], F.substring(hash_order(key), 1, 2),
        out="i", total="n",
    )
    n = idx.count()
    rng = random.Random(seed)
    maps = []
    for r in range(repeats):
        a = rng.randrange(1, max(n, 2))
        while math.gcd(a, n) != 1:
            a = a + 1 if a + 1 < n else 1
        maps.append(F.struct(F.lit(r).alias("r"),
                             F.pmod(F.col("i") * F.lit(a) + F.lit(rng.randrange(n)), F.lit(n)).alias("d")))
    donors = idx.select(F.col("i").alias("d"), F.struct(*feats).alias("donor"))
    rep = idx.withColumn("m", F.explode(F.array(*maps))).select("*", "m.r", "m.d").drop("m")
    rep = rep.join(donors, "d").withColumn("feature", F.explode(F.array(*[F.lit(x) for x in feats])))
    for x in feats:
        rep = rep.withColumn(x, F.when(F.col("feature") == x, F.col(f"donor.{x}")).otherwise(F.col(x)))
    base = macro_f1(model.transform(df), label)
    scored = model.transform(rep.drop("donor"))
    c = scored.groupBy("feature", "r").agg(*_counts(F.col(label), F.col("prediction")))
    s = binary_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    drops = c.select("feature", (F.lit(base) - s["f1_macro"]).alias("drop"))
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop")
    )


def scorer_report(df: DataFrame, key: str, label: str = "y", folds: int = 5) -> DataFrame:
    """What is stored beside the deployed scorer, in one row: mean accuracy and AUC of the held-out
    parts of stratified folds, AUC in sample, number of rows, share of positives. The models of all
    parts are fitted together, and one pass scores every row by its fold's model and by that of all rows."""
    feats = list(L.FEATURE_COLUMNS)
    data = training_set(df.join(stratified_folds(df, key, label, folds), key)).cache()
    trains = F.array(*[F.col("fold") != f for f in range(folds)], F.lit(True))
    models = logistic.fit_many(data, feats, label, trains, [(i, {}) for i in range(folds + 1)], balanced=True)
    both = F.array(F.get(logistic.literal(models[:folds]), F.col("fold")), logistic.literal(models[folds:])[0])
    scored = logistic.probabilities(data, feats, both, "scores").select(
        label, F.inline(F.arrays_zip(F.array("fold", F.lit(folds)).alias("point"), F.col("scores").alias("score")))
    )
    # the last point is the model of all rows
    m = grid_metrics(scored.withColumn("prediction", (F.col("score") > 0.5).cast("int")), label)
    held = F.col("point") < folds
    metrics = m.agg(
        F.avg(F.when(held, F.col("accuracy"))).alias("cv_accuracy_mean"),
        F.avg(F.when(held, F.col("auc"))).alias("cv_roc_auc_mean"),
        F.max(F.when(~held, F.col("auc"))).alias("in_sample_roc_auc"),
    )
    sizes = data.agg(F.count(F.lit(1)).alias("n_train"), F.avg(F.col(label).cast("double")).alias("pos_rate"))
    stored = cut_lineage(metrics.crossJoin(sizes))  # single-row tables
    data.unpersist()
    return stored


def linear_scorer(model: PipelineModel, version: str) -> RiskModel:
    """The deployed scorer as one weighted sum over raw features."""
    scaler, fitted = model.stages[1], model.stages[-1]
    std, mean = scaler.std.toArray(), scaler.mean.toArray()
    # a feature of one value is scaled to 0 and has no say
    weights = [float(c / s) if s else 0.0 for c, s in zip(fitted.coefficients.toArray(), std)]
    intercept = float(fitted.intercept) - sum(w * float(m) for w, m in zip(weights, mean))
    return RiskModel(version, tuple(L.FEATURE_COLUMNS), tuple(weights), intercept)


def train_scorer(df: DataFrame, label: str = "y", path: str | None = None) -> PipelineModel:
    """Deployed scorer: standardised logistic regression with balanced class weights."""
    data = balanced_weights(df, label)
    model = estimator("lr", label, weightCol="weight", maxIter=1000).fit(data)
    if path:
        model.write().overwrite().save(path)
    return model
