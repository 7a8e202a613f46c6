"""Quality metrics as column formulas over additive counts, and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseflow import lexicon as L
from clauseflow.functions.scalar import ratio

POS, NEG = L.POSITIVE, L.NEGATIVE


def prf(matched: Column, gold: Column, pred: Column) -> dict[str, Column]:
    """Precision, recall and F1; zero denominators give 0."""
    p, r = ratio(matched, pred), ratio(matched, gold)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def binary_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, per-class and macro F1, Cohen's kappa from a confusion table."""
    n = tp + fp + fn + tn
    acc = ratio(tp + tn, n)
    f1_pos = prf(tp, tp + fn, tp + fp)["f1"]
    f1_neg = prf(tn, tn + fp, tn + fn)["f1"]
    gold_pos, pred_pos = ratio(tp + fn, n), ratio(tp + fp, n)
    expected = gold_pos * pred_pos + (1 - gold_pos) * (1 - pred_pos)
    return {
        "accuracy": acc,
        "f1_pos": f1_pos,
        "f1_neg": f1_neg,
        "f1_macro": (f1_pos + f1_neg) / 2,
        "kappa": ratio(acc - expected, 1 - expected),
    }


def confusion(gold: Column, pred: Column) -> list[Column]:
    return [
        F.count_if((gold == POS) & (pred == POS)).alias("tp"),
        F.count_if((gold == NEG) & (pred == POS)).alias("fp"),
        F.count_if((gold == POS) & (pred == NEG)).alias("fn"),
        F.count_if((gold == NEG) & (pred == NEG)).alias("tn"),
    ]


def with_pooled(df: DataFrame, by: str, aggs: list[Column], pooled: str = "pooled") -> DataFrame:
    """Aggregate per group and over all rows in one pass (grouping sets)."""
    return (
        df.rollup(by)
        .agg(F.grouping(by).alias("_all"), *aggs)
        .withColumn(by, F.when(F.col("_all") == 1, F.lit(pooled)).otherwise(F.col(by).cast("string")))
        .drop("_all")
    )


def rounded(cols: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in cols.items()]


def fact_pr(records: DataFrame, by: str = "stratum", mode: str = "specific") -> DataFrame:
    """Fact precision, recall, F1 over gold-positive episodes, per group and pooled."""
    suffix = {"specific": "_specific", "all": ""}[mode]
    pos = records.where(F.col("verdict") == POS)
    agg = with_pooled(
        pos,
        by,
        [
            F.sum(f"matched{suffix}").alias("matched"),
            F.sum(f"n_gold{suffix}").alias("gold"),
            F.sum(f"n_pred{suffix}").alias("pred"),
            F.count(F.lit(1)).alias("episodes"),
        ],
    )
    return agg.select(
        by, "episodes", "matched", "gold", "pred",
        *rounded(prf(F.col("matched"), F.col("gold"), F.col("pred"))),
    )


def episode_metrics(records: DataFrame, pred: str, by: str = "stratum") -> DataFrame:
    """Confusion counts and episode-level scores per group and pooled."""
    agg = with_pooled(records, by, confusion(F.col("verdict"), F.col(pred)))
    c = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    return agg.select(by, "tp", "fp", "fn", "tn", *rounded(binary_scores(*c)))


def positional(df: DataFrame, by: list[str], value: str, marks: dict[str, Column]) -> DataFrame:
    """Order statistics at 1-based positions (``marks`` maps a name to a column over ``n``).

    Values are counted first; the running count then goes over the distinct values of each
    group, so a hot group costs one row per distinct value.  Callers round the value, which
    bounds that number.
    """
    from pyspark.sql import Window

    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    run = counted.withColumn("hi", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("lo", F.col("hi") - F.col("c"))
    run = run.withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    picks = [
        F.max(F.when((pos > F.col("lo")) & (pos <= F.col("hi")), F.col(value))).alias(name)
        for name, pos in marks.items()
    ]
    return run.groupBy(*by).agg(F.sum("c").alias("n"), *picks)


def floor_rank(q_num: int, q_den: int) -> Column:
    """Position of sorted[n * q_num // q_den] (0-based index, made 1-based)."""
    return F.floor(F.col("n") * q_num / q_den) + 1


def ceil_rank(q: float) -> Column:
    return F.ceil(F.col("n") * F.lit(q))
