"""Resampling and agreement statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clauseflow.functions.scalar import ratio


def cluster_bootstrap(
    counts: DataFrame, group: str, sums: list[str], metrics: dict[str, Column],
    rounds: int = 1000, alpha: float = 0.05,
) -> DataFrame:
    """Cluster bootstrap of metrics that are formulas over additive counts.

    Rows are first folded to one row per group. Each group gets an independent Poisson(1)
    weight in every round, drawn from a hash of both, so resampling needs no join, no order of
    the groups and no group count, and aggregates map-side: one method at every size.
    Result: metric, point, lo, hi.
    """
    per = counts.groupBy(group).agg(*[F.sum(c).cast("double").alias(c) for c in sums])
    sample = per.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    sample = sample.withColumn("_w", poisson_weight(F.col("round"), F.col(group)))
    weight = F.col("_w")
    boot = sample.groupBy("round").agg(*[F.sum(F.col(c) * weight).alias(c) for c in sums])
    lo, hi = alpha / 2, 1 - alpha / 2
    bounds = boot.select(*[m.alias(k) for k, m in metrics.items()]).agg(
        *[F.percentile(k, F.array(F.lit(lo), F.lit(hi))).alias(k) for k in metrics]
    )
    point = per.agg(*[F.sum(c).alias(c) for c in sums]).select(
        *[m.alias(f"{k}_pt") for k, m in metrics.items()]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("metric"), F.round(f"{k}_pt", 6).alias("point"),
                F.round(F.col(k)[0], 6).alias("lo"), F.round(F.col(k)[1], 6).alias("hi"),
            )
            for k in metrics
        ]
    )
    # both sides are single rows
    return point.crossJoin(bounds).select(F.inline(rows))


def poisson_cuts(most: int = 12) -> list[float]:
    """Upper ends of the Poisson(1) classes 0, 1, ..., most - 1."""
    total, cut, ends = 0.0, math.exp(-1.0), []
    for k in range(most):
        total += cut
        ends.append(total)
        cut /= k + 1
    return ends


def poisson_weight(round_: Column, key: Column) -> Column:
    """Poisson(1) weight by inversion of an md5 uniform, which every engine can repeat."""
    h = F.md5(F.concat_ws(":", round_.cast("string"), key.cast("string")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    expr = F.when(F.lit(False), F.lit(0))
    ends = poisson_cuts()
    for k, end in enumerate(ends):
        expr = expr.when(u < end, F.lit(k))
    return expr.otherwise(F.lit(len(ends))).cast("double")


@F.pandas_udf(T.DoubleType())
def chi2_1_tail(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)), na_action="ignore")


def mcnemar(df: DataFrame, gold: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Continuity-corrected McNemar statistics of all model pairs in one aggregation."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok_a, ok_b = F.col(a) == F.col(gold), F.col(b) == F.col(gold)
        aggs += [F.count_if(ok_a & ~ok_b).alias(f"b{i}"), F.count_if(~ok_a & ok_b).alias(f"c{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                F.col(f"b{i}").alias("only_a"), F.col(f"c{i}").alias("only_b"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    t = df.agg(*aggs).select(F.inline(rows))
    diff = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    stat = ratio(diff * diff, F.col("only_a") + F.col("only_b"))
    return t.withColumn("statistic", stat).withColumn("p_value", chi2_1_tail("statistic"))


def fleiss_kappa(df: DataFrame, raters: list[str], positive: str) -> DataFrame:
    """Fleiss kappa of n raters over two categories, in one aggregation."""
    n = len(raters)
    k = sum((F.col(r) == positive).cast("int") for r in raters)
    agree = (k * (k - 1) + (n - k) * (n - k - 1)) / F.lit(float(n * (n - 1)))
    a = df.select(k.alias("k"), agree.alias("p")).agg(
        F.count(F.lit(1)).alias("items"), F.avg("p").alias("p_bar"),
        (F.sum("k") / (F.count(F.lit(1)) * n)).alias("share"),
    )
    pe = F.col("share") ** 2 + (1 - F.col("share")) ** 2
    return a.select(
        "items", F.col("p_bar").alias("observed"), pe.alias("expected"),
        ratio(F.col("p_bar") - pe, 1 - pe).alias("kappa"),
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from the contingency table of two labelings."""
    c2 = lambda x: x * (x - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = lambda d, name: d.agg(F.sum(c2(F.col("n"))).alias(name), F.sum("n").alias(name + "_n"))
    rows = s(cells.groupBy(a).agg(F.sum("n").alias("n")), "sa")
    cols = s(cells.groupBy(b).agg(F.sum("n").alias("n")), "sb")
    both = s(cells, "sab")
    t = both.crossJoin(rows).crossJoin(cols)  # three single-row tables
    expected = ratio(F.col("sa") * F.col("sb"), c2(F.col("sab_n")))
    top = (F.col("sa") + F.col("sb")) / 2
    return t.select(
        F.when(top == expected, F.lit(1.0))
        .otherwise((F.col("sab") - expected) / (top - expected)).alias("ari")
    )


def set_agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Both / only A / only B counts of two membership conditions."""
    return df.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
    )
