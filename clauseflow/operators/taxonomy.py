"""Cluster profiles and taxonomy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseflow.operators.windows import top_per_group


def top_values(df: DataFrame, keys: list[str], value: str, k: int, out: str = "top") -> DataFrame:
    """``value=count`` of the k most frequent values per group, ties in value order."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = top_per_group(counts, keys, [F.desc("n"), F.asc(value)], k)
    label = F.concat(F.col(value).cast("string"), F.lit("="), F.col("n").cast("string"))
    ranked = best.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", label.alias("s")))).alias("_a")
    )
    return ranked.select(*keys, F.array_join(F.transform("_a", lambda x: x["s"]), ";").alias(out))
