"""Top-k, dedupe, ordered indexes and samples that stay distributed on hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last record per key, as a ``max_by`` with map-side partial aggregation.

    A hot key costs one partial row per task instead of one sorted window.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    )
    return picked.select(*keys, "_r.*")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per group.

    Spark turns ``row_number() <= k`` into a WindowGroupLimit below the shuffle, so each
    task forwards at most k rows per group whatever the group size.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hash_order(*cols: str) -> Column:
    """Deterministic pseudo-random order, the same in any engine with md5."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols]))


def ordered_index(
    df: DataFrame, order: list[Column], bucket: Column, keys: list[str] | None = None,
    out: str = "row_idx", total: str = "n_rows",
) -> DataFrame:
    """0-based position in a total order, without sorting everything in one task.

    ``bucket`` must grow with the order (a coarse prefix of it).  Rows are numbered inside
    their bucket, and bucket offsets come from a small count table.
    """
    keys = keys or []
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys).orderBy("_b") if keys else Window.partitionBy(F.lit(0)).orderBy("_b")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *keys, "_b",
        (F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_off"),
        F.sum("_c").over(whole).alias(total),
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, keys + ["_b"])
        .withColumn(out, F.col("_off") + F.col("_rn") - 1)
        .drop("_b", "_rn", "_off")
    )


def even_buckets(
    df: DataFrame, value: str, tie: str, descending: bool = False, parts: int = 128
) -> Column:
    """Bucket for ``ordered_index`` over (value, tie) with about equal row counts.

    Split points come from approximate percentiles (a bounded sketch).  A value so frequent
    that it is itself a split gets buckets of its own, cut further along ``tie``, so neither
    a crowded range nor one hot value ends up in a single task.
    """
    probs = [i / parts for i in range(1, parts)]
    got = df.agg(
        F.percentile_approx(value, probs, 10_000).alias("v"),
        F.percentile_approx(tie, probs, 10_000).alias("t"),
    ).first()
    v, t = sorted(set(got["v"] or [])), sorted(set(got["t"] or []))

    def below(splits: list, c: str) -> Column:
        if not splits:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(x) for x in splits]), lambda s: s < F.col(c)))

    on_split = F.col(value).isin(v) if v else F.lit(False)
    major = 2 * below(v, value) + on_split.cast("int")
    minor = F.when(on_split, below(t, tie)).otherwise(F.lit(0))
    return F.struct((-major if descending else major).alias("major"), minor.alias("minor"))


def systematic_sample(indexed: DataFrame, n: int, idx: str = "row_idx", total: str = "n_rows") -> DataFrame:
    """Rows at round(i * N / n), half to even, i = 0..n-1; everything when N <= n."""
    step = F.col(total) / F.lit(float(n))
    near = F.floor(F.col(idx) / step)
    hit = F.lit(False)
    # round(i * step) = idx can only hold for i next to idx / step
    for d in (-1, 0, 1, 2):
        i = near + d
        pick = F.least(F.col(total) - 1, F.bround(i * step, 0).cast("long"))
        hit = hit | ((i >= 0) & (i < n) & (pick == F.col(idx)))
    return indexed.where((F.col(total) <= n) | hit)


def dedupe_strongest(df: DataFrame, keys: list[str], score: str, ord_: str) -> DataFrame:
    """Row with the highest score per key; the earliest wins ties."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(ord_))).alias("_r"))
        .select(*keys, "_r.*")
    )


def trailing_count(
    df: DataFrame, key: str, us: str, row_id: str, span: int, out: str = "n_trailing"
) -> DataFrame:
    """Rows of the same key in the trailing span of integer microseconds, ends included.

    The time axis is cut into span-wide slices; each row also appears in the next slice as
    context.  A window then covers one key and slice instead of the whole history of a key,
    so a hot key spreads over as many tasks as it has slices.
    """
    cut = df.withColumn("_s", F.floor(F.col(us) / F.lit(span)))
    both = cut.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("_s", F.col("_s") + F.col("_d"))
    w = Window.partitionBy(key, "_s").orderBy(us).rangeBetween(-span, 0)
    return (
        both.withColumn(out, F.count(F.lit(1)).over(w)).where(F.col("_d") == 0).drop("_s", "_d")
    )
