"""Random forests of a whole grid at once, from counts of equal binned rows.

All a forest knows of a row are its bins (at most ``BINS`` a feature, cut as Spark's trainer cuts
them: every value where there are few, else equal shares). Rows of equal bins are one cell with its
counts of both labels; the sum of its rows' Poisson bootstrap weights is a Poisson draw of the
count, so a cell grows the same trees as its rows. Spark bins and counts the rows, tasks grow
trees on the cells, Spark adds up the trees' probabilities of each held-out cell.

Trees grow level by level and draw a level's features when they reach it. So a tree of depth 5 is
the tree of depth 30 cut at 5, and the first 100 trees of a forest are the forest of 100: points
that differ in these two only share their trees, and each gets what it gets alone.

Cells go to the tasks as one broadcast. ``cells`` returns None beyond ``MAX_CELLS`` of them; the
caller then takes Spark's trainer, whose rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BINS = 32
MAX_CELLS = 1 << 21
#: Trees grown by one item of work.
TREES = 10
SEED = 42


def cuts(data: DataFrame, features: list[str], folds: list[int]) -> list[list[np.ndarray]]:
    """Per fold and feature the ascending bounds between bins, from the rows outside the fold."""
    of = F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("feature", "value")
    counted = data.select("fold", of).groupBy("fold", "feature", "value").count()
    outside = counted.join(F.broadcast(data.sparkSession.createDataFrame([(f,) for f in folds], "part int")), F.col("part") != F.col("fold"))
    histogram = outside.groupBy("part", "feature", "value").agg(F.sum("count").alias("n"))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        v, n = pdf["value"].to_numpy(), pdf["n"].to_numpy(float)
        middle = (v[1:] + v[:-1]) / 2
        if len(v) > BINS:
            share = np.floor(np.cumsum(n)[:-1] * BINS / n.sum())
            middle = middle[np.diff(share, prepend=0.0) > 0]
        return pd.DataFrame({"part": pdf["part"].iloc[0], "feature": pdf["feature"].iloc[0], "bound": middle})

    got = histogram.groupBy("part", "feature").applyInPandas(bounds, "part int, feature int, bound double").collect()
    out = [[[] for _ in features] for _ in folds]
    for r in got:
        out[folds.index(r["part"])][r["feature"]].append(r["bound"])
    return [[np.sort(np.array(b, float)) for b in part] for part in out]


def binned(data: DataFrame, features: list[str], bounds: list, folds: list[int], key: str, label: str, own: bool) -> DataFrame:
    """(part, cell binary, held, key, y) of each row: for its own fold only, or for every fold."""
    kind = data.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features]
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for at, f in enumerate(folds):
                held = fold == f
                rows = np.flatnonzero(held) if own else np.arange(len(fold))
                bins = np.column_stack([np.searchsorted(b, v[rows]) for b, v in zip(bounds[at], x)]).astype(np.uint8)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * len(features)
                cell = pa.Array.from_buffers(
                    pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(bins.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), at, np.int32)), cell, pa.array(held[rows]),
                     batch.column(key).take(pa.array(rows)), batch.column("y").take(pa.array(rows))],
                    names=["part", "cell", "held", key, "y"],
                )

    rows = data.select(key, F.col("fold").cast("int").alias("fold"), F.col(label).cast("int").alias("y"), *features)
    return rows.mapInArrow(run, f"part int, cell binary, held boolean, {key} {kind}, y int")


def cells(rows: DataFrame, parts: int, width: int) -> list[tuple] | None:
    """Per part (keys, bins, negatives, positives, held) in the order of keys."""
    train = ~F.col("held")
    found = rows.groupBy("part", "cell").agg(
        F.count_if(train & (F.col("y") == 0)).alias("n0"), F.count_if(train & (F.col("y") == 1)).alias("n1"),
        F.bool_or("held").alias("held"),
    )
    table = found.limit(MAX_CELLS + 1).toArrow()
    if table.num_rows > MAX_CELLS:
        return None
    got = table.sort_by([("part", "ascending"), ("cell", "ascending")]).combine_chunks()
    part = got.column("part").to_numpy()
    out = []
    for p in range(parts):
        own = got.slice(int(np.searchsorted(part, p)), int((part == p).sum()))
        keys = own.column("cell").to_pylist()
        bins = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), width)
        out.append((keys, bins, *[own.column(c).to_numpy() for c in ("n0", "n1", "held")]))
    return out


def grow(
    bins: np.ndarray, negative: np.ndarray, positive: np.ndarray, held: np.ndarray,
    rng: np.random.Generator, least: int, depths: list[int],
) -> np.ndarray:
    """Positive probability of each held cell in one tree cut at each depth (ascending).

    ``least`` weights at least go to both sides of a split; ceil(sqrt(features)) features are
    tried at a node, by Gini gain; a split without gain is none.
    """
    neg, pos = rng.poisson(negative), rng.poisson(positive)
    out = np.zeros((len(depths), len(bins)))
    at = np.flatnonzero((neg + pos > 0) | held)
    w, p = (neg + pos)[at], pos[at]
    node = np.zeros(len(at), np.int64)
    count, tried = 1, math.ceil(math.sqrt(bins.shape[1]))
    for depth in range(depths[-1] + 1):
        n, m = np.bincount(node, w, count), np.bincount(node, p, count)
        likely = m / np.maximum(n, 1)
        open_from = sum(d < depth for d in depths)  # the cuts that still see this level
        out[open_from:, at] = likely[node]
        if depth == depths[-1]:
            break
        goes = (n >= 2 * least) & (m > 0) & (m < n)
        if not goes.any():
            break
        number = np.cumsum(goes) - 1
        kept = goes[node]
        at, w, p, node = at[kept], w[kept], p[kept], number[node[kept]]
        n, m, count = n[goes], m[goes], int(goes.sum())
        features = np.argpartition(rng.random((count, bins.shape[1])), tried - 1, axis=1)[:, :tried]
        whole = (m * m + (n - m) ** 2) / n
        best = whole * (1 + 1e-12)
        feature, bound = np.full(count, -1), np.zeros(count, np.int64)
        before_n, before_m = np.cumsum(n) - n, np.cumsum(m) - m
        for j in range(tried):
            key = node * BINS + bins[at, features[node, j]]
            order = np.argsort(key)
            key = key[order]
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            of = key[last] // BINS
            left, hit = np.cumsum(w[order])[last] - before_n[of], np.cumsum(p[order])[last] - before_m[of]
            right, other = n[of] - left, m[of] - hit
            ok = (left >= least) & (right >= least)
            of, last, left, hit, right, other = of[ok], last[ok], left[ok], hit[ok], right[ok], other[ok]
            if not len(of):
                continue
            gain = (hit * hit + (left - hit) ** 2) / left + (other * other + (right - other) ** 2) / right
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            top = np.maximum.reduceat(gain, first)
            better = top > best[of[first]]
            hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(of)))))
            hits = hits[np.unique(of[hits], return_index=True)[1]][better]
            best[of[hits]], feature[of[hits]] = gain[hits], features[of[hits], j]
            bound[of[hits]] = key[last[hits]] % BINS
        split = feature >= 0
        if not split.any():
            break
        number = np.cumsum(split) - 1
        kept = split[node]
        at, w, p, node = at[kept], w[kept], p[kept], node[kept]
        node = 2 * number[node] + (bins[at, feature[node]] > bound[node])
        count = 2 * int(split.sum())
    return out[:, held]


def held_out_probabilities(
    data: DataFrame, features: list[str], key: str, label: str, grid: list[dict], folds: list[int]
) -> DataFrame | None:
    """(fold, key, y, scores) of every row: a probability of each point, by forests of the rows
    outside its fold. ``data`` has a column fold; points give numTrees, maxDepth and
    minInstancesPerNode. None when there are too many cells."""
    spark = data.sparkSession
    bounds = cuts(data, features, folds)
    known = cells(binned(data, features, bounds, folds, key, label, False), len(folds), len(features))
    if known is None:
        return None
    sent = spark.sparkContext.broadcast([k[1:] for k in known])
    items = []
    for part in range(len(folds)):
        for least in sorted({p["minInstancesPerNode"] for p in grid}):
            of = [(i, p) for i, p in enumerate(grid) if p["minInstancesPerNode"] == least]
            sizes = sorted({p["numTrees"] for _, p in of})
            for lo, hi in zip([0, *sizes], sizes):
                points = [(i, p["maxDepth"], p["numTrees"]) for i, p in of if p["numTrees"] >= hi]
                items += [(part, least, a, min(a + TREES, hi), points) for a in range(lo, hi, TREES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in batch.column("id").to_pylist():
                part, least, lo, hi, points = items[i]
                bins, n0, n1, held = sent.value[part]
                sums = total.setdefault(part, np.zeros((len(grid), int(held.sum()))))
                depths = sorted({d for _, d, _ in points})
                for tree in range(lo, hi):
                    made = grow(bins, n0, n1, held, np.random.default_rng([SEED, part, least, tree]), least, depths)
                    for at, depth, trees in points:
                        sums[at] += made[depths.index(depth)] / trees
        for part, sums in total.items():
            where = np.flatnonzero(sent.value[part][3])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(where), part, np.int32)), pa.array(where.astype(np.int32)), *map(pa.array, sums)],
                names=["part", "at", *[f"s{i}" for i in range(len(grid))]],
            )

    tasks = min(len(items), 8 * spark.sparkContext.defaultParallelism)
    grown = spark.range(0, len(items), 1, tasks).mapInArrow(
        run, "part int, at int, " + ", ".join(f"s{i} double" for i in range(len(grid)))
    )
    scores = grown.groupBy("part", "at").agg(F.array(*[F.sum(f"s{i}") for i in range(len(grid))]).alias("scores"))

    names = spark.sparkContext.broadcast([k[0] for k in known])

    @F.arrow_udf("binary")
    def named(part: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([names.value[p][a] for p, a in zip(part.to_pylist(), at.to_pylist())], pa.binary())

    rows = binned(data, features, bounds, folds, key, label, True)
    return rows.join(scores.select("part", named("part", "at").alias("cell"), "scores"), ["part", "cell"]).select(
        F.get(F.array(*[F.lit(f) for f in folds]), F.col("part")).alias("fold"), key, "y", "scores"
    )
