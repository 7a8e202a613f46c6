"""Dimension reduction and density clustering on vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from clauseflow.session import cut_lineage

AXES = 4
#: Points of a block at most, and of a tile of a block.
BLOCK, TILE = 65_536, 192
#: Points of a block in small tables, which are cut for the cores.
LEAST_BLOCK = 2000


def _components(df: DataFrame, vector: str, k: int):
    """Principal directions: the covariance (d x d) is summed in the tasks."""
    v = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v)


def reduce_dims(df: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """Linear reduction to k components; the first m of them are the reduction to m.

    A component's sign is free: here its largest loading is positive.
    """
    loadings = _components(df, vector, k).pc.toArray()
    flips = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    parts = [_projection(F.col(vector), loadings[:, i] * flips[i]) for i in range(k)]
    return df.select(key, F.array(*parts).alias("components"))


def _projection(vec: Column, axis: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(x)) for x in axis])
    return F.aggregate(
        F.zip_with(vec, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x
    )


def _blocked(points: DataFrame, dim: int, eps: float, n: int) -> DataFrame:
    """(block, id, v, weight, p0…): near points in blocks of about one size.

    Points are put in the order of their cells of eps along the directions in which they differ
    most, and the range is cut evenly; equal cells are cut by a hash of the id.
    """
    k = min(AXES, dim)
    axes = _components(points, "v", k).pc.toArray().T
    cores = points.sparkSession.sparkContext.defaultParallelism
    size = min(BLOCK, max(LEAST_BLOCK, math.ceil(n / math.sqrt(8 * cores))))
    placed = points.select("*", *[_projection(F.col("v"), a).alias(f"p{i}") for i, a in enumerate(axes)])
    cells = [F.floor(F.col(f"p{i}") / F.lit(eps)) for i in range(k)]
    dealt = placed.repartitionByRange(math.ceil(n / size), *cells, F.xxhash64("id"))
    return cut_lineage(dealt.withColumn("block", F.spark_partition_id()))


def _block_pairs(points: DataFrame, eps: float) -> DataFrame:
    """Rows (l, r, side, id, v, weight) of every pair of blocks that can hold two near points."""
    axes = [c for c in points.columns if c[0] == "p"]
    boxes = points.groupBy("block").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max)])
    left, right = boxes.alias("a"), boxes.alias("b")
    gap = F.lit(0.0)
    for c in axes:
        apart = F.greatest(F.col(f"a.min_{c}") - F.col(f"b.max_{c}"), F.col(f"b.min_{c}") - F.col(f"a.max_{c}"), F.lit(0.0))
        gap = gap + apart * apart
    # what rounding can do to a projection is far below the slack
    near = left.join(right, (F.col("a.block") <= F.col("b.block")) & (gap <= eps * eps + 1e-6))
    pairs = cut_lineage(near.select(F.col("a.block").alias("l"), F.col("b.block").alias("r")))
    keep = ["l", "r", "side", "id", "v", "weight"]
    as_left = points.join(F.broadcast(pairs), points["block"] == pairs["l"]).withColumn("side", F.lit(0))
    other = pairs.where("l < r")
    as_right = points.join(F.broadcast(other), points["block"] == other["r"]).withColumn("side", F.lit(1))
    # a task for about one pair: in a few large ones the sort before the groups would spill
    return as_left.select(*keep).unionByName(as_right.select(*keep)).repartition(max(1, pairs.count()), "l", "r")


class _Side:
    """Points of a block, turned into the given directions and sorted into tiles of near ones."""

    def __init__(self, rows: pa.Table, centre: np.ndarray, turn: np.ndarray):
        self.ids, self.weight = rows["id"].to_numpy(), rows["weight"].to_numpy()
        turned = ((_vectors(rows) - centre) @ turn)
        order, cuts = [], [0]
        todo = [np.arange(len(turned))]
        while todo:
            some = todo.pop()
            if len(some) > TILE:
                x = turned[some]
                x = x[:, np.ptp(x, axis=0).argmax()]
                half = np.argpartition(x, len(some) // 2)
                todo += [some[half[: len(some) // 2]], some[half[len(some) // 2 :]]]
            else:
                order.append(some)
                cuts.append(cuts[-1] + len(some))
        at = np.concatenate(order)
        self.ids, self.weight, self.exact, self.cuts = self.ids[at], self.weight[at], turned[at], np.array(cuts)
        self.norm = (self.exact**2).sum(1)
        self.low = np.minimum.reduceat(self.exact, self.cuts[:-1])
        self.high = np.maximum.reduceat(self.exact, self.cuts[:-1])


def _vectors(rows: pa.Table) -> np.ndarray:
    column = rows["v"].combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sides(rows: pa.Table) -> tuple[_Side, _Side | None]:
    """The two blocks of a pair; one if it is a block with itself."""
    parts = [rows.filter(pc.equal(rows["side"], s)) for s in (0, 1)]
    v = _vectors(rows)
    centre = v.mean(0)
    turn = np.linalg.eigh((v - centre).T @ (v - centre))[1]
    one, two = (_Side(p, centre, turn) if p.num_rows else None for p in parts)
    return one, two


def _true_places(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` for few true values: eight of them are looked at together."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    inside = np.flatnonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[inside // 8] * 8 + inside % 8, whole + np.flatnonzero(flat[whole:])])


def _near(a: _Side, b: _Side, eps: float, skip=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near points in a and in b; each pair of one block once, no point with itself.

    Distances come from single precision; those close to the limit are computed again. ``skip``
    tells of a tile of a which tiles of b need no look.
    """
    limit, own = eps * eps + 1e-9, a is b
    left = np.hstack([-2 * a.exact, a.norm[:, None], np.ones((len(a.ids), 1))]).astype("f4")
    right = np.hstack([b.exact, np.ones((len(b.ids), 1)), b.norm[:, None]]).astype("f4")
    widths, far = np.diff(b.cuts), b.norm.max()
    for t, (lo, hi) in enumerate(zip(a.cuts, a.cuts[1:])):
        gap = np.maximum(np.maximum(b.low - a.high[t], a.low[t] - b.high), 0)
        met = (gap * gap).sum(1) <= limit + 1e-9
        if own:
            met[:t] = False
        if skip is not None:
            met &= ~skip(t)
        doubt = 4e-6 * (a.norm[lo:hi].max() + far) + 1e-8
        columns = np.flatnonzero(np.repeat(met, widths))
        for at in range(0, len(columns), 2048):
            some = columns[at : at + 2048]
            d2 = left[lo:hi] @ right[some].T
            found = _true_places(d2 <= np.float32(limit + doubt))
            d2 = d2.ravel()[found]
            i, j = np.divmod(found, len(some))
            i, j = i + lo, some[j]
            sure = d2 <= limit - doubt
            close = np.flatnonzero(~sure)
            for c in range(0, len(close), 2000):
                c = close[c : c + 2000]
                sure[c] = ((a.exact[i[c]] - b.exact[j[c]]) ** 2).sum(1) <= limit
            if own:
                sure &= i < j
            if sure.any():
                yield i[sure], j[sure]


def _near_weights(eps: float):
    def count(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        own = b is None
        b = a if own else b
        n_a, n_b = (a.weight.astype("i8") if own else np.zeros(len(a.ids), "i8")), np.zeros(len(b.ids), "i8")
        for i, j in _near(a, b, eps):
            n_a += np.bincount(i, b.weight[j], len(n_a)).astype("i8")
            n_b += np.bincount(j, a.weight[i], len(n_b)).astype("i8")
        ids, n = np.concatenate([a.ids, b.ids]), np.concatenate([n_a, n_b])
        return pa.table({"id": ids[n > 0], "n": n[n > 0]})

    return count


def _joined(eps: float):
    """Edges from each point to the first one of its part of the two blocks."""

    def join(rows: pa.Table) -> pa.Table:
        a, b = _sides(rows)
        shift = 0 if b is None else len(a.ids)
        b = a if b is None else b
        ids = a.ids if b is a else np.concatenate([a.ids, b.ids])
        part = np.arange(len(ids))

        def joined(t: int) -> np.ndarray:
            """Tiles of b that lie, as tile t of a does, in one part already."""
            mine, theirs = part[a.cuts[t] : a.cuts[t + 1]], part[shift:]
            first = theirs[b.cuts[:-1]]
            return np.logical_and.reduceat(theirs == np.repeat(first, np.diff(b.cuts)), b.cuts[:-1]) & (first == mine[0]) & (mine == mine[0]).all()

        for i, j in _near(a, b, eps, joined):
            i, j = part[i], part[j + shift]
            apart = i != j
            if not apart.any():
                continue
            root = {}

            def find(x: int) -> int:
                while x in root:
                    x = root[x]
                return x

            links = np.unique(np.minimum(i, j)[apart] * len(ids) + np.maximum(i, j)[apart])
            for x, y in zip((links // len(ids)).tolist(), (links % len(ids)).tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            moved = np.arange(len(ids))
            for x in root:
                moved[x] = find(x)
            part = moved[part]
        some = np.flatnonzero(part != np.arange(len(ids)))
        return pa.table({"a": ids[some], "b": ids[part[some]]})

    return join


def density_clusters(
    df: DataFrame, key: str, vector: str, dim: int, eps: float,
    min_samples: int = 5, min_cluster_size: int = 5,
) -> DataFrame:
    """Density clusters at a fixed radius: (key, cluster_id), noise = -1.

    A point is core when at least ``min_samples`` points (itself included) lie within eps;
    core points within eps of each other share a cluster; small clusters become noise.
    Equal vectors are folded to one weighted point first.  A pair of blocks returns
    neighbour counts and the parts that hang together, never its neighbour pairs.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    folded = rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    stored = cut_lineage(folded.select("id", "v", "weight"))
    points = _blocked(stored, dim, eps, stored.count())
    near = _block_pairs(points, eps).groupBy("l", "r").applyInArrow(_near_weights(eps), "id long, n long")
    core = near.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id")
    core_points = cut_lineage(points.join(core, "id", "left_semi"))
    edges = _block_pairs(core_points, eps).groupBy("l", "r").applyInArrow(_joined(eps), "a long, b long")
    labels = connected_components(core_points.select("id"), edges)
    # sizes count every original row of a folded point
    member = rows.join(stored.select("v", F.col("id").alias("rep")), "v")
    tagged = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    big = (
        tagged.where(F.col("component").isNotNull()).groupBy("component")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cluster_size).select("component")
        .withColumn("ok", F.lit(True))
    )
    out = tagged.join(big, "component", "left")
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("ok"), F.col("component")).otherwise(F.lit(-1).cast("long")).alias("cluster_id"),
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with component = smallest id, by alternating star contractions.

    Each round links every node to the smallest neighbour it knows, which flattens long
    chains in a logarithmic number of rounds; lineage is cut by a reliable checkpoint.
    """
    e = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )
    while True:  # every round but the last merges something
        before = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = _small_star(_large_star(e))
        e = cut_lineage(e)
        after = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == after:
            break
    return nodes.join(e.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where(
        F.col("u") != F.col("v")
    ).distinct()
