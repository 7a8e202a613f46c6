from __future__ import annotations

import random

import numpy as np
import pytest

from clauseflow import lexicon as L
from clauseflow.operators import forest as FO
from clauseflow.operators import ml as ML


def _rows(spark, n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(2 + 3 * j)) for j in range(len(L.FEATURE_COLUMNS))]
        rows.append((i, f"g{i % 30}", int(x[16] + x[15] > 45 or rng.random() < 0.05), *x))
    return spark.createDataFrame(rows, ["doc_id", "g", "y", *L.FEATURE_COLUMNS])


def _grid(trees, depths, least):
    return [{"numTrees": t, "maxDepth": d, "minInstancesPerNode": m} for t in trees for d in depths for m in least]


def test_forests_of_a_grid_in_few_jobs_are_those_of_single_points(spark):
    df = _rows(spark)
    grid = _grid((20, 40), (2, 6), (2, 5))
    spark.sparkContext.setJobGroup("forests", "forests")
    held = ML.held_out_grid(df, "doc_id", "g", "rf", grid, folds=3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forests"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 50
    got = {(r.point, r.doc_id): r for r in held.collect()}
    assert len(got) == held.count() == 400 * len(grid)
    folds = {r.g: r.fold for r in ML.group_folds(df, "g", "y", 3).collect()}
    assert all(r.fold == folds[f"g{r.doc_id % 30}"] for r in got.values())
    for at in (0, 7):
        for r in ML.held_out_grid(df, "doc_id", "g", "rf", [grid[at]], folds=3).collect():
            assert got[at, r.doc_id].score == pytest.approx(r.score, abs=1e-12)
    # Spark's own forests are right about as often
    own = df.join(ML.group_folds(df, "g", "y", 3), "g").cache()
    right = 0
    for f in range(3):
        model = ML.estimator("rf", "y", **grid[7]).fit(own.where(f"fold != {f}"))
        right += ML.score(model, own.where(f"fold = {f}")).where("prediction = y").count()
    mine = sum(got[7, i].prediction == got[7, i].y for i in range(400))
    assert mine > 330 and abs(mine - right) <= 25


def test_forests_with_too_many_cells_are_fitted_by_spark(spark, monkeypatch):
    df = _rows(spark, 90)
    grid = _grid((3,), (2,), (2,))
    monkeypatch.setattr(FO, "MAX_CELLS", 10)
    assert ML.held_out_grid(df, "doc_id", "g", "rf", grid, folds=2).count() == 90


def test_a_tree_of_one_feature_equals_plain_recursion():
    rng = np.random.default_rng(4)
    bins = np.arange(20, dtype=np.uint8)[:, None]
    neg, pos = rng.integers(0, 9, 20), rng.integers(0, 9, 20)
    held = np.ones(20, bool)
    for least, depths in ((1, [0, 1, 2, 3]), (6, [1, 9])):
        got = FO.grow(bins, neg, pos, held, np.random.default_rng(7), least, depths)
        draw = np.random.default_rng(7)
        a, b = draw.poisson(neg), draw.poisson(pos)

        def plain(lo, hi, depth):
            n, m = (a + b)[lo:hi].sum(), b[lo:hi].sum()
            best, cut = (m * m + (n - m) ** 2) / n * (1 + 1e-12), None
            for c in range(lo + 1, hi):
                ln, lm = (a + b)[lo:c].sum(), b[lo:c].sum()
                if min(ln, n - ln) >= least:
                    gain = (lm**2 + (ln - lm) ** 2) / ln + ((m - lm) ** 2 + (n - ln - m + lm) ** 2) / (n - ln)
                    if gain > best and (a + b)[c - 1]:
                        best, cut = gain, c
            if depth == 0 or cut is None:
                return [m / n] * (hi - lo)
            return plain(lo, cut, depth - 1) + plain(cut, hi, depth - 1)

        for i, d in enumerate(depths):
            assert got[i] == pytest.approx(plain(0, 20, d))


def test_bounds_keep_every_value_or_equal_shares(spark):
    rows = [(i, i % 2, float(i % 3), float(i)) for i in range(2000)]
    data = spark.createDataFrame(rows, "i int, fold int, few double, many double")
    few, many = FO.cuts(data, ["few", "many"], [0, 1])[0]
    assert few.tolist() == [0.5, 1.5]
    assert len(many) == FO.BINS - 1 and np.ptp(np.diff(many)) <= 4
