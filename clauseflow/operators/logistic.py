"""Many penalised logistic regressions at once, by Newton steps over distributed sums.

A trainer that runs one job per iteration and model spends its time on starting jobs. Here all
models of a grid and all training parts share each pass over the rows: a task sums loss, gradient
and second derivatives of every model that is not done yet over its rows, Spark adds the sums, and
the driver solves one small system per model (features + 1 squared, whatever the number of rows).
About ten passes are needed, however many models there are.

The loss is that of Spark's ``LogisticRegression``: mean log loss on features scaled by the
training part's mean and sample deviation, plus ``regParam * (elasticNetParam * |b|_1 +
(1 - elasticNetParam) / 2 * |b|^2)``, the intercept without penalty; a feature of one value has no
say. Its minimum is what Spark's iterations approach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows multiplied at once.
ROWS = 1 << 13
SUMS = "model int, at int, v double"
#: A step that moves no scaled coefficient by more, or one that changes the loss by no larger share
#: of it, ends the search.
CLOSE, GAIN = 1e-9, 1e-12
#: Steps at most, halved ones included; a penalised loss needs about ten.
STEPS = 100
#: Most rounds of coordinate descent in one step.
ROUNDS = 2000


@dataclass
class Fit:
    """One model: its training part, its penalties and how far it is."""

    part: int
    l1: float
    l2: float
    mean: np.ndarray
    scale: np.ndarray
    rows: float
    weights: tuple[float, float] = (1.0, 1.0)
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    best: np.ndarray | None = None
    reached: float = np.inf
    done: bool = False

    def coefficients(self) -> np.ndarray:
        """Intercept and weights of the unscaled features."""
        b = self.best / np.concatenate(([1.0], self.scale))
        b[0] -= b[1:] @ self.mean
        return b


def _sums(df: DataFrame, columns: list[str], body) -> dict[int, np.ndarray]:
    """Per model the sums of the vectors that ``body`` makes of (x, y, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
                parts = batch.column("parts").flatten()
                inside = parts.to_numpy(zero_copy_only=False).astype(bool).reshape(len(y), -1)
                for model, v in body(x, y, inside):
                    total[model] = total[model] + v if model in total else v
        for model, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(v), model, np.int32)),
                    pa.array(np.arange(len(v), dtype=np.int32)),
                    pa.array(v.astype(float)),
                ],
                names=["model", "at", "v"],
            )

    out: dict[int, dict[int, float]] = {}
    for r in df.mapInArrow(run, SUMS).groupBy("model", "at").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault(r["model"], {})[r["at"]] = r["v"]
    return {m: np.array([v[i] for i in range(len(v))]) for m, v in out.items()}


def _steps(h: np.ndarray, g: np.ndarray, b: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """For each model the argument d of least g d + d h d / 2 + l1 |b + d|_1 (intercept first, not
    penalised); coordinate descent goes over all models with ``l1`` together."""
    d = np.zeros_like(b)
    for i in np.flatnonzero(l1 == 0):
        d[i] = -np.linalg.lstsq(h[i], g[i], rcond=1e-12)[0]
    some = np.flatnonzero(l1 > 0)
    for _ in range(ROUNDS):
        if not len(some):
            break
        hs, gs, start, move, moved = h[some], g[some], b[some], d[some], np.zeros(len(some))
        for j in range(b.shape[1]):
            curve = hs[:, j, j]
            ok = curve > 1e-14
            curve = np.where(ok, curve, 1.0)
            slope = gs[:, j] + (hs[:, j] * move).sum(1)
            goal = start[:, j] + move[:, j] - slope / curve
            if j:
                goal = np.sign(goal) * np.maximum(np.abs(goal) - l1[some] / curve, 0.0)
            step = np.where(ok, goal - start[:, j] - move[:, j], 0.0)
            move[:, j] += step
            moved = np.maximum(moved, np.abs(step))
        d[some] = move
        some = some[moved >= CLOSE / 10]
    return d


def fit_many(
    data: DataFrame, features: list[str], label: str, parts, jobs: list[tuple[int, dict]], balanced: bool = False
) -> list[np.ndarray]:
    """Intercept and weights of each job (number of its training part, Spark's parameters).

    ``parts`` is a column array<boolean>: which training parts a row is in.
    """
    rows = data.select(*features, F.col(label).alias("y"), parts.alias("parts"))
    k = len(features)

    def first(x, y, inside):
        for s in range(inside.shape[1]):
            m = inside[:, s]
            yield s, np.concatenate(([m.sum(), y[m].sum()], x[m].sum(0)))

    sizes = _sums(rows, features, first)
    means = {s: v[2:] / v[0] for s, v in sizes.items() if v[0]}

    def second(x, y, inside):
        for s, mean in means.items():
            yield s, ((x[inside[:, s]] - mean) ** 2).sum(0)

    spread = _sums(rows, features, second)
    fits = []
    for s, p in jobs:
        n, positive = sizes[s][:2]
        deviation = np.sqrt(spread[s] / max(n - 1, 1))
        penalty, mixed = p.get("regParam", 0.0), p.get("elasticNetParam", 0.0)
        weights = (1.0, 1.0)
        if balanced:
            weights = (n / (2 * (n - positive)) if n > positive else 1.0, n / (2 * positive) if positive else 1.0)
        fits.append(
            Fit(s, penalty * mixed, penalty * (1 - mixed), means[s], np.where(deviation > 0, deviation, np.inf), n,
                weights, np.zeros(k + 1))
        )
    for _ in range(STEPS):
        going = {i: (f.part, f.at, f.mean, f.scale, f.weights) for i, f in enumerate(fits) if not f.done}
        if not going:
            break

        def derivatives(x, y, inside):
            last, z, t = None, None, None
            for i, (s, b, mean, scale, weights) in sorted(going.items(), key=lambda e: e[1][0]):
                if s != last:
                    m = inside[:, s]
                    z = np.column_stack((np.ones(int(m.sum())), (x[m] - mean) / scale))
                    t, last = y[m], s
                w = np.where(t > 0, weights[1], weights[0])
                u = z @ b
                p = np.exp(-np.logaddexp(0, -u))
                loss = (w * (np.logaddexp(0, u) - t * u)).sum()
                yield i, np.concatenate(([loss], z.T @ (w * (p - t)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()))

        turn = []
        for i, v in _sums(rows, features, derivatives).items():
            f = fits[i]
            b = f.at
            reached = v[0] / f.rows + f.l1 * np.abs(b[1:]).sum() + f.l2 / 2 * (b[1:] ** 2).sum()
            gain = np.inf if f.best is None else f.reached - reached
            f.done = bool(abs(gain) <= GAIN * reached)
            if gain < 0:  # too long a step
                f.at = (b + f.best) / 2
                continue
            g, h = v[1 : k + 2] / f.rows, v[k + 2 :].reshape(k + 1, k + 1) / f.rows
            g[1:] += f.l2 * b[1:]
            h[np.arange(1, k + 1), np.arange(1, k + 1)] += f.l2
            f.best, f.reached = b, reached
            turn.append((f, h, g))
        if turn:
            moves = _steps(*map(np.stack, ([h for _, h, _ in turn], [g for _, _, g in turn], [f.best for f, _, _ in turn])),
                           np.array([f.l1 for f, _, _ in turn]))
            for (f, _, _), step in zip(turn, moves):
                f.at = f.best + step
                f.done |= bool(np.abs(step).max() < CLOSE)
    return [f.coefficients() for f in fits]


def probabilities(data: DataFrame, features: list[str], models, out: str = "score") -> DataFrame:
    """Rows with ``out``, an array<double> of positive probabilities: ``models(row columns)`` is an
    array of arrays (intercept, weights)."""

    def one(m):
        u = F.get(m, F.lit(0))
        for i, c in enumerate(features):
            u = u + F.get(m, F.lit(i + 1)) * F.col(c)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-u))

    return data.withColumn(out, F.transform(models, one))


def literal(models: list[np.ndarray]):
    """Coefficients as an array column."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in models])
