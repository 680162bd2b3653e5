"""Many logistic models learned from all rows at once.

Every model has its own penalty, intercept rule and left-out fold. One Spark job gives the loss and the
gradient of all models that are still searching, by matrix products over Arrow batches of the
rows; the limited-memory quasi-Newton steps between the jobs are small and run in the driver. Rows
are read again by every job and never gathered or cached.
"""

from __future__ import annotations

import sys
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from shelfspark.operators.boosting import as_matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMORY = 10        # steps that the quasi-Newton matrix remembers
GRADIENT = 1e-6    # largest gradient entry of a found optimum
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Problem:
    """Mean weighted loss over the rows outside ``fold`` plus ``penalty / 2`` times the squared weights (and
    the squared intercept, if ``penalise_intercept``)."""

    fold: int
    penalty: float
    penalise_intercept: bool = False


def lbfgs(x: np.ndarray, max_iter: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimises a convex function: yields points, is sent (value, gradient), returns the optimum."""
    f, g = yield x
    if not (np.isfinite(f) and np.isfinite(g).all()):
        raise ValueError("feature values must not be NaN or infinite")
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max() <= GRADIENT:
            break
        d, kept = -g, []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            kept.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + (a - y @ d / (s @ y)) * s
        low, high, step = 0.0, np.inf, 1.0 if steps else min(1.0, 1 / np.linalg.norm(g))
        for _ in range(40):
            new = x + step * d
            f_new, g_new = yield new
            if not f_new <= f + 1e-4 * step * (g @ d):
                high = step
            elif g_new @ d < 0.9 * (g @ d):
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        else:
            break  # no better point at this precision
        s, y = new - x, g_new - g
        if s @ y > 0:
            steps = [*steps[1 - MEMORY:], (s, y)]
        x, f, g = new, f_new, g_new
    return x


def losses(rows: DataFrame, problems: Sequence[Problem], points: np.ndarray) -> np.ndarray:
    """(problems, features + 3): gradient by weights and intercept, loss and weight, summed over each problem's rows.
    ``rows``: values (array), label, weight, fold; ``points``: weights, then the intercept."""
    folds, n = np.array([p.fold for p in problems]), points.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), n + 3))
        for b in batches:
            if not b.num_rows:
                continue
            every, label, weight, fold = as_matrix(b.column("values"), n), *[b.column(c).to_numpy() for c in ("label", "weight", "fold")]
            for lo in range(0, len(every), BLOCK_ROWS):
                some = slice(lo, lo + BLOCK_ROWS)
                x, y = every[some], label[some, None]
                own = np.where(fold[some, None] != folds, weight[some, None], 0.0)
                z = x @ points[:, :n].T + points[:, n]
                e = np.exp(-np.abs(z))
                r = own * (np.where(z >= 0, 1.0, e) / (1 + e) - y)
                total[:, :n] += r.T @ x
                total[:, n] += r.sum(axis=0)
                total[:, n + 1] += (own * (np.maximum(z, 0) + np.log1p(e) - y * z)).sum(axis=0)
                total[:, n + 2] += own.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    found = rows.mapInArrow(run, "part bigint, total binary").collect()  # problems x features numbers a task
    return sum((np.frombuffer(bytes(r["total"])).reshape(len(folds), n + 3) for r in sorted(found, key=lambda r: r["part"])), np.zeros((len(folds), n + 3)))


def optima(rows: DataFrame, problems: Sequence[Problem], features: int, max_iter: int) -> list[np.ndarray]:
    """The optimal weights and intercept of each problem, learned from all labelled rows outside its fold."""
    rows = rows.select("values", rows.label.cast("double").alias("label"), rows.weight.cast("double").alias("weight"), rows.fold.cast("int").alias("fold"))
    rows = rows.where("label IS NOT NULL AND weight IS NOT NULL AND fold IS NOT NULL")
    found: list[np.ndarray | None] = [None] * len(problems)
    searches = [lbfgs(np.zeros(features + 1), max_iter) for _ in problems]
    asked = {i: next(s) for i, s in enumerate(searches)}
    while asked:
        sums = losses(rows, [problems[i] for i in asked], np.stack(list(asked.values())))
        more = {}
        for (i, point), of in zip(asked.items(), sums):
            p = problems[i]
            held = np.append(np.full(features, p.penalty), p.penalty * p.penalise_intercept)
            total = of[-1] or 1.0
            try:
                more[i] = searches[i].send((of[-2] / total + 0.5 * (held * point * point).sum(), of[:-2] / total + held * point))
            except StopIteration as done:
                found[i] = done.value
        asked = more
    return found
