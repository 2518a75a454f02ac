"""Balanced L2 logistic regressions of many nested feature sets at once (ML10).

All feature counts of a fold are prefixes of one ordered, standardised block, so
one pass over the rows serves every (fold, count): Newton's method on

    sum of w * loss + |coefficients|^2 / (2 C),  the intercept free,

where a pass returns loss, gradient and curvature of all fits that are not at
their optimum yet.  Counts are taken in groups whose curvature fits ``GROUP_BYTES``;
a group starts from the largest fit of the one before.  Sums are merged as a tree:
per core, per bucket of cores, in all.  Rows stay where they are, the driver holds
one group's sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import share

GROUP_BYTES = 64 << 20
BLOCK_ROWS = 4096
TREE = 32
MAX_PASSES = 200
#: Half the squared Newton decrement, as a share of the objective, at which a fit is at its optimum.
TOLERANCE = 1e-15

Key = tuple[int, int]  # fold, feature count


@dataclass
class Fold:
    """Order, mean and scale of the features of one fold (each in feature order),
    and the weights of its training rows by class."""
    number: int
    order: list[int]
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[float, float]


def tree_sum(parts: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Sums of array column ``vector`` per key; with more than ``TREE`` cores, so that
    many parts, over a bucket of the tasks first."""
    if parts.sparkSession.sparkContext.defaultParallelism <= TREE:
        return parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector(vector))).alias(vector))
    first = parts.groupBy(*keys, "bucket").agg(Summarizer.sum(array_to_vector(vector)).alias("s"))
    return first.groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("s"))).alias(vector))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _standardised(x: np.ndarray, fold: Fold, width: int) -> np.ndarray:
    """An intercept column and the first ``width`` features in order, missing values at the mean."""
    at = np.asarray(fold.order[:width])
    z = (x[:, at] - fold.mean[at]) / fold.scale[at]
    return np.hstack([np.ones((len(x), 1)), np.where(np.isnan(z), 0.0, z)])


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * margin))


def _coefficients(betas: dict[Key, np.ndarray], fold: int) -> tuple[list[int], np.ndarray]:
    sizes = sorted(m for f, m in betas if f == fold)
    out = np.zeros((max(sizes, default=0) + 1, len(sizes)))
    for k, m in enumerate(sizes):
        out[:m + 1, k] = betas[fold, m]
    return sizes, out


def _sums(rows: DataFrame, folds: list[Fold], betas: dict[Key, np.ndarray]) -> dict[Key, tuple[float, np.ndarray, np.ndarray]]:
    """Weighted loss, gradient and curvature of every fit at ``betas``, in one pass over
    rows(x, y, sets)."""
    shared = share(rows.sparkSession, ([f for f in folds if any(n == f.number for n, _ in betas)], betas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, at = shared()
        held: dict[Key, np.ndarray] = {}
        for batch in batches:
            x, y, sets = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float), _matrix(batch.column(2))
            for fold in active:
                sizes, beta = _coefficients(at, fold.number)
                mine = np.flatnonzero(sets[:, fold.number] == 1)
                for start in range(0, len(mine), BLOCK_ROWS):
                    some = mine[start:start + BLOCK_ROWS]
                    z, label = _standardised(x[some], fold, sizes[-1]), y[some][:, None]
                    w = np.where(label == 1, fold.weights[1], fold.weights[0])
                    margin = z @ beta
                    p = _sigmoid(margin)
                    loss = (w * (np.logaddexp(0.0, margin) - label * margin)).sum(axis=0)
                    gradient = z.T @ (w * (p - label))
                    curve = w * p * (1.0 - p)
                    for k, m in enumerate(sizes):
                        part = z[:, :m + 1]
                        h = part.T @ (part * curve[:, k:k + 1])
                        total = np.concatenate([[loss[k]], gradient[:m + 1, k], h[np.triu_indices(m + 1)]])
                        key = (fold.number, m)
                        held[key] = held[key] + total if key in held else total
        bucket = TaskContext.get().partitionId() % TREE
        for (f, m), total in held.items():
            yield pa.RecordBatch.from_pydict({"fold": [f], "m": [m], "bucket": [bucket], "total": pa.ListArray.from_arrays([0, len(total)], pa.array(total))},
                                             schema=_PARTIAL)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("x", "y", "sets").coalesce(cores).mapInArrow(run, "fold int, m int, bucket int, total array<double>")
    out = {}
    for r in tree_sum(parts, ["fold", "m"], "total").collect():
        n, total = r["m"] + 1, np.asarray(r["total"])
        h = np.zeros((n, n))
        h[np.triu_indices(n)] = total[1 + n:]
        out[r["fold"], r["m"]] = (total[0], total[1:1 + n], h + np.triu(h, 1).T)
    return out


_PARTIAL = pa.schema([("fold", pa.int32()), ("m", pa.int32()), ("bucket", pa.int32()), ("total", pa.list_(pa.float64()))])


class _Newton:
    """One fit: the accepted point, the step being tried, and its length."""

    def __init__(self, start: np.ndarray, ridge: float):
        self.ridge = np.concatenate([[0.0], np.full(len(start) - 1, ridge)])
        self.beta, self.step, self.length = start, np.zeros_like(start), 1.0
        self.value, self.done = np.inf, False

    def trial(self) -> np.ndarray:
        return self.beta + self.length * self.step

    def see(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        here = self.trial()
        value = loss + 0.5 * float(self.ridge @ (here * here))
        if value > self.value + 1e-11 * abs(self.value):
            self.length *= 0.5
            return
        slope = gradient + self.ridge * here
        self.beta, self.value, self.length = here, value, 1.0
        self.step = -np.linalg.solve(curvature + np.diag(self.ridge), slope)
        if -0.5 * float(slope @ self.step) <= TOLERANCE * (1.0 + abs(value)):
            self.beta, self.done = here + self.step, True


def size_groups(sizes: Sequence[int], n_folds: int, group_bytes: int = GROUP_BYTES) -> list[list[int]]:
    """Ascending sizes in groups whose curvature sums fit ``group_bytes`` (one size at least)."""
    groups: list[list[int]] = []
    used = group_bytes + 1
    for m in sorted(set(sizes)):
        need = n_folds * 4 * (m + 1) * (m + 2)
        if used + need > group_bytes:
            groups.append([])
            used = 0
        groups[-1].append(m)
        used += need
    return groups


def fit_prefixes(rows: DataFrame, folds: list[Fold], sizes: Sequence[int], c: float = 1.0,
                 group_bytes: int = GROUP_BYTES) -> dict[Key, np.ndarray]:
    """Intercept and coefficients (in the fold's order) of every (fold, size).

    ``rows``: x (array<double>), y (0/1), sets (array<int>, 1 where the row trains
    the fold of that place).  Raises where an optimum is not reached."""
    out: dict[Key, np.ndarray] = {}
    start = {f.number: np.zeros(1) for f in folds}
    for group in size_groups(sizes, len(folds), group_bytes):
        fits = {(f.number, m): _Newton(np.concatenate([start[f.number], np.zeros(m + 1 - len(start[f.number]))]), 1.0 / c)
                for f in folds for m in group}
        for _ in range(MAX_PASSES):
            open_ = {k: v for k, v in fits.items() if not v.done}
            if not open_:
                break
            sums = _sums(rows, folds, {k: v.trial() for k, v in open_.items()})
            for k, v in open_.items():
                v.see(*sums[k])
        else:
            raise RuntimeError(f"no optimum after {MAX_PASSES} passes")
        out |= {k: v.beta for k, v in fits.items()}
        start = {f.number: out[f.number, group[-1]] for f in folds}
    return out


def score_prefixes(rows: DataFrame, folds: list[Fold], betas: dict[Key, np.ndarray]) -> DataFrame:
    """(fold, m, y, p): scores of the rows with 0 in ``sets`` by every fit of the fold."""
    shared = share(rows.sparkSession, (folds, betas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = shared()
        for batch in batches:
            x, y, sets = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            for fold in held:
                sizes, beta = _coefficients(at, fold.number)
                mine = np.flatnonzero(sets[:, fold.number] == 0)
                for start in range(0, len(mine), BLOCK_ROWS):
                    some = mine[start:start + BLOCK_ROWS]
                    p = _sigmoid(_standardised(x[some], fold, sizes[-1]) @ beta)
                    n = len(some) * len(sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fold.number, np.int32)), pa.array(np.tile(np.array(sizes, np.int32), len(some))),
                                                      pa.array(np.repeat(y[some].astype(np.int32), len(sizes))), pa.array(p.ravel())], ["fold", "m", "y", "p"])

    return rows.select("x", "y", "sets").mapInArrow(run, "fold int, m int, y int, p double")


def train_weights(rows: DataFrame, n_folds: int) -> list[tuple[float, float]]:
    """Balanced class weights n / (2 n_c) of the training rows of every fold, in one aggregation."""
    member = [F.col("sets")[k] == 1 for k in range(n_folds)]
    counts = rows.agg(*[F.count_if(s & (F.col("y") == c)).alias(f"n{k}_{c}") for k, s in enumerate(member) for c in (0, 1)]).first()
    out = []
    for k in range(n_folds):
        n0, n1 = counts[f"n{k}_0"], counts[f"n{k}_1"]
        if not n0 or not n1:
            raise ValueError(f"training rows of fold {k} have one class only")
        out.append(((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)))
    return out
