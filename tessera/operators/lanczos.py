"""Leading eigenpairs of a correlation matrix that is never built (AG11, AG12, AG15).

Block Lanczos on the z-scored rows: a step is one pass that returns Z'(Z Q) / (n - 1)
for a block of p x ``BLOCK`` numbers, summed as a tree over the tasks.  New blocks
are orthogonalised against all earlier ones.  The run ends when every Ritz value
above the noise edge (at least the largest) has a residual of ``TOLERANCE`` of it
and the next one lies below the edge by more than its residual, or when the
blocks span all features.  The driver holds p x (blocks so far) numbers, no task
and no driver a p x p array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.operators.prefixfit import TREE, tree_sum
from tessera.session import share

BLOCK = 64
TOLERANCE = 1e-11
MAX_STEPS = 400


@dataclass
class Signal:
    values: np.ndarray       # descending, the signal block
    vectors: np.ndarray      # columns aligned with values
    q: float
    lambda_plus: float
    prior: np.ndarray        # diagonal of the matrix rebuilt from the signal block
    steps: int


def noise_edge(aspect: float) -> float:
    """Upper edge of the eigenvalues of pure noise.  Fixed formula: (1 + sqrt(p / n))^2."""
    return float((1.0 + aspect ** 0.5) ** 2)


_PART = pa.schema([("bucket", pa.int32()), ("total", pa.list_(pa.float64()))])


def apply_correlation(rows: DataFrame, x: str, mean: np.ndarray, scale: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The correlation matrix of the z-scored rows (missing values at the mean) times ``block``."""
    shared = share(rows.sparkSession, (mean, scale, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, sd, q = shared()
        total = np.zeros_like(q)
        seen = False
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(flat):
                z = (flat.reshape(-1, len(mu)) - mu) / sd
                z[np.isnan(z)] = 0.0
                total += z.T @ (z @ q)
                seen = True
        if seen:
            flat = pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % TREE], pa.int32()), pa.ListArray.from_arrays([0, len(flat)], flat)], schema=_PART)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select(x).coalesce(cores).mapInArrow(run, "bucket int, total array<double>")
    total = tree_sum(parts, [], "total").first()["total"]
    return np.asarray(total).reshape(block.shape) / (n - 1)


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of ``block`` that are not in ``basis``; twice, for rounding."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > 1e-10 * max(size, 1e-300)]


def signal_spectrum(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, n: int, x: str = "x", block: int = BLOCK, seed: int = 42) -> Signal:
    """AG11/AG12: the eigenpairs strictly above the noise edge (at least the largest)
    and the prior of every feature, for ``n`` rows with array column ``x``."""
    p = len(mean)
    aspect = p / n
    edge = noise_edge(aspect)
    new = _orthonormal(np.random.default_rng(seed).standard_normal((p, min(block, p))), np.zeros((p, 0)))
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    for step in range(1, MAX_STEPS + 1):
        moved = apply_correlation(rows, x, mean, scale, n, new)
        basis, image = np.hstack([basis, new]), np.hstack([image, moved])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2.0)
        values, turn = values[::-1], turn[:, ::-1]
        wanted = max(1, int((values > edge).sum()))
        looked = turn[:, :wanted + 1]
        left = np.linalg.norm(image @ looked - basis @ looked * values[:wanted + 1], axis=0)
        resolved = bool((left[:wanted] <= TOLERANCE * np.maximum(values[:wanted], 1.0)).all()
                        and (len(left) == wanted or values[wanted] + left[wanted] < max(edge, values[0])))
        new = np.zeros((p, 0)) if basis.shape[1] >= p else _orthonormal(moved, basis)[:, :p - basis.shape[1]]
        if resolved or not new.shape[1]:
            break
    else:
        raise RuntimeError(f"eigenvalues not resolved after {MAX_STEPS} passes")
    vectors = basis @ turn[:, :wanted]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)] < 0, -1.0, 1.0)
    return Signal(values[:wanted].copy(), vectors, aspect, edge, (vectors * vectors) @ values[:wanted], step)
