"""Extremely randomised trees (ML5), grown level by level over distributed rows.

All trees grow together.  At every open node a random subset of the features is
tried, each at one threshold drawn uniformly between the node's smallest and
largest value; the draw depends on (seed, tree, node) alone, so it is the same
for any partitioning.  A level is two passes over the rows: ranges of the drawn
features with count and label range of each node, then count and label sum left
and right of every threshold.  The split with the largest drop in label variance
wins, which for 0/1 labels is the Gini criterion, so one code serves scores and
values.  Sums are merged as a tree; the driver and the broadcast hold
(trees x nodes) numbers, bounded by ``max_depth``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefixfit import TREE
from tessera.session import retain, share

MAX_DEPTH = 10


@dataclass
class Tree:
    """Nodes by number; a node without a feature is a leaf."""
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        at = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(feature[at] >= 0)):
            node = at[inner]
            # a missing value goes right
            at[inner] = left[node] + ~(x[inner, feature[node]] <= threshold[node])
        return at

    def split(self, node: int, feature: int, threshold: float) -> list[int]:
        first = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, first
        for c, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.value, self.value[node])):
            c += [empty, empty]
        return [first, first + 1]


def drawn(seed: int, tree: int, node: int, p: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """The features tried at a node, and where between smallest and largest value."""
    rng = np.random.default_rng([seed, tree, node])
    return rng.choice(p, size=min(tries, p), replace=False), rng.random(min(tries, p))


_PART = pa.schema([("tree", pa.int32()), ("bucket", pa.int32()), ("least", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))])


def _pass(rows: DataFrame, trees: list[Tree], open_: dict[int, list[int]], tried: dict[int, np.ndarray],
          cuts: dict[int, np.ndarray] | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per tree two vectors over its open nodes.  Without ``cuts``: minima of (each tried
    feature, its negative, label, negative label) and sums of (count, label).  With
    cuts: sums of (count, label) left of each cut."""
    shared = share(rows.sparkSession, (trees, open_, tried, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, nodes, features, at = shared()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for t, some in nodes.items():
                place = np.full(len(forest[t].feature), -1)
                place[some] = np.arange(len(some))
                own = place[forest[t].leaf_of(x)]
                mine = np.flatnonzero(own >= 0)
                own, label, tries = own[mine], y[mine], features[t]
                k = tries.shape[1]
                values = x[mine[:, None], tries[own]]
                if at is None:
                    least = np.full((len(some), 2 * k + 2), np.inf)
                    seen = np.hstack([values, -values, label[:, None], -label[:, None]])
                    np.minimum.at(least, own, np.where(np.isnan(seen), np.inf, seen))
                    total = np.stack([np.bincount(own, minlength=len(some)), np.bincount(own, label, len(some))], axis=1)
                else:
                    least = np.zeros((1, 1))
                    goes = values <= at[t][own]
                    key = (own[:, None] * k + np.arange(k))[goes]
                    total = np.stack([np.bincount(key, minlength=len(some) * k),
                                      np.bincount(key, np.broadcast_to(label[:, None], goes.shape)[goes], len(some) * k)], axis=1)
                old = held.get(t)
                held[t] = (np.minimum(old[0], least), old[1] + total) if old else (least, total.astype(float))
        bucket = TaskContext.get().partitionId() % TREE
        for t, (least, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([bucket], pa.int32()),
                                              *[pa.ListArray.from_arrays([0, a.size], pa.array(a.ravel())) for a in (least, total)]], schema=_PART)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("x", "y").coalesce(cores).mapInArrow(run, "tree int, bucket int, least array<double>, total array<double>")
    one = parts.select("tree", array_to_vector("least").alias("least"), array_to_vector("total").alias("total"))
    if cores > TREE:
        one = parts.groupBy("tree", "bucket").agg(Summarizer.min(array_to_vector("least")).alias("least"), Summarizer.sum(array_to_vector("total")).alias("total"))
    both = one.groupBy("tree").agg(vector_to_array(Summarizer.min(F.col("least"))).alias("least"), vector_to_array(Summarizer.sum(F.col("total"))).alias("total"))
    return {r["tree"]: (np.asarray(r["least"]), np.asarray(r["total"])) for r in both.collect()}


def grow(rows: DataFrame, n_trees: int = 100, max_depth: int = MAX_DEPTH, tries: int | None = None, seed: int = 42,
         min_rows: int = 2) -> list[Tree]:
    """Trees over rows(x array<double>, y).  ``tries``: features per node (the square
    root of their number); a node of fewer than ``min_rows`` rows, of one label or
    without a feature that varies is a leaf."""
    first = rows.select(F.size("x").alias("p")).first()
    trees = [Tree() for _ in range(n_trees)]
    if first is None:
        return trees
    p = first["p"]
    tries = tries or max(1, round(p ** 0.5))
    open_ = {t: [0] for t in range(n_trees)}
    for depth in range(max_depth + 1):
        draws = {t: [drawn(seed, t, node, p, tries) for node in some] for t, some in open_.items()}
        features = {t: np.array([d[0] for d in ds]) for t, ds in draws.items()}
        ranges = _pass(rows, trees, open_, features, None)
        cuts, splittable = {}, {}
        for t, some in open_.items():
            k = features[t].shape[1]
            least, total = ranges[t][0].reshape(len(some), -1), ranges[t][1].reshape(len(some), 2)
            low, high = least[:, :k], -least[:, k:2 * k]
            for node, (n, s) in zip(some, total):
                trees[t].value[node] = s / n if n else trees[t].value[node]
            varies = (low < high) & np.isfinite(low) & np.isfinite(high)
            cut = np.where(varies, np.where(varies, low, 0.0) + np.array([d[1] for d in draws[t]]) * np.where(varies, high - low, 0.0), np.nan)
            fit = (total[:, 0] >= min_rows) & (least[:, 2 * k] < -least[:, 2 * k + 1]) & varies.any(axis=1)
            if depth < max_depth and fit.any():
                splittable[t] = ([some[i] for i in np.flatnonzero(fit)], total[fit])
                cuts[t], features[t] = cut[fit], features[t][fit]
        open_ = {t: nodes for t, (nodes, _) in splittable.items()}
        if not open_:
            break
        sums = _pass(rows, trees, open_, {t: features[t] for t in open_}, cuts)
        following: dict[int, list[int]] = {}
        for t, (nodes, total) in splittable.items():
            k = features[t].shape[1]
            left = sums[t][1].reshape(len(nodes), k, 2)
            n, s = total[:, None, 0], total[:, None, 1]
            nl, sl = left[:, :, 0], left[:, :, 1]
            useful = (nl > 0) & (nl < n)
            gain = np.where(useful, sl ** 2 / np.maximum(nl, 1) + (s - sl) ** 2 / np.maximum(n - nl, 1), -np.inf)
            best = gain.argmax(axis=1)
            for i, node in enumerate(nodes):
                if useful[i, best[i]]:
                    following.setdefault(t, []).extend(trees[t].split(node, int(features[t][i, best[i]]), float(cuts[t][i, best[i]])))
        open_ = following
        if not open_:
            break
    return trees


def fit_extra_trees(train: DataFrame, test: DataFrame, keep: tuple[str, ...] = ("id", "y"), n_trees: int = 100,
                    max_depth: int = MAX_DEPTH, seed: int = 42) -> DataFrame:
    """ML5: scores of the test rows (column ``features``): the mean of the trees' leaf
    means, a probability for 0/1 labels."""
    rows = train.select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y")).transform(retain)
    try:
        trees = grow(rows, n_trees, max_depth, seed=seed)
    finally:
        rows.unpersist()
    shared = share(train.sparkSession, trees)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forest = shared()
        for column in batches:
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
            yield pa.array(np.mean([np.array(t.value)[t.leaf_of(x)] for t in forest], axis=0) if len(x) else np.empty(0))

    return test.select(*keep, score(vector_to_array("features")).alias("p"))
