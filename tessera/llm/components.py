"""Connected components of a link table with alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import drop_shared, write_shared


class Forest:
    """Spanning forest of links that are found block by block inside a task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the links (i, j) that join two trees so far apart."""
        x, y = self.label[i], self.label[j]
        new = np.flatnonzero(x != y)
        if not len(new):
            return new
        x, y = x[new], y[new]
        _, first = np.unique(np.minimum(x, y) * len(self.label) + np.maximum(x, y), return_index=True)
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while (above := up.get(v, v)) != v:
                up[v] = v = up.get(above, above)
            return v

        taken = []
        for k in first.tolist():
            u, v = root(int(x[k])), root(int(y[k]))
            if u != v:
                up[max(u, v)] = min(u, v)
                taken.append(k)
        table = np.arange(len(self.label))
        for v in list(up):
            table[v] = root(v)
        self.label = table[self.label]
        return new[taken]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("a"), F.col("u").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(own).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v: longs, any direction,
    repeats and loops allowed); root is the smallest node of the component.

    Rounds of large-star and small-star until the edge set stays the same; each
    round's edges are a table in the shared folder, so the plan stays short and
    a lost executor repeats one round at most.  The driver sees a count and a
    checksum per round.  Nodes with null are dropped.
    """
    edges = write_shared(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                         .distinct(), "edges")
    before = _state(edges)
    while before[0]:
        after_round = write_shared(_small_star(_large_star(edges)), "edges")
        now = _state(after_round)
        drop_shared(edges)
        edges = after_round
        if now == before:
            break
        before = now
    # at the end every edge joins a node to its root
    out = write_shared(edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
                       .union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct(), "roots")
    drop_shared(edges)
    return out
