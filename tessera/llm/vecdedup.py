"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks of
few dimensions.  A pair with cosine >= t has a squared distance of at most
2 - 2t, so in at least one block its squared distance is within the block's
proportional share of that budget.  Each block is range-joined: vectors are cut
into slabs along the block's first coordinate, those within the block's radius
of a border go to the next slab too, and the pairs within a slab whose block
distance is within budget are the candidates.  Each candidate is verified by its
cosine in double precision.  A pair is counted in the first block that has it
within budget, in the home slab of its smaller id: exactly once.

Equal vectors are one class with a count.  Slabs are packed into tiles of at
most ``TILE`` vectors after a range partitioning and sort, so a hot label or a
large group becomes more tiles, not a larger task; a tile pair returns link
counts and a spanning forest, never the pairs of a group.

Defined cases: a null label, or a vector that is null, empty, zero or holds a
null or non-finite component, links with nothing; vectors of different length do
not link; repeated rows are vectors of their own that link with each other; null
ids take no part in the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import Forest, components
from tessera.llm.vectors import packed, usable
from tessera.session import bound_batches, drop_shared, write_shared

BLOCK_DIMS = 8
TILE = 1024
#: Slab width in block radii.
SLAB = 4.0
SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@F.pandas_udf(T.BinaryType())
def _rotated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for vectors in batches:
        out = []
        for v in vectors:
            x = np.frombuffer(v, float)
            x = x / np.abs(x).max()
            out.append(((x / np.sqrt(x @ x)) @ rotation(len(x))).tobytes())
        yield pd.Series(out, dtype=object)


def blocks_of(dims: int) -> list[slice]:
    return [slice(a, min(dims, a + BLOCK_DIMS)) for a in range(0, dims, BLOCK_DIMS)]


def _slabs(classes: DataFrame, budget: float) -> DataFrame:
    """One row per vector, block and slab; home marks the vector's own slab."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, group in pdf.groupby("dims"):
                x = np.frombuffer(b"".join(group["vec"]), float).reshape(-1, dims)
                for b, block in enumerate(blocks_of(dims)):
                    radius = np.sqrt(budget * (block.stop - block.start) / dims) * (1 + SLACK) + SLACK
                    first, width = x[:, block.start], SLAB * radius
                    own = np.floor(first / width).astype(np.int64)
                    for slab in (own - 1, own, own + 1):
                        near = (first >= slab * width - radius) & (first <= (slab + 1) * width + radius) | (slab == own)
                        yield group[near].assign(block=b, slab=slab[near], home=(slab == own)[near])

    return classes.select("label", "dims", "cid", "copies", "vec").mapInPandas(
        cut, f"label {classes.schema['label'].dataType.simpleString()}, dims int, cid long, copies long, vec binary, block int, slab long, home boolean")


KEY = ["label", "dims", "block", "slab"]


def _tiles(slabs: DataFrame) -> DataFrame:
    """Runs of at most ``TILE`` rows of one slab, packed."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, group in pdf.groupby(KEY, sort=False):
                for at in range(0, len(group), TILE):
                    part = group.iloc[at:at + TILE]
                    rows.append((*key, part["cid"].to_numpy(np.int64).tobytes(), part["copies"].to_numpy(np.int64).tobytes(),
                                 part["home"].to_numpy(bool).tobytes(), b"".join(part["vec"])))
            yield pd.DataFrame(rows, columns=[*KEY, "cids", "copies", "home", "vecs"])

    label = slabs.schema["label"].dataType.simpleString()
    return (slabs.repartitionByRange(*KEY, "cid").sortWithinPartitions(*KEY, "cid")
            .mapInPandas(pack, f"label {label}, dims int, block int, slab long, cids binary, copies binary, home binary, vecs binary")
            .withColumn("tile", F.monotonically_increasing_id()))


def tile_pair(dims: int, block: int, a: tuple, b: tuple, same: bool, threshold: float) -> tuple[dict, list]:
    """Link counts by class and a spanning forest of the links between two tiles.
    A tile is (cids, copies, home flags, rotated unit vectors)."""
    (cid_a, n_a, home_a, x), (cid_b, n_b, home_b, y) = a, b
    budget = 2.0 - 2.0 * threshold
    blocks = blocks_of(dims)
    limits = [budget * (s.stop - s.start) / dims * (1 + SLACK) + SLACK for s in blocks]
    p, q = x[:, blocks[block]], y[:, blocks[block]]
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    shift = 0 if same else len(cid_a)
    forest, edges = Forest(shift + len(cid_b)), []
    count_a, count_b = np.zeros(len(cid_a), np.int64), np.zeros(len(cid_b), np.int64)
    for at in range(0, len(p), 256):
        apart = pp[at:at + 256, None] + qq[None, :] - 2.0 * (p[at:at + 256] @ q.T)
        rows, cols = np.nonzero(apart <= limits[block] + SLACK)
        rows += at
        small_home = np.where(cid_a[rows] < cid_b[cols], home_a[rows], home_b[cols])
        keep = small_home & ((rows < cols) if same else True)
        rows, cols = rows[keep], cols[keep]
        for k in range(0, len(rows), 1 << 14):
            i, j = rows[k:k + (1 << 14)], cols[k:k + (1 << 14)]
            linked = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
            i, j = i[linked], j[linked]
            squared = (x[i] - y[j]) ** 2
            within = np.stack([squared[:, s].sum(axis=1) <= limit for s, limit in zip(blocks, limits)], axis=1)
            first = within.argmax(axis=1) == block
            i, j = i[first], j[first]
            np.add.at(count_a, i, n_b[j])
            np.add.at(count_b, j, n_a[i])
            e = forest.add(i, j + shift)
            edges += zip(cid_a[i[e]].tolist(), cid_b[j[e]].tolist())
    counts: dict[int, int] = {}
    for cids, found in ((cid_a, count_a), (cid_b, count_b)):
        for k in np.flatnonzero(found).tolist():
            counts[int(cids[k])] = counts.get(int(cids[k]), 0) + int(found[k])
    return counts, edges


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): link counts (v null) and edges (n null) of all tile pairs."""
    packed = ["cids", "copies", "home", "vecs"]
    left = tiles.select(*KEY, F.col("tile").alias("tile_a"), *[F.col(c).alias(f"{c}_a") for c in packed])
    right = tiles.select(*KEY, F.col("tile").alias("tile_b"), *[F.col(c).alias(f"{c}_b") for c in packed])
    pairs = left.join(right, KEY).where("tile_a <= tile_b").drop("label", "slab")

    def unpack(r, side: str):
        return (np.frombuffer(getattr(r, f"cids_{side}"), np.int64), np.frombuffer(getattr(r, f"copies_{side}"), np.int64),
                np.frombuffer(getattr(r, f"home_{side}"), bool),
                np.frombuffer(getattr(r, f"vecs_{side}"), float).reshape(-1, r.dims))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                counts, edges = tile_pair(r.dims, r.block, unpack(r, "a"), unpack(r, "b"), r.tile_a == r.tile_b, threshold)
                rows = [(u, None, n) for u, n in counts.items()] + [(u, v, None) for u, v in edges]
                if rows:
                    yield pd.DataFrame(rows, columns=["u", "v", "n"]).astype({"u": "Int64", "v": "Int64", "n": "Int64"})

    return pairs.mapInPandas(compare, "u long, v long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id",
                           embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with the same label and
    a cosine of at least ``threshold``), component_id (smallest vec_id reachable
    by links, itself included), kept (vec_id = component_id).  0 < threshold < 1."""
    bound_batches(vectors.sparkSession)
    able = usable(F.col(embedding)) & F.col(label).isNotNull()
    with_key = write_shared(vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        packed(F.when(able, F.col(embedding).cast("array<double>"))).alias("vector")).withColumn("key", F.md5("vector")), "vectors")
    classes = with_key.where("key is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = write_shared(classes.select("label", "key", "least", "copies", (F.octet_length("vector") / 8).cast("int").alias("dims"),
                                          _rotated("vector").alias("vec"), F.monotonically_increasing_id().alias("cid")), "classes")
    tiles = write_shared(_tiles(_slabs(classes, 2.0 - 2.0 * threshold)), "tiles")
    links = write_shared(_links(tiles, threshold), "links")
    counts = links.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(links.where("v is not null").select("u", "v"))
    named = (classes.select("label", "key", "cid", "least", "copies")
             .join(counts, F.col("cid") == F.col("u"), "left").join(roots, F.col("cid") == F.col("node"), "left")
             .select("label", "key", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("root", "cid").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("label").alias("l"), F.col("key").alias("k"), "n_links", "component_id")
    found = with_key.join(named, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    out = write_shared(found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")), "vector-classes")
    drop_shared(with_key, classes, tiles, links, roots)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
