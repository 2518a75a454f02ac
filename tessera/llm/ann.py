"""Approximate nearest neighbours by inner product: NN-descent and graph search.

A graph node is a distinct vector.  Nodes lie in blocks: cells of equal random
hyperplane codes, oversized cells split by a hash; an id names its block.  The
first neighbour lists come from leaves made the same way in ``TABLES`` codings.

NN-descent improves all lists in rounds.  Of the nodes that list a node the best
``REVERSE`` count; each such pair is an edge of the graph.  A node sends its vector
once to every block that holds neighbours of it; there, the neighbours of each
node are compared with each other (neighbours of neighbours), and what beats the
end of a list goes back to its owner.  Degrees are bounded, so a node sends at most
``NEIGHBOURS + REVERSE`` rows whatever the size of the table, and no node or block
gathers more than its own edges.  Rounds end when less than ``SETTLED`` of all
entries are new.

A query is a row of the table, so its greedy search starts at its own node: every
open entry of its list (the beam, ``BEAM`` entries) is expanded in the block that
holds it, until no entry of any beam is open.  Blocks that many queries ask are
repeated, ``ASKS`` queries each.  Blocks travel with vectors in half precision;
final scores are exact.  ``NEIGHBOURS``, ``REVERSE`` and ``BEAM`` are limits of the
method; recall is measured against brute force in the tests.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and rows with a null id, take no part; vectors of different length
are not compared; equal vectors are one node with its smallest ids (more can
never be among the nearest, as ties go to smaller ids); repeated rows are
candidates of their own; fewer candidates than asked for: all that are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.vectors import packed, usable
from tessera.session import bound_batches, drop_shared, write_shared

NEIGHBOURS = 24
REVERSE = 24
TABLES = 4
LEAF = 1024
BLOCK = 1024
SETTLED = 0.1
BEAM = 384
ASKS = 4096

#: Hyperplanes of a coding; cells of more nodes than a leaf are split by a hash.
PLANES = 32
#: Bits of an id that count within its block.
PLACE = 23

STATE = "id long, ids binary, scores binary, done binary, vec binary"
PUSHES = "block long, id long, vec binary, least double, at binary"


@contextmanager
def _shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their query has ended: every round is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@F.pandas_udf(T.BinaryType())
def _halves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Largest magnitude (a double), then the components over it in half precision."""
    for vectors in batches:
        out = []
        for v in vectors:
            x = np.frombuffer(v, float)
            top = np.abs(x).max()
            out.append(top.tobytes() + (x / top).astype(np.float16).tobytes())
        yield pd.Series(out, dtype=object)


def _whole(vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and magnitudes of packed halves; shorter vectors end in zeros."""
    width = max(map(len, vecs))
    raw = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vecs), np.uint8).reshape(len(vecs), width)
    return raw[:, 8:].copy().view(np.float16).astype(np.float32), raw[:, :8].copy().view(float)[:, 0]


def _codes(tables: int) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drawn = {}
        for vecs in batches:
            out = []
            for v in vecs:
                x = np.frombuffer(v, np.float16, offset=8).astype(np.float32)
                if len(x) not in drawn:
                    drawn[len(x)] = np.random.default_rng(len(x)).standard_normal((tables, PLANES, len(x))).astype(np.float32)
                out.append(((drawn[len(x)] @ x > 0) @ (1 << np.arange(PLANES))).tolist())
            yield pd.Series(out, dtype=object)
    return codes


@F.pandas_udf(T.DoubleType())
def _inner(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.frombuffer(x, float) @ np.frombuffer(y, float)) for x, y in zip(a, b)], dtype=float)


def best_of(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, done: np.ndarray, keep: int):
    """Per owner the ``keep`` best different ids, best first (ties: smaller id);
    an id is done if any of its entries is."""
    order = np.lexsort((~done, ids, owner))
    owner, ids, scores, done = owner[order], ids[order], scores[order], done[order]
    first = np.ones(len(ids), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, scores, done = owner[first], ids[first], scores[first], done[first]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, done = owner[order], ids[order], scores[order], done[order]
    start = np.searchsorted(owner, owner, side="left")
    top = np.arange(len(owner)) - start < keep
    return owner[top], ids[top], scores[top], done[top]


def by_key(rows: DataFrame, keys: list[str], handle: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies ``handle`` to runs of whole groups of ``keys``: rows are partitioned
    and sorted by them, and only an unfinished group is held back."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            if held and last.all() and (held[-1][keys].iloc[-1] == pdf[keys].iloc[-1]).all():
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf[~last]], ignore_index=True)
            if len(whole):
                # the group held back may go on in this batch's last group only if that is its key
                same = (whole[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
                held = [whole[same], pdf[last]] if same.any() else [pdf[last]]
                whole = whole[~same]
                if len(whole):
                    yield handle(whole.reset_index(drop=True))
            else:
                held = [pdf[last]]
        if held:
            yield handle(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _spread(column: pd.Series, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Row place and value of every entry of a packed column."""
    size = np.dtype(dtype).itemsize
    counts = np.fromiter((len(b) // size for b in column), np.int64, len(column))
    return np.repeat(np.arange(len(column)), counts), np.frombuffer(b"".join(column), dtype)


def _packed_lists(owner, ids, scores, done) -> pd.DataFrame:
    owners, at = np.unique(owner, return_index=True)
    ends = [*at[1:].tolist(), len(owner)]
    rows = [(int(o), ids[a:b].tobytes(), scores[a:b].tobytes(), done[a:b].tobytes(), None)
            for o, a, b in zip(owners, at.tolist(), ends)]
    return pd.DataFrame(rows, columns=["id", "ids", "scores", "done", "vec"])


def merge_lists(lists: DataFrame, keep: int) -> DataFrame:
    """One list of the ``keep`` best entries per owner, from all its lists, with
    the vector that one of them holds."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        at, ids = _spread(pdf["ids"], np.int64)
        owner = pdf["id"].to_numpy(np.int64)[at]
        found = _packed_lists(*best_of(owner, ids, _spread(pdf["scores"], float)[1], _spread(pdf["done"], bool)[1], keep))
        own = pdf.loc[pdf["vec"].notna(), ["id", "vec"]]
        out = own.merge(found.drop(columns="vec"), on="id", how="left")
        empty = out["ids"].isna()
        for name in ("ids", "scores", "done"):
            out[name] = out[name].astype(object).mask(empty, b"")
        return out[["id", "ids", "scores", "done", "vec"]]

    return by_key(lists, ["id"], merge, STATE)


def _groups(pdf: pd.DataFrame, *keys: str) -> Iterator[pd.DataFrame]:
    for _, group in pdf.groupby(list(keys), sort=False):
        yield group


def place_nodes(vectors: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, cells): ``vectors`` (key, vec, codes, dims, ...) with an id that
    names the block, and the number of nodes of every cell of every coding."""
    mask = (1 << min(PLANES, max(0, math.ceil(math.log2(max(1, n) / LEAF))))) - 1
    cut = vectors.withColumn("codes", F.transform("codes", lambda c: c.bitwiseAND(F.lit(mask))))
    cells = write_shared(cut.select("dims", F.posexplode("codes").alias("t", "code")).groupBy("t", "dims", "code")
                         .agg(F.count("*").alias("size")), "cells")
    first = cells.where("t = 0").select("dims", F.col("code").alias("code"), "size")
    at = cut.withColumn("code", F.col("codes")[0]).join(first, ["dims", "code"])
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK))
    at = at.withColumn("block", F.shiftrightunsigned(F.xxhash64("dims", "code", salt), PLACE + 1))
    at = at.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("key")))
    ids = F.shiftleft("block", PLACE) + F.col("place")
    return write_shared(at.withColumn("id", ids.cast("long")).drop("block", "place", "code", "size"), "nodes"), cells


def first_lists(nodes: DataFrame, cells: DataFrame, keep: int) -> DataFrame:
    """Lists of the nearest within leaves: cells of one coding, those of more than
    two leaves split by a hash that differs between the codings."""
    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([knn(g) for g in _groups(pdf, "leaf", "dims")], ignore_index=True)

    def knn(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy(np.int64)
        x, size = _whole(group["vec"].tolist())
        k, rows = min(keep, len(ids) - 1), []
        for a in range(0, len(ids) if k > 0 else 0, 512):
            s = (x[a:a + 512] @ x.T) * size[a:a + 512, None] * size
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found = np.take_along_axis(s, top, axis=1)
            rows += [(int(i), ids[c].tobytes(), f.tobytes(), bytes(k), None) for i, c, f in zip(ids[a:a + 512], top, found)]
        return pd.DataFrame(rows, columns=["id", "ids", "scores", "done", "vec"])

    each = nodes.select("id", "dims", "vec", F.posexplode("codes").alias("t", "code")).join(cells, ["t", "dims", "code"])
    salt = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("size") / (2 * LEAF)))
    leaves = by_key(each.select(F.xxhash64("t", "dims", "code", salt).alias("leaf"), "dims", "id", "vec"), ["leaf"], near, STATE)
    nothing = F.lit(b"")
    own = nodes.select("id", nothing.alias("ids"), nothing.alias("scores"), nothing.alias("done"), "vec")
    return merge_lists(leaves.unionByName(own), keep)


def _least(scores: bytes, keep: int) -> float:
    """What an entry must exceed to enter a list."""
    return float(np.frombuffer(scores, float).min()) if len(scores) >= 8 * keep else -math.inf


def pushes(state: DataFrame, keep: int) -> DataFrame:
    """Per node and block that holds neighbours of it: its vector, what its list
    asks of an entry, and the places of those neighbours in the block."""
    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, ids = _spread(pdf["ids"], np.int64)
            yield pd.DataFrame({"id": ids, "other": pdf["id"].to_numpy(np.int64)[at], "score": _spread(pdf["scores"], float)[1]})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "other": -1, "vec": pdf["vec"], "least": [_least(b, keep) for b in pdf["scores"]]})

    def push(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["other"].to_numpy(np.int64) < 0
        vec, least = (dict(zip(pdf["id"][mine], pdf[c][mine])) for c in ("vec", "least"))
        pair = np.unique(pdf.loc[~mine, ["id", "other"]].to_numpy(np.int64), axis=0)
        if not len(pair):
            return pd.DataFrame(columns=["block", "id", "vec", "least", "at"])
        node, block = pair[:, 0], pair[:, 1] >> PLACE
        place = (pair[:, 1] & ((1 << PLACE) - 1)).astype(np.int32)
        start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (block[1:] != block[:-1])])
        rows = [(int(block[a]), int(node[a]), vec[node[a]], least[node[a]], place[a:b].tobytes())
                for a, b in zip(start.tolist(), [*start[1:].tolist(), len(pair)])]
        return pd.DataFrame(rows, columns=["block", "id", "vec", "least", "at"])

    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    listed = state.select("id", "ids", "scores").mapInPandas(edges, "id long, other long, score double")
    listed = listed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= REVERSE)
    both = listed.select(F.explode(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))).alias("e"))
    both = both.select("e.id", "e.other", F.lit(None).cast("binary").alias("vec"), F.lit(0.0).alias("least"))
    mine = state.select("id", "scores", "vec").mapInPandas(own, "id long, other long, vec binary, least double")
    return by_key(both.unionByName(mine), ["id"], push, PUSHES)


def local_join(sent: DataFrame, keep: int) -> DataFrame:
    """Lists of what the neighbours of every node find in each other."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(g) for g in _groups(pdf, "block")], ignore_index=True)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, least = group["id"].to_numpy(np.int64), group["least"].to_numpy(float)
        x, size = _whole(group["vec"].tolist())
        rows, places = _spread(group["at"], np.int32)
        order = np.argsort(places, kind="stable")
        rows = rows[order]
        start = np.flatnonzero(np.r_[True, np.diff(places[order]) != 0]).tolist()
        owner, other, score = [], [], []
        for a, b in zip(start, [*start[1:], len(rows)]):
            m = rows[a:b]
            s = (x[m] @ x[m].T) * size[m][:, None] * size[m]
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero(s > least[m][:, None])
            owner.append(m[i])
            other.append(m[j])
            score.append(s[i, j])
        owner, other, score = ids[np.concatenate(owner)], ids[np.concatenate(other)], np.concatenate(score)
        return _packed_lists(*best_of(owner, other, score, np.zeros(len(owner), bool), keep))

    return by_key(sent, ["block"], join, STATE)


def _all_done(state: DataFrame) -> DataFrame:
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(done=[b"\1" * len(d) for d in pdf["done"]])
    return state.mapInPandas(mark, STATE)


def new_share(state: DataFrame) -> float:
    """Share of the entries that came in with the last round."""
    open_entries = F.octet_length("done") - F.octet_length(F.replace(F.hex("done"), F.lit("00"), F.lit(""))) / 2
    new, every = state.agg(F.sum(open_entries), F.sum(F.octet_length("done"))).first()
    return (new or 0) / (every or 1)


def neighbour_graph(nodes: DataFrame, cells: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """NN-descent lists of all ``nodes``."""
    lists = write_shared(first_lists(nodes, cells, neighbours), "lists")
    while True:
        found = local_join(pushes(lists, neighbours), neighbours)
        better = write_shared(merge_lists(_all_done(lists).unionByName(found), neighbours), "lists")
        drop_shared(lists)
        lists = better
        if new_share(lists) < SETTLED:
            return lists


def graph_search(start: DataFrame, lists: DataFrame, beam: int) -> DataFrame:
    """Greedy search from the lists of the nodes in ``start`` (id): lists of the
    ``beam`` best nodes found."""
    graph = write_shared(pushes(lists, beam), "graph")

    def reopened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(done=[bytes(len(d)) for d in pdf["done"]])

    def ask(own: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for q, ids, scores, done, vec in pdf.itertuples(index=False):
                    open_ids = np.frombuffer(ids, np.int64)[~np.frombuffer(done, bool)]
                    open_ids = np.unique(np.append(open_ids, np.int64(q)) if own else open_ids)
                    blocks, at = np.unique(open_ids >> PLACE, return_index=True)
                    place, least = (open_ids & ((1 << PLACE) - 1)).astype(np.int32), _least(scores, beam)
                    rows += [(h, q, vec, least, place[a:b].tobytes()) for h, a, b in zip(blocks.tolist(), at.tolist(), [*at[1:].tolist(), len(place)])]
                yield pd.DataFrame(rows, columns=["block", "id", "vec", "least", "at"])
        return run

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for g in _groups(pdf, "block", "salt") for r in scored(g)]
        return pd.DataFrame(rows, columns=["id", "ids", "scores", "done", "vec"])

    def scored(group: pd.DataFrame) -> Iterator[tuple]:
        asking = group["asks"].to_numpy(bool)
        held, asks = group[~asking], group[asking]
        if not len(held) or not len(asks):
            return
        ids = held["id"].to_numpy(np.int64)
        x, size = _whole(held["vec"].tolist())
        rows, places = _spread(held["at"], np.int32)
        order = np.argsort(places, kind="stable")
        rows, places = rows[order], places[order]
        for q, vec, least, at in asks[["id", "vec", "least", "at"]].itertuples(index=False):
            wanted = np.frombuffer(at, np.int32)
            m = np.unique(np.concatenate([rows[a:b] for a, b in zip(np.searchsorted(places, wanted), np.searchsorted(places, wanted, "right"))]))
            v, top = _whole([vec])
            s = (x[m, :v.shape[1]] @ v[0]) * size[m] * top[0]
            good = (s > least) & (ids[m] != q)
            if good.any():
                yield q, ids[m[good]].tobytes(), s[good].tobytes(), bytes(int(good.sum())), None

    beams = write_shared(lists.join(start, "id", "left_semi").mapInPandas(reopened, STATE), "beams")
    first = True
    while True:
        asks = write_shared(beams.mapInPandas(ask(first), PUSHES), "asks")
        counts = write_shared(asks.groupBy("block").agg(F.ceil(F.count("*") / ASKS).alias("salts")), "counts")
        if counts.isEmpty():
            drop_shared(asks, counts, graph)
            return beams
        dealt = asks.join(counts, "block").withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).withColumn("asks", F.lit(True))
        held = graph.join(counts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("asks", F.lit(False))
        columns = ["block", F.col("salt").cast("long").alias("salt"), "asks", "id", "vec", "least", "at"]
        found = by_key(dealt.select(columns).unionByName(held.select(columns)), ["block", "salt"], answer, STATE)
        wider = write_shared(merge_lists(_all_done(beams).unionByName(found), beam), "beams")
        drop_shared(beams, asks, counts)
        beams, first = wider, False


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product found for every query row
    (``is_query``, a condition on the id column): query_id, rank, vec_id, score."""
    bound_batches(vectors.sparkSession)
    with _shuffles_end_with_query(vectors.sparkSession):
        return _nearest(vectors, is_query, k, vec_id, embedding)


def _nearest(vectors: DataFrame, is_query: Column, k: int, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).alias("vec_id"), packed(F.col(embedding).cast("array<double>")).alias("vector"),
                       is_query.alias("is_query"))
    rows = write_shared(rows.withColumn("key", F.md5("vector")), "vectors")
    # a node's smallest ids: a query and its k nearest need no more of equal vectors
    place = Window.partitionBy("key").orderBy("vec_id")
    first_ids = rows.select("key", "vec_id").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    grouped = (rows.groupBy("key").agg(F.first("vector").alias("vector"), F.max("is_query").alias("asked"))
               .join(first_ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "key"))
    distinct = grouped.select("key", "vector", "members", "asked", (F.octet_length("vector") / 8).cast("int").alias("dims"),
                              _halves("vector").alias("vec"))
    distinct = write_shared(distinct.withColumn("codes", _codes(TABLES)("vec")), "distinct")
    nodes, cells = place_nodes(distinct, distinct.count())
    lists = neighbour_graph(nodes, cells)
    start = nodes.where("asked").select("id")
    beams = graph_search(start, lists, BEAM)

    # exact scores in double precision, on the original vectors, of every node in a beam
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, ids = _spread(pdf["ids"], np.int64)
            place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            keep = place < 3 * k  # lists are best first in half precision; three times k leaves room for its rounding
            yield pd.DataFrame({"id": pdf["id"].to_numpy(np.int64)[at[keep]], "node": ids[keep]})

    hits = beams.select("id", "ids").mapInPandas(entries, "id long, node long").union(start.select("id", F.col("id").alias("node")))
    left = nodes.select("id", F.col("key").alias("key"), F.col("vector").alias("a"))
    right = nodes.select(F.col("id").alias("node"), F.col("vector").alias("b"), "members")
    scored = hits.join(right, "node").join(left, "id").select("key", "members", _inner("a", "b").alias("score"))
    queries = rows.where("is_query").select("key", F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("q"))
    each = (queries.join(scored, "key").select("q", "query_id", "score", F.explode("members").alias("vec_id")))
    # the query's own row goes once, also where its id repeats
    own = Window.partitionBy("q", "vec_id").orderBy(F.desc("score"))
    each = (each.withColumn("same", F.row_number().over(own)).where("not (vec_id = query_id and same = 1)"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    out = write_shared(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                       .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    drop_shared(rows, distinct, nodes, cells, lists, beams)
    return out
