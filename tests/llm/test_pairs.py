"""SimHash, embedding near-dedup, neighbour search and components against brute force."""
import math

import numpy as np
import xxhash
from conftest import SF_SMALL, SF_TINY
from llm_cases import documents, empty_documents

from tessera.llm import ann, simhash, vecdedup
from tessera.llm.components import components
from tessera.llm.queries import QUERIES


def roots_of(n, links):
    up = list(range(n))

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(v) for v in range(n)]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [tuple(map(int, x)) for x in rng.integers(0, 150, (60, 2))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links + links[:5] + [(None, 3)], "u long, v long")).collect()}
    want = roots_of(400, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {v: want[v] for v in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tile_links_connect_like_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 20).astype(np.uint64)
    x = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for b in base]]))
    got = simhash.tile_links(x.view(np.int64), x.view(np.int64), 3, True)
    all_pairs = [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 3]
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    assert roots_of(len(x), all_pairs) == roots_of(len(x), [(at[a], at[b]) for a, b in got])
    assert len(got) < len(x)


def test_query_9_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = {(docs[i][0], f"{prints[i]:016x}", docs[r][0]) for i, r in enumerate(roots_of(len(docs), links))}
    assert {tuple(r) for r in QUERIES["op9_simhash_dedup"](spark, SF_TINY).collect()} == want


def test_simhash_of_awkward_rows(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == 11
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert (r["fp"], r["component_id"]) == (0, 2)
        if r["doc_id"] in (1, 6):
            assert r["component_id"] == 1
        if r["doc_id"] is None:
            assert r["component_id"] == 8  # the smallest id of its component that is not null
    assert plain_fingerprint("a b") == simhash.fingerprint_of("A\tB")
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


def cloud(spark, n=260):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 16))
    for k in range(0, min(n, 200) - 3, 4):  # near copies, some scaled
        x[k + 1] = 3 * x[k] + 0.2 * rng.standard_normal(16)
        x[k + 2] = x[k] + 0.35 * rng.standard_normal(16)
    x[220:240] = (x[0] + 0.02 * rng.standard_normal((20, 16)))[:len(x[220:240])]
    x[250:255] = x[4]
    labels = [None if k == 3 else k % 2 * 0 if k < 245 else k % 3 for k in range(n)]
    rows = [(k, v.tolist(), g, 1.0, 5) for k, (v, g) in enumerate(zip(x, labels))]
    odd = [(900, None, 0, 1.0, 5), (901, [0.0] * 16, 0, 1.0, 5), (902, [float("nan")] + [1.0] * 15, 0, 1.0, 5),
           (903, [1.0] * 8, 0, 1.0, 5), (904, [None] + [1.0] * 15, 0, 1.0, 5), (None, x[0].tolist(), 0, 1.0, 5),
           (0, x[0].tolist(), 0, 1.0, 5), (905, [], 0, 1.0, 5)]
    return rows + odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, score double, key int")


def sound(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "TILE", 32)
    rows, df = cloud(spark)
    n = len(rows)
    links = []
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is not None and a[2] == b[2] and sound(a[1]) and sound(b[1]) and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                    links.append((i, j))
    count = np.bincount([x for e in links for x in e], minlength=n)
    root = roots_of(n, links)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[k][0])
    want = sorted(((rows[k][0], int(count[k]), least.get(root[k]), rows[k][0] == least.get(root[k])) for k in range(n)), key=str)
    got = sorted(map(tuple, vecdedup.near_duplicate_vectors(df).collect()), key=str)
    assert got == want and max(count) > 20
    assert vecdedup.near_duplicate_vectors(df.where("false")).count() == 0


def test_neighbour_recall_and_scores(spark):
    data = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in data}
    got = QUERIES["op4_nearest_neighbours"](spark, SF_SMALL).toPandas()
    recall = []
    for q, group in got.groupby("query_id"):
        want = sorted((v for v in x if v != q), key=lambda v: (-(x[v] @ x[q]), v))[:20]
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21))
        assert group["score"].is_monotonic_decreasing
        assert np.allclose(group["score"], [x[v] @ x[q] for v in group["vec_id"]], atol=1e-12)
        recall.append(len(set(want) & set(group["vec_id"])) / 20)
    assert sorted(got["query_id"].unique()) == sorted(v for v in x if v % 20 == 0)
    assert np.mean(recall) >= 0.9


def test_neighbours_with_a_real_graph(spark, monkeypatch):
    """Leaves and buckets much smaller than the table: descent and search do the work."""
    for name, value in {"LEAF": 64, "TABLES": 3, "BLOCK": 128, "BEAM": 64, "ASKS": 16}.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 12))
    x[100:180] = x[0]  # ties: equal vectors, more than are asked for
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df["vec_id"] % 20 == 0, k=10).toPandas()
    recall = []
    for q, group in got.groupby("query_id"):
        scores = x @ x[q]
        want = sorted((v for v in range(900) if v != q), key=lambda v: (-scores[v], v))[:10]
        recall.append(len(set(want) & set(group["vec_id"])) / 10)
    assert len(recall) == 45 and np.mean(recall) >= 0.9


def test_neighbours_of_awkward_rows(spark):
    rows, df = cloud(spark, 30)
    from pyspark.sql import functions as F
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=40).toPandas()
    usable = [r for r in rows if r[0] is not None and sound(r[1])]
    for q, v in ((10, 16), (20, 16)):
        same = [r for r in usable if len(r[1]) == v]
        group = got[got["query_id"] == q].sort_values("rank")
        a = np.array(next(r[1] for r in rows if r[0] == q))
        want = sorted(((float(np.array(r[1]) @ a), r[0]) for r in same), key=lambda s: (-s[0], s[1]))
        want = [w for w in want if w[1] != q][:40]
        assert group["vec_id"].tolist() == [w[1] for w in want]
    # id 0 stands twice: each row finds the other
    assert (got[(got["query_id"] == 0)]["vec_id"] == 0).sum() == 2
    assert 903 not in set(got["vec_id"]) and 901 not in set(got["vec_id"])
    assert ann.nearest(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_neighbours_in_a_group_of_near_copies_larger_than_leaves(spark, monkeypatch):
    """A third of all vectors are near copies, several leaves of them; recall by class of query."""
    for name, value in {"LEAF": 64, "BLOCK": 64, "BEAM": 96, "ASKS": 32}.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24))
    x[::3] = x[0] + 0.05 * rng.standard_normal((500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df["vec_id"] % 20 == 0, k=10).toPandas()
    recall = {True: [], False: []}
    for q, group in got.groupby("query_id"):
        scores = x @ x[q]
        want = sorted((v for v in range(1500) if v != q), key=lambda v: (-scores[v], v))[:10]
        recall[q % 3 == 0].append(len(set(want) & set(group["vec_id"])) / 10)
    assert len(recall[True]) == 25 and len(recall[False]) == 50
    assert np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9


def test_rows_sent_per_node_do_not_grow(spark, monkeypatch):
    """A node sends at most one row per edge, whatever the number of nodes and however often it is listed."""
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "REVERSE", 4)
    for n in (40, 400):
        # every node lists node 1 (a hub) and its two successors
        ids = [(k << ann.PLACE - 3) + 1 for k in range(n)]
        state = [(ids[k], np.array([ids[0], ids[(k + 1) % n], ids[(k + 2) % n]], np.int64).tobytes(),
                  np.array([0.9, 0.8, 0.7]).tobytes(), bytes(3), b"\0" * 12) for k in range(1, n)]
        state.append((ids[0], np.array(ids[1:4], np.int64).tobytes(), np.array([0.9, 0.8, 0.7]).tobytes(), bytes(3), b"\0" * 12))
        sent = ann.pushes(spark.createDataFrame(state, ann.STATE), 3).toPandas()
        assert sent.groupby("id").size().max() <= 3 + 4
        assert sum(len(a) // 4 for a in sent[sent["id"] == ids[0]]["at"]) <= 3 + 4
