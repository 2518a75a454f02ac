"""Exact set-similarity search against all pairs, whatever the parts, tiles and id types."""
import random

import numpy as np
import pytest

from tessera.operators import setsearch, similar


def sets(rng, n, most):
    return [sorted(rng.sample(range(200), rng.choice([0, 1, 2, rng.randint(1, most)]))) for _ in range(n)]


def plain(queries, refs, k, exclude_self):
    out = []
    for q, a in queries:
        found = []
        for r, b in refs:
            both = len(set(a or []) & set(b or []))
            if both and not (exclude_self and q == r):
                found.append((-both / (len(a) + len(b) - both), r))
        out += [(q, r, round(-s, 9), i + 1) for i, (s, r) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("k,own", [(1, False), (5, True)])
def test_search_equals_all_pairs(spark, monkeypatch, kind, k, own):
    monkeypatch.setattr(setsearch, "TILE", 7)
    rng = random.Random(k)
    name = (lambda i: i) if kind == "long" else (lambda i: f"r{i}")
    refs = [(name(i), b) for i, b in enumerate(sets(rng, 80, 150))] + [(name(900 + i), [1, 2, 3]) for i in range(20)] + [(name(999), None)]
    queries = refs if own else [(name(5000 + i), b) for i, b in enumerate(sets(rng, 40, 150))] + [(name(7000), None), (name(7001), [1, 2, 3])]
    q = spark.createDataFrame(queries, f"qid {kind}, bits array<int>")
    r = spark.createDataFrame(refs, f"rid {kind}, bits array<int>")
    got = sorted((x["qid"], x["rid"], round(x["sim"], 9), x["nn_rank"]) for x in similar.topk_neighbours(q, r, k, own, n_bits=200, part=9).collect())
    assert got == plain(queries, refs, k, own)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, [1, 2])], "qid long, bits array<int>")
    none = spark.createDataFrame([], "rid long, bits array<int>")
    assert similar.topk_neighbours(some, none, 3).collect() == []
    r = spark.createDataFrame([(1, [1, 2])], "rid long, bits array<int>")
    q = none.withColumnRenamed("rid", "qid")
    assert similar.topk_neighbours(q, r, 3).collect() == []


def test_sizes_prune_and_effort_is_reported(spark):
    rng = np.random.default_rng(2)
    small = [(i, sorted(rng.choice(40, 8, replace=False).tolist())) for i in range(60)]
    large = [(100 + i, sorted(rng.choice(2000, 700, replace=False).tolist())) for i in range(60)]
    q = spark.createDataFrame([(1000 + i, b) for i, b in small], "qid long, bits array<int>")
    r = spark.createDataFrame(small + large, "rid long, bits array<int>")
    e = setsearch.search_effort(q, r, 3).first()
    assert (e["first_round"], e["second_round"], e["all_pairs"]) == (3600, 0, 7200)


def test_applicability_is_distance_threshold_and_kernel(spark):
    rng = random.Random(4)
    train = spark.createDataFrame(list(enumerate(sets(rng, 60, 60))), "rid long, bits array<int>")
    query = spark.createDataFrame([(100 + i, b) for i, b in enumerate(sets(rng, 20, 60))], "qid long, bits array<int>")
    got = {r["qid"]: r for r in similar.applicability(query, train).collect()}
    distance = {r["qid"]: r["knn_distance"] for r in similar.knn_mean_distance(query, train).collect()}
    threshold = similar.ad_threshold(train.withColumnRenamed("rid", "qid")).first()["ad_threshold"]
    assert {k: r["knn_distance"] for k, r in got.items()} == pytest.approx(distance)
    assert all(r["ad_threshold"] == pytest.approx(threshold) for r in got.values()) and len(got) == 20
