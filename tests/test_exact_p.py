"""Exact p-values of rank tests against enumeration, with ties."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import cohort, rank


def average_ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


def enumerated(values, labels):
    ranks, n1 = average_ranks(values), sum(labels)
    seen = sum(r for r, y in zip(ranks, labels) if y)
    every = [sum(c) for c in itertools.combinations(ranks, n1)]
    low, high = sum(w <= seen for w in every), sum(w >= seen for w in every)
    return seen - n1 * (n1 + 1) / 2, min(1.0, 2 * min(low, high) / len(every))


def test_rank_sum_p_equals_enumeration(spark):
    rng = random.Random(5)
    groups = {g: [(rng.choice([1.0, 2.0, 2.5, 7.0, 9.0]), rng.randint(0, 1)) for _ in range(rng.randint(1, 10))] for g in range(40)}
    rows = [(None if g == 0 else g, v, y) for g, rs in groups.items() for v, y in rs] + [(3, None, 1), (3, float("nan"), 0)]
    got = {r["g"]: r for r in rank.rank_sum_p(spark.createDataFrame(rows, "g int, v double, y int"), "v", "y", ["g"]).collect()}
    assert len(got) == 40
    for g, rs in groups.items():
        values, labels = zip(*rs)
        r = got[None if g == 0 else g]
        assert r["is_exact"] and r["n_pos"] == sum(labels)
        if 0 < sum(labels) < len(labels):
            u, p = enumerated(values, labels)
            assert r["u_pos"] == pytest.approx(u) and r["p_value"] == pytest.approx(p)
        else:
            assert r["p_value"] is None


def test_exact_and_normal_meet_at_the_border(spark):
    rng = random.Random(6)
    n = stats.EXACT_RANK_SUM
    rows = [(g, rng.gauss(0.4 * (k % 2), 1), k % 2) for g in range(6) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, v double, y int")
    exact = {r["g"]: r for r in rank.rank_sum_p(df, "v", "y", ["g"]).collect()}
    normal = {r["g"]: r for r in rank.rank_sum_p(df, "v", "y", ["g"], exact_n=n - 1).collect()}
    assert all(r["is_exact"] for r in exact.values()) and not any(r["is_exact"] for r in normal.values())
    for g, r in exact.items():
        assert r["u_pos"] == pytest.approx(normal[g]["u_pos"]) and r["p_value"] == pytest.approx(normal[g]["p_value"], abs=0.02)
    whole = rank.rank_sum_p(df, "v", "y").collect()
    assert len(whole) == 1 and not whole[0]["is_exact"]


def test_signed_rank_p_equals_enumeration(spark):
    rng = random.Random(7)
    for n in range(1, 11):
        d = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(n)]
        ranks = average_ranks([abs(x) for x in d])
        seen = sum(r for r, x in zip(ranks, d) if x > 0)
        every = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        want = min(1.0, 2 * min(sum(w <= seen for w in every), sum(w >= seen for w in every)) / len(every))
        row = spark.createDataFrame([(float(seen), float(sum(ranks) - seen), [int(2 * r) for r in ranks])], "a double, b double, r array<int>")
        assert row.select(stats.signed_rank_p("a", "b", "r")).first()[0] == pytest.approx(want)


def test_alignment_is_one_to_one(spark):
    archived = spark.createDataFrame([("a", "x", .1), ("b", "x", .9), ("c", "x", .2), ("d", "y", .5), ("e", "z", .8), ("f", None, .3)],
                                     "aid string, key string, score double")
    source = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "w"), (5, None)], "sid long, key string")
    got = {r["aid"]: (r["sid"], r["status"], r["below_cutoff"]) for r in cohort.align_rows(archived, "aid", source, "sid").collect()}
    assert got == {"a": (1, "ambiguous", True), "b": (2, "ambiguous", False), "c": (None, "ambiguous", True), "d": (3, "matched", True),
                   "e": (None, "unmatched", False), "f": (None, "unmatched", True)}
    assert cohort.align_rows(archived.where(F.lit(False)), "aid", source, "sid").collect() == []
