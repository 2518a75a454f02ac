"""Scalable rank primitives: equal to brute force and plan-safe."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import rank


def _avg_ranks(x):
    return pd.Series(x).rank(method="average").to_numpy()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = rng.integers(0, 3, n)
    v = np.round(rng.normal(size=n), 1)  # heavy ties
    y = (rng.random(n) < 0.4 + 0.1 * (v > 0)).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "y": y})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_auc_and_u_match_bruteforce(data, buckets):
    pdf, df = data
    got = {r["g"]: r for r in rank.rank_sum_test(df, "v", "y", ["g"], n_buckets=buckets).collect()}
    for g, part in pdf.groupby("g"):
        r = _avg_ranks(part.v)
        n1 = part.y.sum()
        n0 = len(part) - n1
        u1 = r[part.y.to_numpy() == 1].sum() - n1 * (n1 + 1) / 2
        assert got[g]["u_pos"] == pytest.approx(u1)
        assert got[g]["u_pos"] + got[g]["u_neg"] == pytest.approx(n1 * n0)
        assert got[g]["auc"] == pytest.approx(u1 / (n1 * n0))


def test_auc_of_negated_score_is_complement(data):
    _, df = data
    a = rank.rank_sum_test(df, "v", "y", ["g"]).orderBy("g").collect()
    b = rank.rank_sum_test(df.withColumn("v", -F.col("v")), "v", "y", ["g"]).orderBy("g").collect()
    for x, y in zip(a, b):
        assert x["auc"] + y["auc"] == pytest.approx(1.0)


@pytest.mark.parametrize("q", [0.5, 0.1, 0.9])
def test_exact_quantile_matches_numpy(data, q):
    pdf, df = data
    got = {r["g"]: r["quantile"] for r in rank.exact_quantile(df, "v", ["g"], q).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part.v.to_numpy(), q))


def test_average_precision_matches_definition(data):
    pdf, df = data
    got = {r["g"]: r["average_precision"] for r in rank.average_precision(df, "v", "y", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        s = part.sort_values("v", ascending=False)
        ap, tp, seen = 0.0, 0, 0
        P = s.y.sum()
        for v, grp in s.groupby("v", sort=False):
            tp += grp.y.sum()
            seen += len(grp)
            ap += grp.y.sum() / P * tp / seen
        assert got[g] == pytest.approx(ap)


def test_bh_matches_step_up(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(500) ** 3, 3)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(500), "p": p}))
    got = dict(rank.bh_adjust(df, "p", [], n_buckets=5).select("i", "p_adjusted").collect())
    order = np.argsort(p, kind="stable")
    m = len(p)
    q = p[order] * m / np.arange(1, m + 1)
    adj = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
    expect = np.empty(m)
    expect[order] = adj
    for i in range(m):
        assert got[i] == pytest.approx(expect[i])


def test_spearman_matches_rank_correlation(spark):
    rng = np.random.default_rng(11)
    rows = []
    for j in range(4):
        x = np.round(rng.normal(size=400), 1)
        y = (rng.random(400) < 0.5).astype(int)
        rows += [(j, float(a), int(b)) for a, b in zip(x, y)]
    pdf = pd.DataFrame(rows, columns=["j", "value", "y"])
    got = {r["j"]: r["rho"] for r in rank.spearman_binary(spark.createDataFrame(pdf), "j", "value", "y").collect()}
    for j, part in pdf.groupby("j"):
        expect = np.corrcoef(_avg_ranks(part.value), _avg_ranks(part.y))[0, 1]
        assert got[j] == pytest.approx(expect)


def test_no_single_partition_exchange(spark, data):
    _, df = data
    plan = rank.rank_sum_test(df, "v", "y", ["g"], n_buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 0), ("a", 1.0, 0), ("a", 3.0, 1)],
                               "g string, v double, y int")
    got = {r["g"]: r["auc"] for r in rank.rank_sum_test(df, "v", "y", ["g"], n_buckets=1).collect()}
    assert got == {None: 0.0, "a": 1.0}
