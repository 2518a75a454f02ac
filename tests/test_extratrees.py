"""Extremely randomised trees: held-out quality, reproducible draws, exact splits."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tessera.operators import extratrees as et
from tessera.operators import rank


def table(spark, n=300, seed=0, regression=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    signal = x[:, 1] * x[:, 2] + x[:, 4]
    y = signal if regression else (signal > 0).astype(float)
    return spark.createDataFrame([(k, r.tolist(), float(v)) for k, (r, v) in enumerate(zip(x, y))], "id long, x array<double>, y double")


def test_held_out_scores(spark):
    df = table(spark).withColumn("features", array_to_vector("x")).repartition(3)
    got = et.fit_extra_trees(df.where("id % 3 > 0"), df.where("id % 3 = 0"), n_trees=30, max_depth=8)
    r = rank.rank_sum_test(got, "p", "y").first()
    assert got.count() == 100 and r["auc"] > 0.75


def test_held_out_values(spark):
    df = table(spark, regression=True).withColumn("features", array_to_vector("x"))
    rows = et.fit_extra_trees(df.where("id % 3 > 0"), df.where("id % 3 = 0"), n_trees=30, max_depth=8).collect()
    y, p = np.array([r["y"] for r in rows]), np.array([r["p"] for r in rows])
    assert np.mean((y - p) ** 2) < 0.7 * np.var(y)


def test_trees_do_not_depend_on_partitions(spark):
    df = table(spark, 120)
    a, b = (et.grow(df.repartition(k), n_trees=3, max_depth=4) for k in (1, 7))
    for s, t in zip(a, b):
        assert s.feature == t.feature and s.left == t.left and s.threshold == t.threshold and s.value == pytest.approx(t.value)
    assert et.grow(df, n_trees=1, max_depth=3, seed=7)[0].threshold != a[0].threshold


def test_splits_and_leaves_are_those_of_the_rows(spark):
    df = table(spark, 80)
    data = df.collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["y"] for r in data])
    tree = et.grow(df, n_trees=1, max_depth=12)[0]
    rows, depth = {0: np.arange(len(x))}, {0: 0}
    for node, f in enumerate(tree.feature):
        mine = rows[node]
        assert tree.value[node] == pytest.approx(y[mine].mean())
        if f < 0:
            assert depth[node] == 12 or len(mine) < 2 or len(set(y[mine])) == 1 or all(
                len(set(x[mine, j])) == 1 for j in et.drawn(42, 0, node, 6, 2)[0])
            continue
        features, share = et.drawn(42, 0, node, 6, 2)
        low, high = x[mine][:, features].min(axis=0), x[mine][:, features].max(axis=0)
        gains = []
        for j, cut in zip(features, low + share * (high - low)):
            left = x[mine, j] <= cut
            gains.append(y[mine][left].sum() ** 2 / max(left.sum(), 1) + y[mine][~left].sum() ** 2 / max((~left).sum(), 1))
        assert f == features[int(np.argmax(gains))]
        goes = x[mine, f] <= tree.threshold[node]
        rows[tree.left[node]], rows[tree.left[node] + 1] = mine[goes], mine[~goes]
        depth[tree.left[node]] = depth[tree.left[node] + 1] = depth[node] + 1


def test_constant_and_missing_values(spark):
    df = spark.createDataFrame([(0, [1.0, None], 1.0), (1, [1.0, None], 0.0)], "id long, x array<double>, y double")
    tree = et.grow(df, n_trees=1)[0]
    assert tree.feature == [-1] and tree.value == [0.5]
    mixed = spark.createDataFrame([(k, [None if k % 3 == 0 else float(k), 2.0], float(k > 5)) for k in range(12)], "id long, x array<double>, y double")
    assert et.grow(mixed, n_trees=2, max_depth=3)[0].leaf_of(np.array([[np.nan, 2.0]])).shape == (1,)
