"""Batched fits of nested feature sets: equal to one Spark ML fit each."""
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import denoise as dn
from tessera.operators import learn as ln
from tessera.operators import prefixfit as pf
from tessera.operators import rank
from tessera.plans import denoising as dq


def rows_of(spark, n=400, p=7, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 0.7).astype(int)
    sets = rng.integers(0, 2, size=(n, 2))
    data = [(k, [None if (k + j) % 97 == 0 else float(v) for j, v in enumerate(r)], int(c), [int(s) for s in t])
            for k, (r, c, t) in enumerate(zip(x, y, sets))]
    return spark.createDataFrame(data, "id long, x array<double>, y int, sets array<int>").repartition(5)


def folds_of(rows):
    out = []
    for r, w in enumerate(pf.train_weights(rows, 2)):
        fit = dn.denoise_fit(rows.where(F.col("sets")[r] == 1))
        out.append(pf.Fold(r, fit.order, fit.mean, fit.scale, w))
    return out


@pytest.mark.parametrize("group_bytes", [pf.GROUP_BYTES, 1])
def test_fits_equal_single_ones(spark, group_bytes):
    rows = rows_of(spark)
    folds = folds_of(rows)
    betas = pf.fit_prefixes(rows, folds, [2, 3, 5, 7], group_bytes=group_bytes)
    assert set(betas) == {(f, m) for f in (0, 1) for m in (2, 3, 5, 7)}
    for fold in folds:
        z = dn.zscore_apply_arrays(rows.where(F.col("sets")[fold.number] == 1), fold.mean, fold.scale)
        for m in (2, 7):
            tr = ln.class_weights(z.withColumn("features", array_to_vector(F.array(*[F.col("z")[j] for j in fold.order[:m]]))))
            n = tr.agg(F.sum("w")).first()[0]
            model = LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", maxIter=2000, tol=1e-14, regParam=1.0 / n,
                                       standardization=False).fit(tr)
            want = [model.intercept, *model.coefficients.toArray()]
            assert betas[fold.number, m] == pytest.approx(want, abs=1e-6)


def test_size_groups_hold_every_size():
    sizes = list(range(2, 300, 3))
    groups = pf.size_groups(sizes, 4, 1 << 20)
    assert [m for g in groups for m in g] == sizes and len(groups) > 1
    assert all(len(g) == 1 or sum(16 * (m + 1) * (m + 2) for m in g) <= 1 << 20 for g in groups)


def test_one_class_is_refused(spark):
    rows = rows_of(spark).withColumn("y", F.lit(1))
    with pytest.raises(ValueError):
        pf.train_weights(rows, 2)


def test_inner_selection_scores_every_size(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 12))
    y = (x[:, 3] - x[:, 5] + 0.2 * rng.normal(size=200) > 0).astype(int)
    train = spark.createDataFrame([(k, r.tolist(), int(c)) for k, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    got = dq.inner_selection(spark, train).collect()
    assert {(r["fold"], r["m"]) for r in got} == {(f, m) for f in range(4) for m in range(2, 13)}
    best = dn.best_size(spark.createDataFrame(got)).first()
    assert best["mean_metric"] > 0.95


def test_scores_are_those_of_the_coefficients(spark):
    rows = rows_of(spark)
    folds = folds_of(rows)
    betas = pf.fit_prefixes(rows, folds, [2, 7])
    preds = pf.score_prefixes(rows, folds, betas)
    n = [rows.where(F.col("sets")[r] == 0).count() for r in (0, 1)]
    got = {(r["fold"], r["m"]): r["n"] for r in preds.groupBy("fold", "m").agg(F.count("p").alias("n")).collect()}
    assert got == {(f, m): n[f] for f in (0, 1) for m in (2, 7)}
    auc = {(r["fold"], r["m"]): r["auc"] for r in rank.rank_sum_test(preds, "p", "y", ["fold", "m"]).collect()}
    assert all(v > 0.6 for v in auc.values())
