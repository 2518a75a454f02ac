"""Spark ML scorers and the evaluation protocols built on them (ML1-ML8,
ML11, ML13-ML17, AG40, AG41, TK2, TK4).

Each fit is a distributed Spark ML job; independent fits (folds, variants,
rungs) are submitted concurrently from a small driver thread pool, which is
how one Spark application overlaps many small jobs.  Scores come back as long
prediction tables (split, model, id, y, p) that the ``evaluate`` operators
summarise in grouped passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.operators import rank
from tessera.session import retain

# fixed values: learner settings of the reference protocol
GBT_STEP = 0.05
GBT_VALIDATION_FRACTION = 0.1
LOGISTIC_C = 1.0
RIDGE_ALPHA = 1.0
#: Rows of a partition of small training sets: an iterative fit is hundreds of jobs, each of
#: which pays for every task.
FIT_ROWS = 4096
#: Numbers in a row of such a set; wider rows get more partitions.
FIT_WIDTH = 64


def in_few(df: DataFrame, n_rows: int, width: int = FIT_WIDTH) -> DataFrame:
    """Persisted rows that many small jobs read, in a partition per ``FIT_ROWS`` rows of
    ``FIT_WIDTH`` numbers; larger inputs keep their partitions."""
    return df.coalesce(max(1, -(-n_rows * width // (FIT_ROWS * FIT_WIDTH))))


def assemble(df: DataFrame, arrays: Sequence[str], out: str = "features") -> DataFrame:
    """PR7/FX6: concatenate array blocks (or scalar columns) into one ML
    vector, JVM-side."""
    from pyspark.sql.types import ArrayType
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.col(a) if isinstance(types[a], ArrayType) else F.array(F.col(a).cast("double"))
             for a in arrays]
    cat = F.concat(*parts) if len(parts) > 1 else parts[0]
    return df.withColumn(out, array_to_vector(cat))


def _validation_flag(df: DataFrame, id_col: str, frac: float) -> DataFrame:
    from tessera.operators.split import seeded_hash
    return df.withColumn("_is_val", F.pmod(seeded_hash(id_col, 7), F.lit(1000)) < int(frac * 1000))


def class_weights(df: DataFrame, y: str = "y", out: str = "w") -> DataFrame:
    """Balanced weights n / (2 n_c) (one small aggregation, joined by label)."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    w = with_scalars(c, n).select(y, (F.col("_n") / (2.0 * F.col("_nc"))).alias(out))
    return df.join(w, y, "inner")


def _p1(pred: DataFrame, keep: Sequence[str]) -> DataFrame:
    return pred.select(*keep, vector_to_array("probability")[1].alias("p"))


def fit_gbt(train: DataFrame, test: DataFrame, keep: Sequence[str] = ("id", "y"),
            max_iter: int = 400, max_depth: int = 3, seed: int = 42) -> DataFrame:
    """ML1: boosted trees, step 0.05, early stopping on a 10 % hash-held-out
    validation part of the training rows; P(class 1) on the test rows."""
    tr = _validation_flag(train, "id", GBT_VALIDATION_FRACTION)
    m = GBTClassifier(labelCol="y", featuresCol="features", maxIter=max_iter, stepSize=GBT_STEP,
                      maxDepth=max_depth, validationIndicatorCol="_is_val", seed=seed).fit(tr)
    return _p1(m.transform(test), keep)


def fit_logistic(train: DataFrame, test: DataFrame, keep: Sequence[str] = ("id", "y"),
                 balanced: bool = True, max_iter: int = 200, weighted: bool = False) -> DataFrame:
    """ML2: L2 logistic regression, C = 1, balanced class weights, on
    pre-standardised input (regParam = 1 / (C * sum of weights)).
    ``weighted``: the training frame already carries the weight column ``w``."""
    if weighted:
        tr = train
    else:
        tr = class_weights(train) if balanced else train.withColumn("w", F.lit(1.0))
    n = tr.agg(F.sum("w")).first()[0] or 1.0
    m = LogisticRegression(labelCol="y", featuresCol="features", weightCol="w", maxIter=max_iter,
                           regParam=1.0 / (LOGISTIC_C * max(n, 1)), elasticNetParam=0.0,
                           standardization=False).fit(tr)
    return _p1(m.transform(test), keep)


def fit_linear_svc(train: DataFrame, test: DataFrame, keep: Sequence[str] = ("id", "y"),
                   max_iter: int = 100) -> DataFrame:
    """ML3: linear SVM; the score is the raw margin of class 1."""
    m = LinearSVC(labelCol="y", featuresCol="features", maxIter=max_iter).fit(train)
    return m.transform(test).select(*keep, vector_to_array("rawPrediction")[1].alias("p"))


def fit_forest(train: DataFrame, test: DataFrame, keep: Sequence[str] = ("id", "y"),
               n_trees: int = 100, seed: int = 42) -> DataFrame:
    """ML5: randomised forest classifier."""
    m = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=n_trees,
                               seed=seed).fit(train)
    return _p1(m.transform(test), keep)


def fit_regressor(train: DataFrame, test: DataFrame, kind: str = "gbt",
                  keep: Sequence[str] = ("id", "y"), max_iter: int = 400, seed: int = 42) -> DataFrame:
    """ML4: regression for RMSE endpoints (``gbt``, ``forest`` or ``linear``)."""
    if kind == "gbt":
        train = _validation_flag(train, "id", GBT_VALIDATION_FRACTION)
        est = GBTRegressor(labelCol="y", featuresCol="features", maxIter=max_iter, stepSize=GBT_STEP,
                           validationIndicatorCol="_is_val", seed=seed)
    elif kind == "forest":
        est = RandomForestRegressor(labelCol="y", featuresCol="features", numTrees=100, seed=seed)
    else:
        # ridge alpha on the summed squared error is alpha / n on Spark's mean loss, which
        # divides the penalty by the label's standard deviation once more
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop("y")).first()
        est = LinearRegression(labelCol="y", featuresCol="features", regParam=RIDGE_ALPHA / max(1, n) * (sd or 1.0),
                               elasticNetParam=0.0, standardization=False)
    return est.fit(train).transform(test).select(*keep, F.col("prediction").alias("p"))


Fitter = Callable[[DataFrame, DataFrame], DataFrame]


def run_parallel(tasks: Sequence[tuple[dict, Callable[[], DataFrame]]],
                 threads: int = 8) -> DataFrame:
    """Run independent fit tasks concurrently; each returns a prediction
    frame, tagged with its literal columns and unioned."""
    def one(t):
        tags, fn = t
        out = fn()
        for k, v in tags.items():
            out = out.withColumn(k, F.lit(v))
        return out

    # fits (the expensive, action-triggering part) run concurrently
    with ThreadPoolExecutor(max_workers=threads) as pool:
        frames = list(pool.map(one, tasks))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cv_predictions(df: DataFrame, fold_col: str, fitter: Fitter, model: str,
                   threads: int = 8) -> DataFrame:
    """ML13/ML14: out-of-fold predictions; every row is scored once by the
    model that did not see its fold.  Returns (fold, model, id, y, p)."""
    return cv_predictions_many(df, fold_col, {model: fitter}, threads)


def cv_predictions_many(df: DataFrame, fold_col: str, fitters: dict[str, Fitter],
                        threads: int = 8) -> DataFrame:
    """Out-of-fold predictions of several learners: all (learner, fold) fits
    are independent, so they share one thread pool and one persisted input."""
    # every fit reads the same assembled rows: compute their lineage once.  Each pass of a tree
    # learner shuffles its histograms once per partition, whatever the rows: no more than cores
    df = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).transform(retain)
    kept, df = df, in_few(df, df.count())
    folds = [r[0] for r in df.select(fold_col).distinct().orderBy(fold_col).collect()]
    tasks = []
    for model, fitter in fitters.items():
        for f in folds:
            tr = df.where(F.col(fold_col) != f)
            te = df.where(F.col(fold_col) == f)
            tasks.append(({"fold": int(f), "model": model},
                          (lambda tr=tr, te=te, fitter=fitter: fitter(tr, te))))
    out = run_parallel(tasks, threads).transform(retain)
    out.count()
    kept.unpersist()
    return out


def cv_score(oof: DataFrame, task: str = "classification") -> DataFrame:
    """ML13: per-fold metric (AUC or RMSE), then mean and population sd."""
    if task == "classification":
        per = rank.rank_sum_test(oof, "p", "y", ["model", "fold"]).select("model", "fold",
                                                                         F.col("auc").alias("score"))
    else:
        per = oof.groupBy("model", "fold").agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("score"))
    return per.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"),
                                    F.count(F.lit(1)).alias("n_folds"))


def blend_grid(oof_a: DataFrame, oof_b: DataFrame, n_weights: int = 41,
               task: str = "classification") -> DataFrame:
    """AG40: metric of w*a + (1-w)*b for evenly spaced weights (rows are
    generated per weight; no join with a weight table)."""
    j = oof_a.select("id", "y", F.col("p").alias("pa")).join(
        oof_b.select("id", F.col("p").alias("pb")), "id", "inner")
    g = j.select("y", "pa", "pb", F.explode(F.sequence(F.lit(0), F.lit(n_weights - 1))).alias("k"))
    w = F.col("k") / float(n_weights - 1)
    g = g.select(w.alias("w"), "y", (w * F.col("pa") + (1 - w) * F.col("pb")).alias("p"))
    if task == "classification":
        return rank.rank_sum_test(g, "p", "y", ["w"]).select("w", F.col("auc").alias("metric"))
    return g.groupBy("w").agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("metric"))


def best_blend(grid: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """TK2 + AG41: first best weight (smallest w among ties) and the lift over
    the best single model (sign-aware)."""
    m = F.col("metric") if higher_is_better else -F.col("metric")
    best = grid.agg(F.max(F.struct(m.alias("_m"), (-F.col("w")).alias("_nw"))).alias("b"),
                    F.max(F.when(F.col("w") == 0, F.col("metric"))).alias("_b_only"),
                    F.max(F.when(F.col("w") == 1, F.col("metric"))).alias("_a_only"))
    sign = 1.0 if higher_is_better else -1.0
    best_metric = F.col("b._m") * sign
    single = F.greatest("_a_only", "_b_only") if higher_is_better else F.least("_a_only", "_b_only")
    return best.select((-F.col("b._nw")).alias("best_w"), best_metric.alias("best_metric"),
                       single.alias("best_single"),
                       ((best_metric - single) * sign).alias("lift"))
