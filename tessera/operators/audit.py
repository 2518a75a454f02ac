"""Audit of computed numbers against expected values (JN14, AG42, AG43, ML19).

Computed metrics arrive as a long (metric, computed) table; the expected
table (metric, expected, tolerance, kind) is small; AQE broadcasts it from
its measured size.  A check whose number could not be computed fails; a
claim with any unverifiable condition is false, never assumed true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("abs", "rel", "min", "max")


def expected_join(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """JN14: expected rows left-joined to computed metrics."""
    return expected.join(computed, "metric", "left")


def audit_checks(joined: DataFrame) -> DataFrame:
    """AG42 per check: |computed - expected| <= tol ('abs'), <= tol*|expected|
    ('rel'), computed >= expected - tol ('min') or <= expected + tol ('max')."""
    c, e, t, k = F.col("computed"), F.col("expected"), F.col("tolerance"), F.col("kind")
    ok = (F.when(k == "abs", F.abs(c - e) <= t)
          .when(k == "rel", F.abs(c - e) <= t * F.abs(e))
          .when(k == "min", c >= e - t)
          .when(k == "max", c <= e + t))
    return joined.withColumn("match", F.coalesce(ok, F.lit(False)))


def audit_summary(checks: DataFrame) -> DataFrame:
    """AG42 summary: checks, matches and the sorted list of failing metrics
    (the check list is fixed-size, so collecting names is bounded)."""
    fails = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("match"), F.col("metric")))), ",")
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("match").alias("n_matched"),
                      fails.alias("failures"))


def evaluate_claims(checks: DataFrame, claims: DataFrame) -> DataFrame:
    """AG43: claims (claim, metric, op, threshold, part) with part in
    {direction, magnitude}.  Each part is the AND of its conditions; a
    condition on a missing number is false."""
    j = claims.join(checks.select("metric", "computed"), "metric", "left")
    c, th, op = F.col("computed"), F.col("threshold"), F.col("op")
    cond = (F.when(op == "lt", c < th).when(op == "le", c <= th)
            .when(op == "gt", c > th).when(op == "ge", c >= th))
    j = j.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    per = j.groupBy("claim").agg(
        F.coalesce(F.bool_and(F.when(F.col("part") == "direction", F.col("_ok"))), F.lit(True)).alias("direction_ok"),
        F.coalesce(F.bool_and(F.when(F.col("part") == "magnitude", F.col("_ok"))), F.lit(True)).alias("magnitude_ok"),
        F.bool_and(c.isNotNull()).alias("verifiable"))
    return per.withColumn("holds", F.col("direction_ok") & F.col("magnitude_ok") & F.col("verifiable"))


def benchmark_validation(measured: DataFrame, published: DataFrame) -> DataFrame:
    """ML19: measured vs published per endpoint; ``beats`` is direction-aware
    (higher is better for AUC-like metrics, lower for error metrics)."""
    j = published.join(measured, ["endpoint", "metric"], "left")
    higher = F.col("metric").isin("auc", "roc_auc", "average_precision", "accuracy")
    beats = F.when(higher, F.col("measured") >= F.col("published")).otherwise(
        F.col("measured") <= F.col("published"))
    return j.withColumn("delta", F.col("measured") - F.col("published")) \
            .withColumn("beats", F.coalesce(beats, F.lit(False)))
