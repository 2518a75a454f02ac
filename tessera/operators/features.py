"""Feature preparation (PR6, PR7, PR8): ordered projection, block assembly
and imputation by a column statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import rank


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR6: ordered column projection by a declared list."""
    return df.select(*cols)


def column_statistics(df: DataFrame, cols: Sequence[str], strategy: str) -> dict[str, float]:
    """Per-column fill values: ``mean`` / ``median`` over finite values, or
    ``zero``; a column with no finite value gets 0.  One grouped pass over
    (column, value) rows; the result has one number per column."""
    if strategy == "zero":
        return {c: 0.0 for c in cols}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column", "value") \
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    if strategy == "mean":
        stats = long.groupBy("column").agg(F.avg("value").alias("stat"))
    elif strategy == "median":
        stats = rank.exact_quantile(long, "value", ["column"], 0.5).withColumnRenamed("quantile", "stat")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    got = {r["column"]: r["stat"] for r in stats.collect()}  # one row per column
    return {c: float(got[c]) if got.get(c) is not None else 0.0 for c in cols}


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean") -> DataFrame:
    """PR8: replace missing / non-finite values by the column statistic."""
    fill = column_statistics(df, cols, strategy)
    out = df
    for c in cols:
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        out = out.withColumn(c, F.when(bad, F.lit(fill[c])).otherwise(v))
    return out
