"""Small frame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, scalars: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the columns of a one-row frame (an ungrouped aggregate) to every row.

    The one-row side has a proven size (exactly one row), so it is broadcast
    and joined on a constant key: no shuffle of ``df``, no cross join."""
    one = F.broadcast(scalars.withColumn("_k", F.lit(0)))
    return df.withColumn("_k", F.lit(0)).join(one, "_k", how).drop("_k")
