"""Checked vector columns, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty, not zero, and holds no null
    or non-finite component."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vector.cast("array<double>")
    return F.coalesce(F.exists(F.coalesce(v, F.array()), lambda x: F.coalesce(x != 0, F.lit(False))) & ~F.exists(v, bad), F.lit(False))


@F.pandas_udf(T.BinaryType())
def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Doubles of a vector column as bytes (null for null; -0.0 as 0.0)."""
    for vectors in batches:
        yield pd.Series([None if v is None else (np.asarray(v, float) + 0.0).tobytes() for v in vectors], dtype=object)
