"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` (with optional oracle SQL)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = positive_zero(oracle)
        return fn
    return deco


def positive_zero(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` as ``(round(<expr>, 6) + 0.0)``.

    DuckDB rounds tiny negatives to -0.0 while Spark gives 0.0; adding 0.0
    turns -0.0 into +0.0, so both engines emit the same value."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero(sql[j + 6:k])
        call = f"round({inner})"
        out.append(sql[i:j])
        out.append(f"({call} + 0.0)" if inner.replace(" ", "").endswith(",6") else call)
        i = k + 1


def r6(*cols: str) -> str:
    """SQL select-list fragment rounding each column to 6 digits."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)
