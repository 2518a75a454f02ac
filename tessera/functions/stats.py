"""Distribution tails for test statistics.

Spark SQL has no ``erf``/``erfc``; p-values are computed by Arrow-batched
pandas UDFs.  They are applied only to the final, per-group result rows
(a handful per test family), never to row-sized data.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(DoubleType())
def _two_sided_normal(z: pd.Series) -> pd.Series:
    zz = z.to_numpy(dtype=float, na_value=np.nan)
    out = np.minimum(1.0, _erfc(np.abs(np.nan_to_num(zz, nan=0.0)) / math.sqrt(2.0)))
    out[np.isnan(zz)] = np.nan
    return pd.Series(out)


def normal_two_sided_p(z: Column | str) -> Column:
    """p = min(1, erfc(|z| / sqrt(2))): two-sided normal tail."""
    z = F.col(z) if isinstance(z, str) else z
    return _two_sided_normal(z)


#: Largest samples whose p is exact; the normal approximation takes over beyond.
EXACT_SIGNED, EXACT_RANK_SUM = 50, 40


def _two_sided(counts: np.ndarray, seen: int) -> float:
    """Twice the smaller tail of a null distribution at ``seen``, at most 1."""
    return float(min(1.0, 2.0 * min(counts[:seen + 1].sum(), counts[seen:].sum()) / counts.sum()))


@lru_cache(maxsize=4096)
def signed_rank_null(ranks: tuple[int, ...]) -> np.ndarray:
    """Number of sign assignments by the sum of the positive ones among ``ranks`` (ranks
    doubled, so that tied ones are whole numbers)."""
    counts = np.zeros(sum(ranks) + 1)
    counts[0] = 1.0
    for r in ranks:
        counts[r:] += counts[:len(counts) - r].copy()
    return counts


def signed_rank_exact_p(w_plus: float, n: int) -> float:
    """Exact two-sided p of W+ for n differences without ties or zeros."""
    return _two_sided(signed_rank_null(tuple(range(2, 2 * n + 1, 2))), round(2 * w_plus)) if n > 0 else float("nan")


@lru_cache(maxsize=4096)
def rank_sum_null(ties: tuple[int, ...], n_pos: int) -> np.ndarray:
    """Number of choices of ``n_pos`` of the values by their sum of doubled average
    ranks; ``ties``: how many values are equal, in order of the values."""
    n = sum(ties)
    counts = np.zeros((n_pos + 1, 2 * n * n_pos + 1))
    counts[0, 0] = 1.0
    before = 0
    for t in ties:
        rank = 2 * before + t + 1
        new = counts.copy()
        for k in range(1, min(t, n_pos) + 1):
            new[k:, k * rank:] += math.comb(t, k) * counts[:-k, :counts.shape[1] - k * rank]
        counts, before = new, before + t
    return counts[n_pos]


@F.pandas_udf(DoubleType())
def _signed_rank_p(w_plus: pd.Series, w_minus: pd.Series, ranks: pd.Series) -> pd.Series:
    out = []
    for wp, wm, r in zip(w_plus, w_minus, ranks):
        k = 0 if r is None else len(r)
        if not k:
            out.append(np.nan)
        elif k <= EXACT_SIGNED:
            out.append(_two_sided(signed_rank_null(tuple(int(x) for x in r)), round(2 * wp)))
        else:
            half = np.asarray(r, float) / 2.0
            out.append(min(1.0, math.erfc(abs(min(wp, wm) - half.sum() / 2.0) / math.sqrt(2.0 * (half @ half) / 4.0))))
    return pd.Series(out, dtype=float)


def signed_rank_p(w_plus: str, w_minus: str, ranks: str) -> Column:
    """Two-sided Wilcoxon signed-rank p from W+, W- and the doubled ranks of the
    non-zero differences (one per split).

    Exact, with ties, for up to ``EXACT_SIGNED`` differences, otherwise the normal
    approximation with the variance of the tied ranks."""
    return _signed_rank_p(F.col(w_plus), F.col(w_minus), F.col(ranks))


@F.pandas_udf(DoubleType())
def _rank_sum_p(n: pd.Series, n_pos: pd.Series) -> pd.Series:
    out = []
    for ties, pos in zip(n, n_pos):
        ties, pos = np.asarray(ties, int), np.asarray(pos, int)
        chosen = int(pos.sum())
        if not 0 < chosen < ties.sum():
            out.append(np.nan)
            continue
        ranks = 2 * (np.cumsum(ties) - ties) + ties + 1
        out.append(_two_sided(rank_sum_null(tuple(ties.tolist()), chosen), int(pos @ ranks)))
    return pd.Series(out, dtype=float)


def rank_sum_exact_p(n: Column, n_pos: Column) -> Column:
    """Exact two-sided rank-sum p from the counts of the distinct values in order: all
    rows and positive rows of each; missing where a class is empty."""
    return _rank_sum_p(n, n_pos)
