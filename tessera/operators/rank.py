"""Scalable ranks and cumulative counts (WN1, WN4, WN5, AG7, AG8, AG13, AG19, AG20).

``rank() OVER (ORDER BY v)`` without a partition sends every row to one task.
Everything here works on the *value-count table* instead: ties collapse in a
map-side-combined ``groupBy(groups, v)``, and prefix sums over it are computed
inside the ranges of a range partitioning on (groups, v, tie break) plus an
offset table with one row per (group, range).  The ranges come from Spark's
own sampling, in the columns' own types, so there is one code path at every
size, a hot group or a tied value is split like any other run of rows, and no
task holds more than a range.

Ranks are *average* ranks (ties share the mean of their positions), the
convention of rank tests, Spearman and ROC-AUC.  Missing values (NULL, NaN) are
never ranked, rows with a NULL label are not counted, and a NULL group is a
group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tessera.functions.frames import with_scalars
from tessera.functions.stats import EXACT_RANK_SUM, normal_two_sided_p, rank_sum_exact_p
from tessera.session import write_shared

BUCKET = "_bucket"


def present(df: DataFrame, column: str) -> Column:
    """True where ``column`` is neither NULL nor NaN."""
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) if isinstance(df.schema[column].dataType, (DoubleType, FloatType)) else c.isNotNull()


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the keys come from ``a``."""
    other = b.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    joined = a.join(other, [a[k].eqNullSafe(other[f"_key_{k}"]) for k in keys], how)
    return joined.drop(*[f"_key_{k}" for k in keys])


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = (),
                 label: str | None = None) -> DataFrame:
    """One row per (groups, v): ``n`` rows and ``n_pos`` positives (label 1)."""
    kept = df.where(present(df, value))
    aggs = [F.count(F.lit(1)).alias("n")]
    if label is not None:
        kept = kept.where(F.col(label).isNotNull())
        aggs.append(F.sum(F.col(label).cast("bigint")).alias("n_pos"))
    return kept.groupBy(*groups, F.col(value).alias("v")).agg(*aggs)


def add_ranges(vc: DataFrame, groups: Sequence[str], order_col: str = "v", n_buckets: int | None = None,
               tiebreak: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Range-partition by (groups, order, tie break) and attach the number of the
    range.  Numbers follow the order (with ``descending``, from the largest value of
    ``order_col``, in any type); AQE merges small ranges (not with an explicit
    ``n_buckets``).  Stored as a table: the totals and the scan must
    read the same ranges, also after an executor or a cached block is lost."""
    keys = [*groups, F.col(order_col).desc() if descending else order_col, *tiebreak]
    parts = vc.repartitionByRange(n_buckets, *keys) if n_buckets else vc.repartitionByRange(*keys)
    return write_shared(parts.withColumn(BUCKET, F.spark_partition_id()), "ranges")


def prefix_sums(vc: DataFrame, groups: Sequence[str], measures: Sequence[str],
                order_col: str = "v", descending: bool = False,
                n_buckets: int | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """For each row, ``cum_<m>`` = sum of ``m`` over rows strictly before it
    in ``order_col`` order within ``groups`` (exclusive prefix sum), and
    ``tot_<m>`` = sum over the group.
    ``tiebreak`` columns order rows with equal ``order_col``, always ascending.

    A window inside (groups, range) plus an offset per (group, range).
    """
    groups = list(groups)
    b = add_ranges(vc, groups, order_col, n_buckets, tiebreak, descending)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    before = Window.partitionBy(*groups, BUCKET).orderBy(order, *[F.col(t).asc() for t in tiebreak]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    within = b.select("*", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_in_{m}") for m in measures])
    totals = b.groupBy(*groups, BUCKET).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    earlier = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(*groups, BUCKET,
                            *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
                            *[F.sum(f"_t_{m}").over(whole).alias(f"tot_{m}") for m in measures])
    out = join_null_safe(within, offsets, [*groups, BUCKET])
    return out.select(*vc.columns, BUCKET, *[(F.col(f"_o_{m}") + F.col(f"_in_{m}")).alias(f"cum_{m}") for m in measures],
                      *[F.col(f"tot_{m}") for m in measures])


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (),
                  label: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """WN1: value-count table with ``avg_rank`` (1-based, ties averaged)."""
    vc = value_counts(df, value, groups, label)
    ps = prefix_sums(vc, groups, ["n"], n_buckets=n_buckets)
    return ps.withColumn("avg_rank", F.col("cum_n").cast("double") + (F.col("n") + 1) / 2.0)


def rank_sum_test(df: DataFrame, value: str, label: str, groups: Sequence[str] = (),
                  n_buckets: int | None = None) -> DataFrame:
    """AG7/AG19: Mann-Whitney U of label-1 vs label-0 values, per group.

    Columns: n_pos, n_neg, u_pos (U of the positive sample), u_neg,
    tie_term = sum(t^3 - t), z (two-sided, continuity 0.5, tie-corrected),
    auc = u_pos / (n_pos * n_neg) (NULL when a class is empty).
    """
    return rank_test_from_counts(value_counts(df, value, groups, label), groups, n_buckets)


def rank_test_from_counts(vc: DataFrame, groups: Sequence[str] = (),
                          n_buckets: int | None = None) -> DataFrame:
    """``rank_sum_test`` on a value-count table (groups, v, n, n_pos)."""
    ps = prefix_sums(vc, groups, ["n"], n_buckets=n_buckets)
    r = ps.withColumn("avg_rank", F.col("cum_n").cast("double") + (F.col("n") + 1) / 2.0)
    n = F.col("n").cast("double")
    agg = r.groupBy(*groups).agg(
        F.sum("n_pos").alias("n_pos"),
        (F.sum("n") - F.sum("n_pos")).alias("n_neg"),
        F.sum(F.col("n_pos") * F.col("avg_rank")).alias("_r1"),
        F.sum(n * n * n - n).alias("tie_term"))
    n1 = F.col("n_pos").cast("double")
    n0 = F.col("n_neg").cast("double")
    nn = n1 + n0
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2.0
    res = agg.withColumn("u_pos", u1).withColumn("u_neg", n1 * n0 - F.col("u_pos"))
    sigma = F.sqrt(n1 * n0 / 12.0 * ((nn + 1) - F.try_divide(F.col("tie_term"), nn * (nn - 1))))
    mu = n1 * n0 / 2.0
    return (res.withColumn("z", F.try_divide(F.greatest("u_pos", "u_neg") - mu - 0.5, sigma))
            .withColumn("auc", F.try_divide(F.col("u_pos"), n1 * n0))
            .drop("_r1"))


def rank_sum_p(df: DataFrame, value: str, label: str, groups: Sequence[str] = (), exact_n: int = EXACT_RANK_SUM) -> DataFrame:
    """AG7: U and its two-sided p per group: the exact permutation distribution, with
    ties, for groups of up to ``exact_n`` rows, the tie-corrected normal approximation
    beyond.  Columns: groups, n_pos, n_neg, u_pos, p_value, is_exact; p is missing
    where a class is empty."""
    groups = list(groups)
    vc = value_counts(df, value, groups, label)
    sizes = vc.groupBy(*groups).agg(F.sum("n").alias("_size"))
    sized = join_null_safe(vc, sizes, groups) if groups else with_scalars(vc, sizes)
    small, large = sized.where(F.col("_size") <= exact_n), sized.where(F.col("_size") > exact_n).drop("_size")
    # at most exact_n values in a list
    lists = small.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("v", "n", "n_pos"))).alias("c"),
                                       F.sum("n_pos").alias("n_pos"), (F.sum("n") - F.sum("n_pos")).alias("n_neg")).where("size(c) > 0")
    n, pos = F.col("c.n"), F.col("c.n_pos")
    before = F.transform(F.sequence(F.lit(1), F.size("c")), lambda k: F.aggregate(F.slice(n, 1, k - 1), F.lit(0).cast("long"), lambda a, x: a + x))
    ranks = F.zip_with(F.zip_with(n, before, lambda t, b: b + (t + 1) / 2.0), pos, lambda r, k: r * k)
    u = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    exact = lists.select(*groups, "n_pos", "n_neg", u.alias("u_pos"), rank_sum_exact_p(n, pos).alias("p_value"), F.lit(True).alias("is_exact"))
    normal = rank_test_from_counts(large, groups).select(
        *groups, "n_pos", "n_neg", "u_pos", normal_two_sided_p(F.greatest("z", F.lit(0.0))).alias("p_value"), F.lit(False).alias("is_exact"))
    both = exact.unionByName(normal.where("n_pos IS NOT NULL"))
    return both.withColumn("p_value", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("p_value")))


def exact_quantile(df: DataFrame, value: str, groups: Sequence[str] = (), q: float = 0.5,
                   n_buckets: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantile per group (``median`` for q=0.5).

    Same result as ``percentile``/numpy, but computed from cumulative counts:
    no group's values are ever held together in one task.
    """
    return quantile_from_counts(value_counts(df, value, groups), groups, q, n_buckets)


def quantile_from_counts(vc: DataFrame, groups: Sequence[str], q: float = 0.5,
                         n_buckets: int | None = None) -> DataFrame:
    """``exact_quantile`` on a value-count table (groups, v, n)."""
    groups = list(groups)
    pos = prefix_sums(vc, groups, ["n"], n_buckets=n_buckets).withColumnRenamed("tot_n", "_N")
    # 0-based fractional position h = q*(N-1); neighbours floor(h), floor(h)+1
    h = F.lit(q) * (F.col("_N") - 1)
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col("_N") - 1)
    start, end = F.col("cum_n"), F.col("cum_n") + F.col("n") - 1
    picked = pos.select(
        *groups, "v", h.alias("_h"), lo.alias("_lo"),
        ((lo >= start) & (lo <= end)).alias("_is_lo"),
        ((hi >= start) & (hi <= end)).alias("_is_hi"))
    picked = picked.where(F.col("_is_lo") | F.col("_is_hi"))
    agg = picked.groupBy(*groups).agg(
        F.max(F.when(F.col("_is_lo"), F.col("v"))).alias("_vlo"),
        F.max(F.when(F.col("_is_hi"), F.col("v"))).alias("_vhi"),
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"))
    frac = F.col("_h") - F.col("_lo")
    return agg.select(*groups, (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo")))
                      .cast("double").alias("quantile"))


def descending_counts(df: DataFrame, score: str, label: str, groups: Sequence[str] = (),
                      n_buckets: int | None = None) -> DataFrame:
    """WN4: per distinct score, rows/positives at or above it.

    Columns: groups, v, n, n_pos, tp (positives with score >= v), fp,
    pos_total, neg_total.
    """
    ps = prefix_sums(value_counts(df, score, groups, label), groups, ["n", "n_pos"], descending=True, n_buckets=n_buckets)
    tp = F.col("cum_n_pos") + F.col("n_pos")
    fp = (F.col("cum_n") + F.col("n")) - tp
    return ps.select(*groups, "v", "n", "n_pos", tp.alias("tp"), fp.alias("fp"), F.col("tot_n_pos").alias("pos_total"),
                     (F.col("tot_n") - F.col("tot_n_pos")).alias("neg_total"))


def average_precision(df: DataFrame, score: str, label: str, groups: Sequence[str] = (),
                      n_buckets: int | None = None) -> DataFrame:
    """AG20: step-wise AP = sum over distinct thresholds of dRecall * precision."""
    dc = descending_counts(df, score, label, groups, n_buckets)
    term = F.col("n_pos") / F.col("pos_total") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return dc.where(F.col("pos_total") > 0).groupBy(*groups).agg(F.sum(term).alias("average_precision"))


def bh_adjust(df: DataFrame, p: str, groups: Sequence[str] = (),
              n_buckets: int | None = None) -> DataFrame:
    """AG8/WN5: Benjamini-Hochberg step-up adjusted p per row, within ``groups``.

    ``q(p) = p * m / j`` with j = number of p-values <= p (ties take the
    largest position), then the running minimum from the largest p down,
    capped at 1.  Computed on distinct p-values and joined back on (groups, p).
    """
    groups = list(groups)
    df = df.withColumn(p, F.col(p).cast("double"))
    ps = prefix_sums(value_counts(df, p, groups), groups, ["n"], n_buckets=n_buckets)
    b = ps.withColumn("_q", F.col("v") * F.col("tot_n") / (F.col("cum_n") + F.col("n")))
    # running min from the top: min over p' >= p, range-wise like prefix_sums
    w_in = Window.partitionBy(*groups, BUCKET).orderBy(F.col("v").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    within = b.withColumn("_in", F.min("_q").over(w_in))
    tmin = b.groupBy(*groups, BUCKET).agg(F.min("_q").alias("_t"))
    w_off = Window.partitionBy(*groups).orderBy(F.col(BUCKET).desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    off = tmin.select(*groups, BUCKET, F.min("_t").over(w_off).alias("_o"))
    adj = join_null_safe(within, off, [*groups, BUCKET]).select(
        *groups, F.col("v").alias(p),
        F.least(F.lit(1.0), F.coalesce(F.least("_in", "_o"), F.col("_in"))).alias("p_adjusted"))
    return join_null_safe(df, adj, [*groups, p], "left")


def spearman_binary(long: DataFrame, feature: str, value: str, label: str,
                    n_buckets: int | None = None) -> DataFrame:
    """AG13: Spearman rho of each feature with a 0/1 label, average ranks.

    The label's average ranks take two values, so every sum the Pearson
    formula needs comes from the value-count table of the feature; no join
    back to rows.  Constant features give NULL (reported as 0 by callers).
    """
    r = average_ranks(long, value, [feature], label, n_buckets)
    n = F.col("n").cast("double")
    per = r.groupBy(feature).agg(
        F.sum("n").cast("double").alias("_N"), F.sum("n_pos").cast("double").alias("_P"),
        F.sum(n * F.col("avg_rank")).alias("_sx"),
        F.sum(n * F.col("avg_rank") * F.col("avg_rank")).alias("_sxx"),
        F.sum(F.col("n_pos") * F.col("avg_rank")).alias("_sx_pos"))
    N, P = F.col("_N"), F.col("_P")
    Q = N - P
    # label ranks: negatives share (Q+1)/2, positives share Q + (P+1)/2
    r0, r1 = (Q + 1) / 2.0, Q + (P + 1) / 2.0
    sy = Q * r0 + P * r1
    syy = Q * r0 * r0 + P * r1 * r1
    sxy = r0 * (F.col("_sx") - F.col("_sx_pos")) + r1 * F.col("_sx_pos")
    cov = sxy - F.col("_sx") * sy / N
    vx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / N
    vy = syy - sy * sy / N
    rho = F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))
    return per.select(feature, rho.alias("rho"))
