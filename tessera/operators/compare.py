"""Group comparison per target (PR5, AG3-AG8, JN3, PR20): Entry 1.

Input is a long table (cohort, target, score) whose missing scores are
already dropped per target.  One map-side-combined value-count table
(target, v) -> count per cohort, scanned once with bucketed prefix sums,
feeds both the exact medians of every cohort and the rank test, so the
row-sized data is shuffled once and windowed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import normal_two_sided_p
from tessera.operators import rank
from tessera.session import retain


COHORTS = ("active", "inactive", "screen")


def target_scan(long: DataFrame, target: str = "target", cohort: str = "cohort",
                value: str = "score", cohorts=COHORTS) -> DataFrame:
    """One value-count row per (target, v) with a count column per cohort and
    the exclusive prefix sums of each count in ascending v within the target.

    This single bucketed scan serves the medians of every cohort and the
    rank test (average ranks over active + inactive)."""
    counts = [F.count_if(F.col(cohort) == c).alias(f"n_{c}") for c in cohorts]
    vc = long.where(F.col(value).isNotNull()).groupBy(target, F.col(value).alias("v")).agg(*counts)
    return rank.prefix_sums(vc, [target], [f"n_{c}" for c in cohorts])


def target_stats(scan: DataFrame, target: str = "target", cohorts=COHORTS,
                 active: str = "active", inactive: str = "inactive") -> DataFrame:
    """Per target: rows and exact interpolated median per cohort (AG3), and
    the Mann-Whitney U of active vs inactive with tie term, z and AUC (AG7)."""
    j = scan
    aggs = []
    for c in cohorts:
        n, cum, N = F.col(f"n_{c}"), F.col(f"cum_n_{c}"), F.col(f"tot_n_{c}")
        lo = F.floor((N - 1) / 2.0)
        hi = F.ceil((N - 1) / 2.0)
        inside = lambda pos: (n > 0) & (pos >= cum) & (pos <= cum + n - 1)
        aggs += [F.max(F.when(inside(lo), F.col("v"))).alias(f"_lo_{c}"),
                 F.max(F.when(inside(hi), F.col("v"))).alias(f"_hi_{c}"),
                 F.first(N).alias(f"_cnt_{c}")]
    m = F.col(f"n_{active}") + F.col(f"n_{inactive}")
    avg_rank = F.col(f"cum_n_{active}") + F.col(f"cum_n_{inactive}") + (m + 1) / 2.0
    md = m.cast("double")
    aggs += [F.sum(F.col(f"n_{active}") * avg_rank).alias("_r1"),
             F.sum(md * md * md - md).alias("tie_term")]
    st = j.groupBy(target).agg(*aggs)
    out = st.select(target, "tie_term", "_r1",
                    *[F.col(f"_cnt_{c}").cast("bigint").alias(f"n_{c}") for c in cohorts],
                    *[((F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2.0).cast("double").alias(f"median_{c}")
                      for c in cohorts])
    n1, n0 = F.col(f"n_{active}").cast("double"), F.col(f"n_{inactive}").cast("double")
    nn = n1 + n0
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n0 / 12.0 * ((nn + 1) - F.try_divide(F.col("tie_term"), nn * (nn - 1))))
    out = out.withColumn("u_pos", u1).withColumn("u_neg", n1 * n0 - u1)
    return (out.withColumn("z", F.try_divide(F.greatest("u_pos", "u_neg") - n1 * n0 / 2.0 - 0.5, sigma))
            .withColumn("auc", F.try_divide(F.col("u_pos"), n1 * n0)).drop("_r1"))


def compare_targets(long: DataFrame, dims: DataFrame, with_p: bool = True,
                    alpha: float = 0.001) -> DataFrame:
    """Entry 1: per target medians by cohort, shift, rank test and (optionally)
    p-values with Benjamini-Hochberg adjustment across targets.

    Row-sized work: one scan/join, one map-side-combined value count, one
    bucketed prefix-sum pass; everything after that has one row per target.
    ``dims`` is the target dimension (ord, target, role); AQE broadcasts it
    from its measured size (no unchecked hint)."""
    st = target_stats(target_scan(long))
    wide = st.withColumn("delta", F.col("median_active") - F.col("median_inactive")) \
             .withColumn("expected_trend", F.col("delta") < 0)  # PR20
    out = dims.join(wide.withColumnRenamed("u_pos", "u_stat"), "target", "inner")
    out = out.select("ord", "target", "role", "n_active", "n_inactive", "n_screen", "median_active",
                     "median_inactive", "median_screen", "delta", "expected_trend", "u_stat", "tie_term",
                     "z", "auc")
    if not with_p:
        return out
    # persisted before the p-value UDF and the BH scan, so the row-sized pipeline runs once
    out = out.transform(retain)
    out = out.withColumn("p_value", normal_two_sided_p("z"))
    # family = the targets of this comparison
    out = rank.bh_adjust(out, "p_value")
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def anomalous_target(result: DataFrame) -> DataFrame:
    """AG6: first target in dimension order without the expected trend (one row, may be NULL)."""
    return result.agg(
        F.min_by("target", F.when(~F.col("expected_trend"), F.col("ord"))).alias("anomalous_target"),
        F.count_if(F.col("expected_trend")).cast("bigint").alias("n_expected"),
        F.count(F.lit(1)).cast("bigint").alias("n_targets"))


def median_range(result: DataFrame, column: str = "median_screen") -> DataFrame:
    """AG5: min / max over targets of the 3-dp rounded medians, then 2 dp (half-even)."""
    r3 = F.bround(F.col(column), 3)
    return result.agg(F.bround(F.min(r3), 2).alias("range_min"),
                      F.bround(F.max(r3), 2).alias("range_max"))
