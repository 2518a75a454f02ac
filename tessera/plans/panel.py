"""Entry 1 queries on F-PANEL: group comparison per target."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import compare, rank
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query, r6
from tessera.plans.sql_fixtures import PANEL_LONG, with_
from tessera.sources.tables import table


def _result(spark, sf_dir, with_p=True):
    return compare.compare_targets(fx.panel_long(spark, sf_dir), fx.targets(spark), with_p=with_p)


@query("compare_targets")
def compare_targets(spark, sf_dir):
    """Flagship: medians by cohort, shift, U/z/AUC, p and BH-adjusted p per target."""
    return finish(_result(spark, sf_dir, True))


@query("pr05_missing_filter", with_(PANEL_LONG) + """
SELECT target, cohort, count(*) AS n FROM panel_long GROUP BY target, cohort""")
def pr05_missing_filter(spark, sf_dir):
    return (fx.panel_long(spark, sf_dir).groupBy("target", "cohort")
            .agg(F.count(F.lit(1)).alias("n")))


@query("ag03_group_medians", with_(PANEL_LONG) + f"""
SELECT target, cohort, n, {r6('median')} FROM (
  SELECT target, cohort, count(*) AS n, median(score) AS median FROM panel_long GROUP BY ALL)""")
def ag03_group_medians(spark, sf_dir):
    st = compare.target_stats(compare.target_scan(fx.panel_long(spark, sf_dir)))
    parts = [st.select("target", F.lit(c).alias("cohort"), F.col(f"n_{c}").alias("n"),
                       F.col(f"median_{c}").alias("median")) for c in compare.COHORTS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("n") > 0)
    return finish(out)


_MEDIANS = with_(PANEL_LONG) + """
, med AS (
  SELECT t.ord, t.target, t.role,
         count(*) FILTER (WHERE cohort = 'active') AS n_active,
         count(*) FILTER (WHERE cohort = 'inactive') AS n_inactive,
         count(*) FILTER (WHERE cohort = 'screen') AS n_screen,
         median(score) FILTER (WHERE cohort = 'active') AS median_active,
         median(score) FILTER (WHERE cohort = 'inactive') AS median_inactive,
         median(score) FILTER (WHERE cohort = 'screen') AS median_screen
  FROM panel_long p JOIN targets t USING (target) GROUP BY ALL)
"""


@query("ag04_median_shift", _MEDIANS + f"""
SELECT ord, target, role, n_active, n_inactive, n_screen,
       {r6('median_active', 'median_inactive', 'median_screen')},
       round(median_active - median_inactive, 6) AS delta,
       (median_active - median_inactive) < 0 AS expected_trend
FROM med""")
def ag04_median_shift(spark, sf_dir):
    """AG4 + JN3 + PR20: per target medians, shift and trend flag."""
    r = _result(spark, sf_dir, with_p=False)
    return finish(r.select("ord", "target", "role", "n_active", "n_inactive", "n_screen",
                           "median_active", "median_inactive", "median_screen",
                           "delta", "expected_trend"))


@query("ag05_median_range", _MEDIANS + """
SELECT round_even(min(round_even(median_screen, 3)), 2) AS range_min,
       round_even(max(round_even(median_screen, 3)), 2) AS range_max FROM med""")
def ag05_median_range(spark, sf_dir):
    return compare.median_range(_result(spark, sf_dir, with_p=False))


@query("ag06_anomalous_target", _MEDIANS + """
SELECT min_by(target, CASE WHEN NOT (median_active - median_inactive < 0) THEN ord END) AS anomalous_target,
       count(*) FILTER (WHERE median_active - median_inactive < 0) AS n_expected,
       count(*) AS n_targets
FROM med""")
def ag06_anomalous_target(spark, sf_dir):
    return compare.anomalous_target(_result(spark, sf_dir, with_p=False))


@query("ag07_rank_test", with_(PANEL_LONG) + f"""
, two AS (SELECT target, cohort, score FROM panel_long WHERE cohort IN ('active', 'inactive')),
rk AS (
  SELECT target, cohort,
         (rank() OVER (PARTITION BY target ORDER BY score)
          + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0)::DOUBLE AS ar
  FROM two),
ties AS (
  SELECT target, sum(c * c * c - c) AS tie_term
  FROM (SELECT target, score, count(*)::DOUBLE AS c FROM two GROUP BY ALL) GROUP BY target),
agg AS (
  SELECT target, count(*) FILTER (WHERE cohort = 'active') AS n_pos,
         count(*) FILTER (WHERE cohort = 'inactive') AS n_neg,
         sum(ar) FILTER (WHERE cohort = 'active') AS r1
  FROM rk GROUP BY target),
u AS (
  SELECT a.target, n_pos, n_neg, tie_term,
         r1 - n_pos::DOUBLE * (n_pos + 1) / 2 AS u_pos,
         n_pos::DOUBLE * n_neg AS nn, (n_pos + n_neg)::DOUBLE AS n
  FROM agg a JOIN ties USING (target))
SELECT target, n_pos, n_neg, {r6('tie_term', 'u_pos')}, round(nn - u_pos, 6) AS u_neg,
       round((greatest(u_pos, nn - u_pos) - nn / 2 - 0.5)
             / sqrt(nn / 12 * ((n + 1) - tie_term / (n * (n - 1)))), 6) AS z,
       round(u_pos / nn, 6) AS auc
FROM u""")
def ag07_rank_test(spark, sf_dir):
    st = compare.target_stats(compare.target_scan(fx.panel_long(spark, sf_dir)))
    return finish(st.select("target", F.col("n_active").alias("n_pos"), F.col("n_inactive").alias("n_neg"),
                            "tie_term", "u_pos", "u_neg", "z", "auc"))


@query("ag07_small_sample_p", """
WITH l AS (SELECT l_orderkey AS o, l_extendedprice AS v, (l_returnflag = 'R')::INTEGER AS y FROM lineitem),
r AS (SELECT o, y, rank() OVER (PARTITION BY o ORDER BY v) + (count(*) OVER (PARTITION BY o, v) - 1) / 2.0 AS r,
             row_number() OVER (PARTITION BY o ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY o) AS n,
             sum(y) OVER (PARTITION BY o) AS n1 FROM l),
seen AS (SELECT o, any_value(n) AS n, any_value(n1) AS n1, sum(r) FILTER (WHERE y = 1) AS w FROM r GROUP BY o),
mask AS (SELECT o, m FROM (SELECT o, n1, unnest(range(0, (1::BIGINT << n::INTEGER))) AS m FROM seen WHERE n1 > 0 AND n1 < n)
         WHERE bit_count(m) = n1),
w AS (SELECT r.o, m, sum(CASE WHEN (m >> i::INTEGER) & 1 = 1 THEN r ELSE 0 END) AS w FROM r JOIN mask USING (o) GROUP BY r.o, m),
p AS (SELECT w.o, avg((w.w <= s.w)::INTEGER) AS lo, avg((w.w >= s.w)::INTEGER) AS hi FROM w JOIN seen s USING (o) GROUP BY w.o)
SELECT s.o AS order_key, n1::BIGINT AS n_pos, (n - n1)::BIGINT AS n_neg, round(coalesce(s.w, 0) - n1 * (n1 + 1) / 2.0, 6) AS u_pos,
       CASE WHEN lo IS NOT NULL THEN round(least(1.0, 2 * least(lo, hi)), 6) END AS p_value, true AS is_exact
FROM seen s LEFT JOIN p USING (o)""")
def ag07_small_sample_p(spark, sf_dir):
    """AG7 with exact p: per order, the prices of its returned lines against the others'."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return finish(rank.rank_sum_p(li, "v", "y", ["order_key"]))
