"""Audit queries (JN14, AG42, AG43, ML19): computed numbers from F-SCORES and
F-DOCS checked against a fixed expected-value table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit as au
from tessera.operators import evaluate as ev
from tessera.operators import rank
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query, r6
from tessera.plans.sql_fixtures import DOCS, SCORES, with_

# fixed values: expected numbers with tolerances (metric, expected, tolerance, kind)
EXPECTED = [
    ("auc_a", 0.85, 0.10, "abs"),
    ("auc_veto", 0.85, 0.10, "abs"),
    ("ap_a", 0.80, 0.15, "abs"),
    ("fpr_before", 0.30, 0.10, "max"),
    ("fpr_after", 0.10, 0.05, "max"),
    ("fpr_reduction_pct", 40.0, 0.0, "min"),
    ("active_share", 0.85, 0.05, "rel"),
    ("auc_external", 0.90, 0.02, "abs"),
]
# fixed values: claims (claim, metric, op, threshold, part)
CLAIMS = [
    ("veto_lowers_fpr", "fpr_reduction_pct", "gt", 0.0, "direction"),
    ("veto_lowers_fpr", "fpr_reduction_pct", "ge", 40.0, "magnitude"),
    ("veto_keeps_ranking", "auc_veto", "ge", 0.80, "direction"),
    ("veto_keeps_ranking", "auc_veto", "ge", 0.90, "magnitude"),
    ("labelled_mostly_active", "active_share", "gt", 0.5, "direction"),
    ("external_model_strong", "auc_external", "ge", 0.90, "direction"),
]
# fixed values: published numbers per endpoint (endpoint, metric, published)
PUBLISHED = [("a", "auc", 0.90), ("b", "auc", 0.85), ("veto", "auc", 0.88),
             ("mean", "auc", 0.90), ("a", "rmse", 0.40)]


def _computed(spark, sf_dir):
    s = fx.scores(spark, sf_dir).withColumn("veto", ev.veto("p_a", "p_b")).withColumn("_g", F.lit(0))
    lng = s.unpivot(["_g", "id", "y"], ["p_a", "veto"], "model", "p")
    auc = rank.rank_sum_test(lng, "p", "y", ["_g", "model"]).select(
        F.concat(F.lit("auc_"), F.regexp_replace("model", "^p_", "")).alias("metric"), F.col("auc").alias("computed"))
    ap = rank.average_precision(s, "p_a", "y", ["_g"]).select(F.lit("ap_a").alias("metric"),
                                                               F.col("average_precision").alias("computed"))
    eff = ev.veto_effect(s, "p_a", "veto", "y", ["_g"], 0.5)
    rates = eff.unpivot(["_g"], ["fpr_before", "fpr_after", "fpr_reduction_pct"], "metric", "computed") \
        .drop("_g")
    d = fx.docs(spark, sf_dir)
    share = d.agg((F.count_if(F.col("cohort") == "active")
                   / F.greatest(F.count_if(F.col("cohort") != "screen"), F.lit(1))).alias("computed")) \
        .select(F.lit("active_share").alias("metric"), "computed")
    return auc.unionByName(ap).unionByName(rates).unionByName(share)


def _expected(spark):
    return spark.createDataFrame(EXPECTED, "metric string, expected double, tolerance double, kind string")


_COMPUTED_SQL = with_(SCORES, DOCS) + """
, rk AS (SELECT m, y, rank() OVER (PARTITION BY m ORDER BY p)
                  + (count(*) OVER (PARTITION BY m, p) - 1) / 2.0 AS ar
         FROM (SELECT 'auc_a' AS m, y, p_a AS p FROM scores UNION ALL SELECT 'auc_veto', y, p_a * p_b FROM scores)),
aucs AS (SELECT m AS metric, (sum(ar) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
                   / (sum(y)::DOUBLE * (count(*) - sum(y))) AS computed FROM rk GROUP BY m),
dc AS (SELECT p_a AS p, count(*) AS n, sum(y) AS npos FROM scores GROUP BY p_a),
cum AS (SELECT *, sum(npos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k,
               sum(npos) OVER () AS pp FROM dc),
ap AS (SELECT 'ap_a' AS metric, sum(npos::DOUBLE / pp * tp / k) AS computed FROM cum),
r AS (SELECT count(*) FILTER (WHERE y = 0 AND p_a >= 0.5) / greatest(count(*) FILTER (WHERE y = 0), 1)::DOUBLE AS fb,
             count(*) FILTER (WHERE y = 0 AND p_a * p_b >= 0.5) / greatest(count(*) FILTER (WHERE y = 0), 1)::DOUBLE AS fa
      FROM scores),
rates AS (SELECT 'fpr_before' AS metric, fb AS computed FROM r UNION ALL SELECT 'fpr_after', fa FROM r
          UNION ALL SELECT 'fpr_reduction_pct', 100.0 * (fb - fa) / greatest(fb, 1e-9) FROM r),
share AS (SELECT 'active_share' AS metric,
                 count(*) FILTER (WHERE cohort = 'active') / greatest(count(*) FILTER (WHERE cohort <> 'screen'), 1)::DOUBLE
                   AS computed FROM docs),
computed AS (SELECT * FROM aucs UNION ALL SELECT * FROM ap UNION ALL SELECT * FROM rates UNION ALL SELECT * FROM share),
expected(metric, expected, tolerance, kind) AS (VALUES """ + ", ".join(
    f"('{m}', {e}::DOUBLE, {t}::DOUBLE, '{k}')" for m, e, t, k in EXPECTED) + """),
joined AS (SELECT e.*, c.computed FROM expected e LEFT JOIN computed c USING (metric)),
checks AS (SELECT *, coalesce(CASE kind WHEN 'abs' THEN abs(computed - expected) <= tolerance
                                        WHEN 'rel' THEN abs(computed - expected) <= tolerance * abs(expected)
                                        WHEN 'min' THEN computed >= expected - tolerance
                                        WHEN 'max' THEN computed <= expected + tolerance END, false) AS match
           FROM joined)
"""


@query("jn14_expected_join", _COMPUTED_SQL + f"""
SELECT metric, {r6('expected', 'tolerance')}, kind, round(computed, 6) AS computed FROM joined""")
def jn14_expected_join(spark, sf_dir):
    """JN14: expected values joined to the computed metrics."""
    return finish(au.expected_join(_computed(spark, sf_dir), _expected(spark)))


@query("ag42_audit_checks", _COMPUTED_SQL + f"""
SELECT metric, {r6('expected', 'tolerance')}, kind, round(computed, 6) AS computed, match FROM checks""")
def ag42_audit_checks(spark, sf_dir):
    j = au.expected_join(_computed(spark, sf_dir), _expected(spark))
    return finish(au.audit_checks(j))


@query("ag42_audit_summary", _COMPUTED_SQL + """
SELECT count(*) AS n_checks, count(*) FILTER (WHERE match) AS n_matched,
       coalesce(string_agg(CASE WHEN NOT match THEN metric END, ',' ORDER BY metric), '') AS failures
FROM checks""")
def ag42_audit_summary(spark, sf_dir):
    j = au.expected_join(_computed(spark, sf_dir), _expected(spark))
    return au.audit_summary(au.audit_checks(j))


@query("ag43_claims", _COMPUTED_SQL + """
, claims(claim, metric, op, threshold, part) AS (VALUES """ + ", ".join(
    f"('{c}', '{m}', '{o}', {t}::DOUBLE, '{p}')" for c, m, o, t, p in CLAIMS) + """),
cj AS (SELECT cl.*, c.computed,
              coalesce(CASE op WHEN 'lt' THEN c.computed < threshold WHEN 'le' THEN c.computed <= threshold
                               WHEN 'gt' THEN c.computed > threshold WHEN 'ge' THEN c.computed >= threshold END,
                       false) AS ok
       FROM claims cl LEFT JOIN computed c USING (metric)),
per AS (SELECT claim,
               coalesce(bool_and(ok) FILTER (WHERE part = 'direction'), true) AS direction_ok,
               coalesce(bool_and(ok) FILTER (WHERE part = 'magnitude'), true) AS magnitude_ok,
               bool_and(computed IS NOT NULL) AS verifiable FROM cj GROUP BY claim)
SELECT claim, direction_ok, magnitude_ok, verifiable, direction_ok AND magnitude_ok AND verifiable AS holds FROM per""")
def ag43_claims(spark, sf_dir):
    """AG43: claims with separate direction and magnitude flags; unverifiable -> false."""
    claims = spark.createDataFrame(CLAIMS, "claim string, metric string, op string, threshold double, part string")
    return au.evaluate_claims(_computed(spark, sf_dir), claims)


@query("ml19_benchmark_validation", with_(SCORES) + """
, rk AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p)
                    + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS ar FROM scores_long),
measured AS (
  SELECT model AS endpoint, 'auc' AS metric,
         (sum(ar) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y)))
           AS measured FROM rk GROUP BY model
  UNION ALL SELECT 'a', 'rmse', sqrt(avg((p_a - y) * (p_a - y))) FROM scores),
published(endpoint, metric, published) AS (VALUES """ + ", ".join(
    f"('{e}', '{m}', {p}::DOUBLE)" for e, m, p in PUBLISHED) + """)
SELECT p.endpoint, p.metric, round(p.published, 6) AS published, round(m.measured, 6) AS measured,
       round(m.measured - p.published, 6) AS delta,
       coalesce(CASE WHEN p.metric IN ('auc', 'roc_auc', 'average_precision', 'accuracy')
                     THEN m.measured >= p.published ELSE m.measured <= p.published END, false) AS beats
FROM published p LEFT JOIN measured m USING (endpoint, metric)""")
def ml19_benchmark_validation(spark, sf_dir):
    """ML19: measured vs published per endpoint, direction-aware."""
    lng = fx.scores_long(spark, sf_dir)
    auc = rank.rank_sum_test(lng, "p", "y", ["model"]).select(
        F.col("model").alias("endpoint"), F.lit("auc").alias("metric"), F.col("auc").alias("measured"))
    rm = ev.rmse(fx.scores(spark, sf_dir).withColumn("endpoint", F.lit("a")), "p_a", "y", ["endpoint"]) \
        .select("endpoint", F.lit("rmse").alias("metric"), F.col("rmse").alias("measured"))
    pub = spark.createDataFrame(PUBLISHED, "endpoint string, metric string, published double")
    return finish(au.benchmark_validation(auc.unionByName(rm), pub)
                  .select("endpoint", "metric", "published", "measured", "delta", "beats"))
