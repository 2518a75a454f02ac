"""Dose queries on F-DOSE (PR16-PR19, ML18, AG37 by population)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dose as ds
from tessera.operators import rank
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query
from tessera.plans.sql_fixtures import DOSE, SCORES, with_


def _profile(spark, sf_dir):
    d = fx.dose(spark, sf_dir)
    return ds.aquatic_profile(d.withColumn("mgkg_a", ds.neglog_to_mgkg("p_value_a", "mw")),
                              "mw", ["p_value_a", "p_value_b"])


_PROFILE_SQL = """
, prof AS (
  SELECT *, pow(10.0, -p_value_a) * mw * 1000.0 AS mgkg_a,
         pow(10.0, -p_value_a) * 1000.0 AS a_mmol, pow(10.0, -p_value_a) * 1000.0 * mw AS a_mg,
         pow(10.0, -p_value_b) * 1000.0 AS b_mmol, pow(10.0, -p_value_b) * 1000.0 * mw AS b_mg,
         least(pow(10.0, -p_value_a) * 1000.0 * mw, pow(10.0, -p_value_b) * 1000.0 * mw) AS worst
  FROM dose),
cls AS (SELECT *, CASE WHEN worst <= 1.0 THEN 1 WHEN worst <= 10.0 THEN 2 WHEN worst <= 100.0 THEN 3 END AS hazard_class
        FROM prof)
"""


@query("pr16_dose_conversion", with_(DOSE) + _PROFILE_SQL + """
SELECT id, round(mgkg_a, 6) AS mgkg_a, round(-log10(mgkg_a / 1000.0 / mw), 6) AS p_back FROM prof""")
def pr16_dose_conversion(spark, sf_dir):
    """PR16: -log dose -> mg/kg and back."""
    p = _profile(spark, sf_dir)
    return finish(p.select("id", "mgkg_a", ds.mgkg_to_neglog("mgkg_a", "mw").alias("p_back")))


@query("pr17_concentration", with_(DOSE) + _PROFILE_SQL + """
SELECT id, round(a_mmol, 6) AS a_mmol_l, round(a_mg, 6) AS a_mg_l, round(b_mmol, 6) AS b_mmol_l,
       round(b_mg, 6) AS b_mg_l, round(worst, 6) AS worst_mg_l FROM prof""")
def pr17_concentration(spark, sf_dir):
    """PR17: mmol/L and mg/L per species and the worst over species."""
    p = _profile(spark, sf_dir)
    return finish(p.select("id", F.col("p_value_a_mmol_l").alias("a_mmol_l"),
                           F.col("p_value_a_mg_l").alias("a_mg_l"),
                           F.col("p_value_b_mmol_l").alias("b_mmol_l"),
                           F.col("p_value_b_mg_l").alias("b_mg_l"), "worst_mg_l"))


@query("pr18_hazard_class", with_(DOSE) + _PROFILE_SQL + """
SELECT hazard_class, count(*) AS n FROM cls GROUP BY hazard_class""")
def pr18_hazard_class(spark, sf_dir):
    """PR18: hazard class counts (NULL = above class 3, undefined)."""
    return _profile(spark, sf_dir).groupBy("hazard_class").agg(F.count(F.lit(1)).alias("n"))


@query("pr19_toxic_flag", with_(SCORES) + """
SELECT CASE WHEN p_a >= 0.5 THEN 'Toxic' ELSE 'Nontoxic' END AS label, count(*) AS n FROM scores GROUP BY ALL""")
def pr19_toxic_flag(spark, sf_dir):
    """PR19: probability >= 0.5 -> Toxic."""
    s = fx.scores(spark, sf_dir)
    return s.groupBy(ds.toxic_label("p_a").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("ml18_endpoint_profile", with_(DOSE) + _PROFILE_SQL + """
SELECT id, endpoint, round(value, 6) AS value FROM (
  UNPIVOT (SELECT id, mgkg_a, worst AS worst_mg_l, hazard_class::DOUBLE AS hazard_class,
                  p_value_a, p_value_b FROM cls)
  ON mgkg_a, worst_mg_l, hazard_class, p_value_a, p_value_b INTO NAME endpoint VALUE value)""")
def ml18_endpoint_profile(spark, sf_dir):
    """ML18: entities x endpoints long table (missing values dropped)."""
    p = _profile(spark, sf_dir)
    long = ds.endpoint_profile(p, "id", ["mgkg_a", "worst_mg_l", "hazard_class", "p_value_a", "p_value_b"])
    return finish(long.where(F.col("value").isNotNull()))


@query("ag37_dose_summary", with_(DOSE) + _PROFILE_SQL + """
SELECT population, count(*) AS n, round(median(worst), 6) AS median_worst_mg_l,
       round(100.0 * avg(CASE WHEN hazard_class <= 2 THEN 1.0 ELSE 0.0 END), 6) AS pct_class_le_2
FROM cls GROUP BY population""")
def ag37_dose_summary(spark, sf_dir):
    """AG37 by population: n, exact median worst concentration, share in classes 1-2."""
    p = _profile(spark, sf_dir)
    a = p.groupBy("population").agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.avg(F.when(F.col("hazard_class") <= 2, 1.0).otherwise(0.0))).alias("pct_class_le_2"))
    med = rank.exact_quantile(p, "worst_mg_l", ["population"], 0.5) \
        .withColumnRenamed("quantile", "median_worst_mg_l")
    return finish(a.join(med, "population", "left"))
