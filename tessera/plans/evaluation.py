"""Evaluation queries on F-SCORES (PR11-PR15, PR23, AG8, AG19-AG36, AG40, AG41,
JN13, WN7, TK2, TK4, TK5, ST3, ML20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.keys import mul_mod32
from tessera.functions.stats import signed_rank_p
from tessera.operators import evaluate as ev
from tessera.operators import learn as ln
from tessera.operators import rank
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query, r6
from tessera.plans.sql_fixtures import SCORES, with_
from tessera.sources.tables import table

G = ["fold", "model"]

# ----------------------------------------------------------------- oracle pieces
_AUC_CTE = """
rk AS (
  SELECT fold, model, y,
         (rank() OVER (PARTITION BY fold, model ORDER BY p)
          + (count(*) OVER (PARTITION BY fold, model, p) - 1) / 2.0)::DOUBLE AS ar
  FROM src),
auc AS (
  SELECT fold, model, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg,
         (sum(ar) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
           / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc
  FROM rk GROUP BY fold, model)
"""

_AP_CTE = """
dc AS (SELECT fold, model, p, count(*) AS n, sum(y) AS npos FROM src GROUP BY ALL),
cum AS (
  SELECT *, sum(npos) OVER (PARTITION BY fold, model ORDER BY p DESC) AS tp,
         sum(n) OVER (PARTITION BY fold, model ORDER BY p DESC) AS k,
         sum(npos) OVER (PARTITION BY fold, model) AS pp
  FROM dc),
ap AS (SELECT fold, model, sum(npos::DOUBLE / pp * tp / k) AS average_precision
       FROM cum WHERE pp > 0 GROUP BY fold, model)
"""


def _src_sql(clip: bool = False) -> str:
    p = "least(greatest(p, 1e-7), 1 - 1e-7)" if clip else "p"
    return f"src AS (SELECT fold, model, id, y, {p} AS p FROM scores_long)"


def _long(spark, sf_dir):
    return fx.scores_long(spark, sf_dir)


# ----------------------------------------------------------------- queries
@query("pr13_fusion_scores", with_(SCORES) + f"""
SELECT id, y, {r6('clipped_a', 'veto', 'mean_fusion', 'geometric')}, flag_a_05, flag_veto_07
FROM (SELECT id, y, least(greatest(p_a, 1e-7), 1 - 1e-7) AS clipped_a, p_a * p_b AS veto,
             0.5 * (p_a + p_b) AS mean_fusion,
             exp(0.5 * ln(least(greatest(p_a, 1e-7), 1 - 1e-7))
                 + 0.5 * ln(least(greatest(p_b, 1e-7), 1 - 1e-7))) AS geometric,
             coalesce(p_a >= 0.5, false) AS flag_a_05, coalesce(p_a * p_b >= 0.7, false) AS flag_veto_07
      FROM scores)""")
def pr13_fusion_scores(spark, sf_dir):
    """PR11 clip, PR13 veto, PR14 mean, PR23 geometric, PR15 flags."""
    s = fx.scores(spark, sf_dir)
    return finish(s.select(
        "id", "y", ev.clip_prob("p_a").alias("clipped_a"), ev.veto("p_a", "p_b").alias("veto"),
        ev.mean_fusion("p_a", "p_b").alias("mean_fusion"),
        ev.geometric_fusion("p_a", "p_b").alias("geometric"),
        ev.flag("p_a", 0.5).alias("flag_a_05"), ev.flag(ev.veto("p_a", "p_b"), 0.7).alias("flag_veto_07")))


@query("ag19_roc_auc", with_(SCORES, _src_sql(), _AUC_CTE) + f"""
SELECT fold, model, n_pos, n_neg, {r6('auc')} FROM auc""")
def ag19_roc_auc(spark, sf_dir):
    r = rank.rank_sum_test(_long(spark, sf_dir), "p", "y", G)
    return finish(r.select(*G, "n_pos", "n_neg", "auc"))


@query("ag20_average_precision", with_(SCORES, _src_sql(), _AP_CTE) + f"""
SELECT fold, model, {r6('average_precision')} FROM ap""")
def ag20_average_precision(spark, sf_dir):
    return finish(rank.average_precision(_long(spark, sf_dir), "p", "y", G))


_CONF_SQL = """
conf AS (
  SELECT fold, model,
         count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
         count(*) FILTER (WHERE NOT p >= 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE NOT p >= 0.5 AND y = 1) AS fn
  FROM scores_long GROUP BY fold, model)
"""


@query("ag22_confusion_rates", with_(SCORES, _CONF_SQL) + f"""
SELECT fold, model, tp, fp, tn, fn,
       {r6('fpr', 'recall', 'precision', 'f1', 'accuracy', 'balanced_accuracy')}
FROM (SELECT *, fp / greatest(fp + tn, 1)::DOUBLE AS fpr, tp / greatest(tp + fn, 1)::DOUBLE AS recall,
             CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1,
             (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy,
             0.5 * (tp / greatest(tp + fn, 1)::DOUBLE + tn / greatest(tn + fp, 1)::DOUBLE) AS balanced_accuracy
      FROM conf)""")
def ag22_confusion_rates(spark, sf_dir):
    """AG22 confusion counts with AG23/AG24 rates at 0.5."""
    return finish(ev.rates(ev.confusion(_long(spark, sf_dir), "p", "y", G, 0.5)))


@query("ag23_veto_effect", with_(SCORES) + f"""
SELECT fold, {r6('fpr_before', 'fpr_after', 'recall_before', 'recall_after')}, tp_lost,
       round(100.0 * (fpr_before - fpr_after) / greatest(fpr_before, 1e-9), 6) AS fpr_reduction_pct
FROM (SELECT fold,
        count(*) FILTER (WHERE y = 0 AND p_a >= 0.5) / greatest(count(*) FILTER (WHERE y = 0), 1)::DOUBLE AS fpr_before,
        count(*) FILTER (WHERE y = 0 AND p_a * p_b >= 0.5) / greatest(count(*) FILTER (WHERE y = 0), 1)::DOUBLE AS fpr_after,
        count(*) FILTER (WHERE y = 1 AND p_a >= 0.5) / greatest(count(*) FILTER (WHERE y = 1), 1)::DOUBLE AS recall_before,
        count(*) FILTER (WHERE y = 1 AND p_a * p_b >= 0.5) / greatest(count(*) FILTER (WHERE y = 1), 1)::DOUBLE AS recall_after,
        count(*) FILTER (WHERE y = 1 AND p_a >= 0.5 AND NOT p_a * p_b >= 0.5) AS tp_lost
      FROM scores GROUP BY fold)""")
def ag23_veto_effect(spark, sf_dir):
    s = fx.scores(spark, sf_dir).withColumn("veto", ev.veto("p_a", "p_b"))
    return finish(ev.veto_effect(s, "p_a", "veto", "y", ["fold"], 0.5))


@query("ag25_f1_optimal", with_(SCORES) + f"""
, dc AS (SELECT fold, model, p, count(*) AS n, sum(y) AS npos FROM scores_long GROUP BY ALL),
cum AS (
  SELECT *, sum(npos) OVER w AS tp, sum(n - npos) OVER w AS fpc,
         sum(npos) OVER (PARTITION BY fold, model) AS pp, sum(n - npos) OVER (PARTITION BY fold, model) AS nn
  FROM dc WINDOW w AS (PARTITION BY fold, model ORDER BY p DESC)),
f AS (SELECT fold, model, p, 2.0 * tp / (2 * tp + fpc + (pp - tp)) AS f1,
             fpc / greatest(nn, 1)::DOUBLE AS fpr, tp / greatest(pp, 1)::DOUBLE AS recall FROM cum),
mx AS (SELECT fold, model, max(f1) AS f1_opt FROM f GROUP BY ALL),
best AS (SELECT f.fold, f.model, mx.f1_opt, min(f.p) AS thr
         FROM f JOIN mx ON f.fold = mx.fold AND f.model = mx.model AND f.f1 = mx.f1_opt GROUP BY ALL)
SELECT b.fold, b.model, round(b.f1_opt, 6) AS f1_opt, round(b.thr, 6) AS threshold_f1_opt,
       round(f.fpr, 6) AS fpr_at_f1_opt, round(f.recall, 6) AS recall_at_f1_opt
FROM best b JOIN f ON b.fold = f.fold AND b.model = f.model AND b.thr = f.p""")
def ag25_f1_optimal(spark, sf_dir):
    return finish(ev.f1_optimal(_long(spark, sf_dir), "p", "y", G))


_EDGES10 = ", ".join(repr(e) for e in ev.inner_edges(10))
_EDGES25 = ", ".join(repr(e) for e in ev.inner_edges(25))


def _bin_sql(col: str, edges: str) -> str:
    return f"len(list_filter([{edges}]::DOUBLE[], lambda e: e <= {col}))"


_BINS_CTE = f"""
cb AS (SELECT fold, model, y::DOUBLE AS y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM scores_long),
bins AS (SELECT fold, model, {_bin_sql('p', _EDGES10)} AS bin, y, p FROM cb),
perbin AS (SELECT fold, model, bin, count(*) AS n_bin, avg(p) AS mean_p, avg(y) AS obs_rate
           FROM bins GROUP BY ALL),
perbin_w AS (SELECT *, n_bin / sum(n_bin) OVER (PARTITION BY fold, model) AS weight FROM perbin)
"""


@query("ag29_calibration_bins", with_(SCORES, _BINS_CTE) + f"""
SELECT fold, model, bin::INTEGER AS bin, n_bin, {r6('mean_p', 'obs_rate', 'weight')} FROM perbin_w""")
def ag29_calibration_bins(spark, sf_dir):
    b = ev.calibration_bins(_long(spark, sf_dir), "p", "y", G, 10)
    return finish(b.select(*G, "bin", "n_bin", "mean_p", "obs_rate", "weight"))


_METRICS_CTE = with_(SCORES, _src_sql(clip=True), _AUC_CTE, _BINS_CTE.strip().lstrip(",")) + """
, base AS (
  SELECT fold, model, avg((p - y) * (p - y)) AS brier,
         avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, stddev_pop(p) AS sharpness_std,
         CASE WHEN count(*) FILTER (WHERE p >= 0.7) > 0 THEN avg(y) FILTER (WHERE p >= 0.7) END AS precision_at_0_7,
         (count(*) FILTER (WHERE p >= 0.7))::DOUBLE / count(*) AS coverage_at_0_7,
         CASE WHEN count(*) FILTER (WHERE p >= 0.9) > 0 THEN avg(y) FILTER (WHERE p >= 0.9) END AS precision_at_0_9,
         (count(*) FILTER (WHERE p >= 0.9))::DOUBLE / count(*) AS coverage_at_0_9,
         avg(y) AS base_rate
  FROM cb GROUP BY fold, model),
cal AS (
  SELECT w.fold, w.model, sum(weight * abs(mean_p - obs_rate)) AS ece,
         sum(weight * (mean_p - obs_rate) * (mean_p - obs_rate)) AS reliability,
         sum(weight * (obs_rate - b.base_rate) * (obs_rate - b.base_rate)) AS resolution
  FROM perbin_w w JOIN base b ON w.fold = b.fold AND w.model = b.model GROUP BY ALL),
metrics AS (
  SELECT b.*, c.ece, c.reliability, c.resolution, a.auc
  FROM base b JOIN cal c USING (fold, model) JOIN auc a USING (fold, model))
"""

_METRIC_COLS = ["brier", "log_loss", "ece", "reliability", "resolution", "sharpness_std",
                "precision_at_0_7", "coverage_at_0_7", "precision_at_0_9", "coverage_at_0_9",
                "base_rate", "auc"]


def _metrics(spark, sf_dir):
    return ev.confidence_metrics(_long(spark, sf_dir), "p", "y", G)


@query("ag26_confidence_metrics", _METRICS_CTE + f"""
SELECT fold, model, {r6(*_METRIC_COLS)} FROM metrics""")
def ag26_confidence_metrics(spark, sf_dir):
    """AG26-AG32 with AUC, per (fold, model)."""
    return finish(_metrics(spark, sf_dir).select(*G, *_METRIC_COLS))


def _metric_frame(spark, sf_dir):
    """ST3 long frame; undefined metrics (e.g. precision with nothing flagged) are dropped."""
    m = _metrics(spark, sf_dir)
    return m.unpivot(G, _METRIC_COLS, "metric", "value").where(F.col("value").isNotNull())


_FRAME_SQL = "frame AS (UNPIVOT metrics ON " + ", ".join(_METRIC_COLS) + \
    " INTO NAME metric VALUE value)"


@query("st03_metric_frame", _METRICS_CTE + ", " + _FRAME_SQL + """
SELECT fold, model, metric, round(value, 6) AS value FROM frame""")
def st03_metric_frame(spark, sf_dir):
    """ST3: per-split metric rows stacked in one long frame."""
    return finish(_metric_frame(spark, sf_dir).where(F.col("value").isNotNull()))


@query("ag34_split_summary", _METRICS_CTE + ", " + _FRAME_SQL + f"""
SELECT model, metric, {r6('mean', 'sd_pop', 'sd_samp')}, n_splits FROM (
  SELECT model, metric, avg(value) AS mean, stddev_pop(value) AS sd_pop,
         stddev_samp(value) AS sd_samp, count(*) AS n_splits
  FROM frame WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY model, metric)""")
def ag34_split_summary(spark, sf_dir):
    return finish(ev.split_summary(_metric_frame(spark, sf_dir), ["model", "metric"]))


_SIGNED_SQL = _METRICS_CTE + ", " + _FRAME_SQL + f"""
, base_rung AS (SELECT fold, metric, value AS bv FROM frame WHERE model = 'a'),
d AS (SELECT f.model, f.metric, f.fold, f.value - b.bv AS d
      FROM frame f JOIN base_rung b ON f.fold = b.fold AND f.metric = b.metric WHERE f.model <> 'a'),
nz AS (SELECT *, abs(d) AS ad FROM d WHERE d <> 0),
rk_abs AS (SELECT *, rank() OVER (PARTITION BY model, metric ORDER BY ad)
                 + (count(*) OVER (PARTITION BY model, metric, ad) - 1) / 2.0 AS r FROM nz),
ws AS (SELECT model, metric, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus,
              sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, count(*) AS n_nonzero
       FROM rk_abs GROUP BY ALL),
dl AS (SELECT model, metric, avg(d) AS delta, count(*) AS n_pairs FROM d GROUP BY ALL)
"""


@query("ag35_paired_signed_rank", _SIGNED_SQL + """
SELECT dl.model, dl.metric, round(delta, 6) AS delta, n_pairs, round(w_plus, 6) AS w_plus,
       round(w_minus, 6) AS w_minus, n_nonzero, round(least(w_plus, w_minus), 6) AS w_stat
FROM dl LEFT JOIN ws USING (model, metric)""")
def ag35_paired_signed_rank(spark, sf_dir):
    """AG35: mean paired difference vs model ``a`` and Wilcoxon W per (model, metric)."""
    r = ev.paired_signed_rank(_metric_frame(spark, sf_dir), "fold", "model", "metric", "a")
    return finish(r.select("model", "metric", "delta", "n_pairs", "w_plus", "w_minus",
                           "n_nonzero", "w_stat"))


@query("ag35_signed_rank_p", _SIGNED_SQL + """
, each AS (SELECT model, metric, r, row_number() OVER (PARTITION BY model, metric ORDER BY r) - 1 AS i,
                  count(*) OVER (PARTITION BY model, metric) AS n FROM rk_abs),
signs AS (SELECT model, metric, m, sum(CASE WHEN (m >> i::INTEGER) & 1 = 1 THEN r ELSE 0 END) AS w
          FROM each JOIN (SELECT unnest(range(0, 32)) AS m) ON m < (1 << n::INTEGER) GROUP BY ALL),
p AS (SELECT model, metric, avg((w <= w_plus)::INTEGER) AS lo, avg((w >= w_plus)::INTEGER) AS hi
      FROM signs JOIN ws USING (model, metric) GROUP BY ALL),
tie AS (SELECT model, metric, sum(c * c * c - c)::DOUBLE AS tie_term
        FROM (SELECT model, metric, ad, count(*) AS c FROM nz GROUP BY ALL) GROUP BY ALL)
SELECT dl.model, dl.metric, round(delta, 6) AS delta, n_pairs, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, n_nonzero,
       round(tie_term, 6) AS tie_term, round(least(w_plus, w_minus), 6) AS w_stat, CASE WHEN lo IS NOT NULL THEN round(least(1.0, 2 * least(lo, hi)), 6) END AS p_value
FROM dl LEFT JOIN ws USING (model, metric) LEFT JOIN p USING (model, metric) LEFT JOIN tie USING (model, metric)""")
def ag35_signed_rank_p(spark, sf_dir):
    """AG35 with p-values: exact, with ties, for few splits; normal approximation otherwise."""
    r = ev.paired_signed_rank(_metric_frame(spark, sf_dir), "fold", "model", "metric", "a")
    return finish(r.withColumn("p_value", signed_rank_p("w_plus", "w_minus", "ranks")).drop("ranks"))


@query("ag33_reliability_pooled", with_(SCORES) + f"""
, cb AS (SELECT model, y::DOUBLE AS y, least(greatest(p, 1e-7), 1 - 1e-7) AS p FROM scores_long),
b AS (SELECT model, {_bin_sql('p', _EDGES10)} AS bin, y, p FROM cb)
SELECT model, bin::INTEGER AS bin, count(*) AS n_bin, {r6('mean_p', 'obs_rate')} FROM (
  SELECT model, bin, y, p, avg(p) OVER (PARTITION BY model, bin) AS mean_p,
         avg(y) OVER (PARTITION BY model, bin) AS obs_rate FROM b)
GROUP BY model, bin, mean_p, obs_rate""")
def ag33_reliability_pooled(spark, sf_dir):
    """AG33: reliability points pooled over splits."""
    return finish(ev.reliability_curve(_long(spark, sf_dir), "p", "y", ["model"], 10))


@query("ag33_score_histogram", with_(SCORES) + f"""
SELECT model, {_bin_sql('p', _EDGES25)}::INTEGER AS bin, count(*) AS n
FROM scores_long WHERE p BETWEEN 0 AND 1 GROUP BY ALL""")
def ag33_score_histogram(spark, sf_dir):
    return ev.score_histogram(_long(spark, sf_dir), "p", ["model"], 25)


@query("ag21_rmse", with_(SCORES) + """
SELECT model, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM scores_long GROUP BY model""")
def ag21_rmse(spark, sf_dir):
    return finish(ev.rmse(_long(spark, sf_dir), "p", "y", ["model"]))


@query("ag36_matched_precision", with_(SCORES) + f"""
, nt AS (SELECT fold, count(*) FILTER (WHERE p_a * p_b >= 0.7) AS n_top FROM scores GROUP BY fold),
ranked AS (SELECT s.fold, s.model, s.y, n_top,
                  row_number() OVER (PARTITION BY s.fold, s.model ORDER BY s.p DESC, s.id) AS rn
           FROM scores_long s JOIN nt ON s.fold = nt.fold WHERE s.model IN ('a', 'veto', 'mean'))
SELECT fold, model, n_top, sum(y) FILTER (WHERE rn <= n_top)::BIGINT AS pos_top,
       round(CASE WHEN n_top > 0 THEN sum(y) FILTER (WHERE rn <= n_top)::DOUBLE / n_top END, 6) AS matched_precision
FROM ranked GROUP BY fold, model, n_top""")
def ag36_matched_precision(spark, sf_dir):
    """AG36/WN7: precision of the n most confident rows per (fold, score),
    n = rows the veto keeps at 0.7."""
    s = fx.scores(spark, sf_dir)
    n_top = s.groupBy("fold").agg(F.count_if(ev.veto("p_a", "p_b") >= 0.7).alias("n_top"))
    lng = _long(spark, sf_dir).where(F.col("model").isin("a", "veto", "mean"))
    models = lng.select("fold", "model").distinct()
    nt = models.join(n_top, "fold", "inner")
    r = ev.top_n_positives(lng, "p", "y", "id", nt, G)
    return finish(r.select(*G, "n_top", "pos_top", "matched_precision"))


@query("ag36_top_fifth_precision", with_(SCORES) + f"""
, nt AS (SELECT fold, (count(*) + 4) // 5 AS n_top FROM scores GROUP BY fold),
ranked AS (SELECT s.fold, s.model, s.y, n_top,
                  row_number() OVER (PARTITION BY s.fold, s.model ORDER BY s.p DESC, s.id) AS rn
           FROM scores_long s JOIN nt ON s.fold = nt.fold)
SELECT fold, model, n_top, sum(y) FILTER (WHERE rn <= n_top)::BIGINT AS pos_top,
       round(sum(y) FILTER (WHERE rn <= n_top)::DOUBLE / n_top, 6) AS matched_precision
FROM ranked GROUP BY fold, model, n_top""")
def ag36_top_fifth_precision(spark, sf_dir):
    """AG36: precision of the most confident fifth of the rows per (fold, score)."""
    n_top = fx.scores(spark, sf_dir).groupBy("fold").agg(F.floor((F.count(F.lit(1)) + 4) / 5).cast("long").alias("n_top"))
    lng = _long(spark, sf_dir)
    nt = lng.select("fold", "model").distinct().join(n_top, "fold", "inner")
    r = ev.top_n_positives(lng, "p", "y", "id", nt, G)
    return finish(r.select(*G, "n_top", "pos_top", "matched_precision"))


@query("jn13_paired_join", with_(SCORES) + """
, a AS (SELECT fold, id FROM scores_long WHERE model = 'a'),
b AS (SELECT s.fold, s.id FROM scores_long s JOIN events e ON s.id = e.event_id
      WHERE s.model = 'b' AND e.event_type <> 'error')
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
       (SELECT count(*) FROM a JOIN b USING (fold, id)) AS n_paired,
       (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n_only_a,
       (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_only_b""")
def jn13_paired_join(spark, sf_dir):
    """JN13: paired held-out rows of two models; model b does not score error events."""
    lng = _long(spark, sf_dir)
    a = lng.where(F.col("model") == "a")
    errors = table(spark, sf_dir, "events").where(F.col("event_type") == "error") \
        .select(F.col("event_id").alias("id"))
    b = lng.where(F.col("model") == "b").join(errors, "id", "left_anti")
    return ev.paired_rows(a, b, ["fold", "id"])


@query("tk05_split_list", with_(SCORES) + """
SELECT DISTINCT fold FROM scores""")
def tk05_split_list(spark, sf_dir):
    """TK5: distinct split ids (sorted by the consumer)."""
    return fx.scores(spark, sf_dir).select("fold").distinct().orderBy("fold")


@query("ml20_replay", with_(SCORES, _src_sql(), _AUC_CTE, _AP_CTE, _CONF_SQL) + f"""
SELECT fold, model, n_pos, n_neg, {r6('auc', 'average_precision')}, tp, fp, tn, fn,
       round(fp / greatest(fp + tn, 1)::DOUBLE, 6) AS fpr, round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall
FROM auc JOIN ap USING (fold, model) JOIN conf USING (fold, model)""")
def ml20_replay(spark, sf_dir):
    """ML20: all metrics recomputed from a stored long prediction table, per (split, model)."""
    lng = _long(spark, sf_dir)
    return finish(ev.rates(ev.threshold_metrics(lng, "p", "y", G, 0.5)).select(
        *G, "n_pos", "n_neg", "auc", "average_precision", "tp", "fp", "tn", "fn", "fpr", "recall"))


def _events_p(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    p = (F.pmod(mul_mod32(F.col("event_id"), 2654435761), F.lit(1000)) / 1000.0).cast("double")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("family"), p.alias("p"))


@query("ag08_bh_adjust", """
WITH ev AS (SELECT event_id AS id, event_type AS family,
                   (((event_id * 2654435761) % 4294967296 % 1000) / 1000.0)::DOUBLE AS p FROM events),
q AS (SELECT *, p * count(*) OVER (PARTITION BY family)
                / row_number() OVER (PARTITION BY family ORDER BY p) AS qv FROM ev),
adj AS (SELECT *, least(1.0, min(qv) OVER (PARTITION BY family ORDER BY p DESC
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pa FROM q)
SELECT id, family, p, round(min(pa) OVER (PARTITION BY family, p), 6) AS p_adjusted,
       min(pa) OVER (PARTITION BY family, p) < 0.05 AS significant
FROM adj""")
def ag08_bh_adjust(spark, sf_dir):
    """AG8/WN5: Benjamini-Hochberg within each event-type family over all events."""
    out = rank.bh_adjust(_events_p(spark, sf_dir), "p", ["family"])
    return finish(out.select("id", "family", "p", "p_adjusted",
                             (F.col("p_adjusted") < 0.05).alias("significant")))


def _blend_grid(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    return ln.blend_grid(s.select("id", "y", F.col("p_a").alias("p")), s.select("id", F.col("p_b").alias("p")))


_GRID_SQL = with_(SCORES) + """
, grid AS (SELECT k / 40.0 AS w, y, (k / 40.0) * p_a + (1 - k / 40.0) * p_b AS p
           FROM scores, range(41) t(k)),
rk AS (SELECT w, y, (rank() OVER (PARTITION BY w ORDER BY p)
                     + (count(*) OVER (PARTITION BY w, p) - 1) / 2.0)::DOUBLE AS ar FROM grid),
aucw AS (SELECT w, (sum(ar) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
                   / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc FROM rk GROUP BY w)
"""


@query("ag40_blend_grid", _GRID_SQL + """
SELECT round(w, 6) AS w, round(auc, 6) AS auc FROM aucw""")
def ag40_blend_grid(spark, sf_dir):
    """AG40: AUC of w*a + (1-w)*b for 41 weights (rows generated per weight, not joined)."""
    return finish(_blend_grid(spark, sf_dir).select("w", F.col("metric").alias("auc")))


@query("tk02_best_blend", _GRID_SQL + """
SELECT round(min(w), 6) AS best_w, round(max(auc), 6) AS best_auc
FROM aucw WHERE auc = (SELECT max(auc) FROM aucw)""")
def tk02_best_blend(spark, sf_dir):
    """TK2: best weight; ties -> the first (smallest) weight."""
    best = ln.best_blend(_blend_grid(spark, sf_dir))
    return finish(best.select("best_w", F.col("best_metric").alias("best_auc")))


@query("ag41_lift", _GRID_SQL + """
SELECT round(max(auc) - greatest(max(auc) FILTER (WHERE w = 0), max(auc) FILTER (WHERE w = 1)), 6) AS lift,
       round(greatest(max(auc) FILTER (WHERE w = 0), max(auc) FILTER (WHERE w = 1)), 6) AS best_single
FROM aucw""")
def ag41_lift(spark, sf_dir):
    """AG41: best blend AUC over the best single model (higher is better for AUC)."""
    return finish(ln.best_blend(_blend_grid(spark, sf_dir)).select("lift", "best_single"))


@query("tk04_model_ranking", with_(SCORES) + """
, src AS (SELECT 0 AS fold, model, id, y, p FROM scores_long)
, """ + _AUC_CTE.strip() + """
SELECT model, round(auc, 6) AS auc, row_number() OVER (ORDER BY auc DESC, model) AS position FROM auc""")
def tk04_model_ranking(spark, sf_dir):
    """TK4: models ordered by pooled AUC (ties by name)."""
    r = rank.rank_sum_test(_long(spark, sf_dir), "p", "y", ["model"]).select("model", "auc")
    # one row per model: ordering a model-count-sized table
    from pyspark.sql import Window
    w = Window.orderBy(F.col("auc").desc(), F.col("model"))
    return finish(r.withColumn("position", F.row_number().over(w).cast("bigint")))
