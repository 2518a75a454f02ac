"""Feature queries (PR6, PR8, FX5, FX6) and direct rank primitives (WN1, WN4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.descriptors import descriptor_panel, fingerprint_plus_descriptors, text_descriptors
from tessera.operators import features as fe
from tessera.operators import rank
from tessera.operators import similar as sm
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query
from tessera.plans.sql_fixtures import PANEL_LONG, SCORES, TOKENS, with_
from tessera.sources.tables import table


@query("pr06_column_projection", with_(PANEL_LONG) + """
SELECT cohort, count(*) AS n, round(sum(net_price), 6) AS net_price, round(sum(quantity), 6) AS quantity
FROM panel_wide GROUP BY cohort""")
def pr06_column_projection(spark, sf_dir):
    """PR6: a named, ordered subset of the score columns."""
    w = fe.project(fx.panel_wide(spark, sf_dir), ["cohort", "net_price", "quantity"])
    return finish(w.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("net_price").alias("net_price"),
                                          F.sum("quantity").alias("quantity")))


@query("pr08_imputation", with_(PANEL_LONG) + """
, st AS (SELECT avg(tax) AS mean_tax, median(tax) AS median_tax FROM panel_wide)
SELECT s.strategy, w.cohort, count(*) AS n,
       round(sum(coalesce(w.tax, CASE s.strategy WHEN 'mean' THEN st.mean_tax
                                                WHEN 'median' THEN st.median_tax ELSE 0.0 END)), 6) AS tax_sum
FROM panel_wide w, st, (VALUES ('mean'), ('median'), ('zero')) s(strategy)
GROUP BY s.strategy, w.cohort""")
def pr08_imputation(spark, sf_dir):
    """PR8: missing tax values filled by the mean, the exact median or zero."""
    w = fx.panel_wide(spark, sf_dir).select("cohort", "tax")
    out = None
    for strategy in ("mean", "median", "zero"):
        part = fe.impute(w, ["tax"], strategy).groupBy("cohort").agg(
            F.count(F.lit(1)).alias("n"), F.sum("tax").alias("tax_sum")).withColumn("strategy", F.lit(strategy))
        out = part if out is None else out.unionByName(part)
    return finish(out.select("strategy", "cohort", "n", "tax_sum"))


@query("wn01_average_ranks", with_(PANEL_LONG) + """
, two AS (SELECT target, score FROM panel_long WHERE cohort IN ('active', 'inactive'))
SELECT DISTINCT target, score AS v, count(*) OVER (PARTITION BY target, score) AS n,
       round(rank() OVER (PARTITION BY target ORDER BY score)
             + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0, 6) AS avg_rank
FROM two""")
def wn01_average_ranks(spark, sf_dir):
    """WN1: average rank of every distinct score per target (ties averaged)."""
    lng = fx.panel_long(spark, sf_dir).where(F.col("cohort").isin("active", "inactive"))
    r = rank.average_ranks(lng, "score", ["target"])
    return finish(r.select("target", F.col("v").cast("double").alias("v"), "n", "avg_rank"))


@query("wn04_cumulative_counts", with_(SCORES) + """
, dc AS (SELECT fold, model, p, count(*) AS n, sum(y) AS npos FROM scores_long GROUP BY ALL)
SELECT fold, model, round(p, 6) AS v, n, npos::BIGINT AS n_pos,
       (sum(npos) OVER w)::BIGINT AS tp, (sum(n - npos) OVER w)::BIGINT AS fp
FROM dc WINDOW w AS (PARTITION BY fold, model ORDER BY p DESC)""")
def wn04_cumulative_counts(spark, sf_dir):
    """WN4: positives / negatives at or above every distinct score."""
    dc = rank.descending_counts(fx.scores_long(spark, sf_dir), "p", "y", ["fold", "model"])
    return finish(dc.select("fold", "model", F.col("v").cast("double").alias("v"), "n", "n_pos", "tp", "fp"))


@query("fx05_descriptor_panel", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, length(t)::DOUBLE AS n_chars,
       len(list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> ''))::DOUBLE AS n_tokens,
       len(list_distinct(list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '')))::DOUBLE AS n_distinct_tokens,
       len(string_split(t, chr(10)))::DOUBLE AS n_lines,
       length(regexp_replace(t, '[^0-9]', '', 'g'))::DOUBLE AS n_digits,
       length(regexp_replace(t, '[^A-Z]', '', 'g'))::DOUBLE AS n_upper
FROM t""")
def fx05_descriptor_panel(spark, sf_dir):
    """FX5: declared per-document descriptors (JVM-side expressions)."""
    d = table(spark, sf_dir, "documents")
    desc = text_descriptors("text")
    names = ["n_chars", "n_tokens", "n_distinct_tokens", "n_lines", "n_digits", "n_upper"]
    return d.select("doc_id", *[desc[n].alias(n) for n in names])


@query("fx06_fingerprint_descriptors", with_(TOKENS) + """
, t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
toks AS (SELECT doc_id, t, list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '') AS tk FROM t),
nz AS (SELECT doc_id,
              (length(t) > 0)::INTEGER + (len(tk) > 0)::INTEGER + (len(list_distinct(tk)) > 0)::INTEGER + 1
              + (length(regexp_replace(t, '[^0-9]', '', 'g')) > 0)::INTEGER
              + (length(regexp_replace(t, '[^A-Z]', '', 'g')) > 0)::INTEGER
              + (length(regexp_replace(t, '[^[:punct:]]', '', 'g')) > 0)::INTEGER
              + (length(regexp_replace(t, '[^\\p{L}]', '', 'g')) > 0)::INTEGER
              + (len(tk) > 0)::INTEGER AS n_desc
       FROM toks)
SELECT nz.doc_id, 2057 AS width, (coalesce(s.nbits, 0) + n_desc)::INTEGER AS n_nonzero
FROM nz LEFT JOIN doc_size s ON nz.doc_id = s.doc_id""")
def fx06_fingerprint_descriptors(spark, sf_dir):
    """FX6: sparse fingerprint ++ dense descriptor panel as one ML vector."""
    from pyspark.ml.functions import vector_to_array
    d = table(spark, sf_dir, "documents").select(
        "doc_id", sm.token_fingerprint("text").alias("bits"), descriptor_panel("text").alias("desc"))
    v = fingerprint_plus_descriptors(d, "bits", "desc")
    arr = vector_to_array("features")
    return v.select("doc_id", F.size(arr).alias("width"),
                    F.size(F.filter(arr, lambda x: x != 0)).alias("n_nonzero"))
