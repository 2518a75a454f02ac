"""Cohort queries on F-DOCS (SC1, PR1, PR3, AG1, AG2, AG37, AG39, WN2, JN1,
JN4-JN9, JN16, ST1, ST2, ST5, FX3, FX4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.functions.keys import group_key, identity_key, loose_identity_key, normalise_key
from tessera.operators import cohort as co
from tessera.operators import rank
from tessera.operators import split as sp
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query
from tessera.plans.sql_fixtures import DOCS, with_
from tessera.sources import scans
from tessera.sources.tables import table


def _docs(spark, sf_dir):
    return fx.docs(spark, sf_dir)


def _screen_first(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return co.first_occurrence(d.where(F.col("cohort") == "screen"), "key", "doc_id")


def _labelled(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("cohort") != "screen")


_DECON_SQL = """
, first_screen AS (SELECT key, min(doc_id) AS doc_id FROM docs WHERE cohort = 'screen' GROUP BY key),
decon AS (SELECT * FROM first_screen WHERE key NOT IN (SELECT key FROM docs WHERE cohort <> 'screen'))
"""


@query("sc01_cohort_scan", with_(DOCS) + """
SELECT doc_id, key, grp, cohort, quality FROM docs""")
def sc01_cohort_scan(spark, sf_dir):
    """SC1/PR2/FX4: keyed cohort table with identity key and role."""
    return _docs(spark, sf_dir).select("doc_id", "key", "grp", "cohort", "quality")


@query("sc01_missing_labels", """
SELECT doc_id::VARCHAR AS doc_id, quality::DOUBLE AS quality,
       CASE WHEN quality = 1 THEN 'active' WHEN quality = 0 THEN 'inactive' ELSE 'screen' END AS cohort
FROM documents LEFT JOIN labels USING (doc_id)""")
def sc01_missing_labels(spark, sf_dir):
    """SC1/PR2: the cohort scan of a table whose missing labels are NaN."""
    raw = table(spark, sf_dir, "documents").select("doc_id") \
        .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    raw = raw.withColumn("quality", F.coalesce(F.col("quality").cast("double"), F.lit(float("nan"))))
    return scans.cohort_scan(raw, "doc_id", "quality").select("doc_id", "quality", "cohort")


_REG_SQL = """
reg AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'x' || doc_id::VARCHAR
                    WHEN doc_id % 2 = 0 THEN lpad(doc_id::VARCHAR, 8, '0')
                    ELSE ' ' || doc_id::VARCHAR || ' ' END AS raw_id FROM labels)
"""


def _registry_ids(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id")
    s = F.col("doc_id").cast("string")
    raw = (F.when(F.pmod("doc_id", F.lit(11)) == 0, F.concat(F.lit("x"), s))
           .when(F.pmod("doc_id", F.lit(2)) == 0, F.lpad(s, 8, "0"))
           .otherwise(F.concat(F.lit(" "), s, F.lit(" "))))
    return lab.select(raw.alias("raw_id"))


@query("pr01_key_normalise", with_(_REG_SQL) + """
SELECT count(*) AS n_rows, count(TRY_CAST(trim(raw_id) AS BIGINT)) AS n_parsed,
       count(d.doc_id) AS n_matched
FROM reg LEFT JOIN documents d ON TRY_CAST(trim(raw_id) AS BIGINT) = d.doc_id""")
def pr01_key_normalise(spark, sf_dir):
    """PR1: zero-padded / space-padded / unparsable ids normalised and joined back."""
    reg = _registry_ids(spark, sf_dir).withColumn("k", normalise_key("raw_id"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.lit(1).alias("_hit"))
    j = reg.join(d, "k", "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("n_parsed"),
                 F.count("_hit").alias("n_matched"))


@query("pr03_validity_counts", """
SELECT count(*) AS n_total, count(*) FILTER (WHERE length(trim(text)) > 0) AS n_valid,
       count(*) FILTER (WHERE text IS NULL OR NOT length(trim(text)) > 0) AS n_dropped
FROM documents""")
def pr03_validity_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return co.validity_counts(d, F.length(F.trim("text")) > 0)


@query("ag01_cohort_counts", with_(DOCS) + """
SELECT cohort, count(*) AS n, count(DISTINCT key) AS n_keys,
       round((SELECT count(*) FILTER (WHERE cohort = 'active')
              / greatest(count(*) FILTER (WHERE cohort IN ('active', 'inactive')), 1)::DOUBLE FROM docs), 6)
         AS active_share
FROM docs GROUP BY cohort""")
def ag01_cohort_counts(spark, sf_dir):
    return finish(co.cohort_counts(_docs(spark, sf_dir)))


@query("ag02_selection_funnel", with_(DOCS) + _DECON_SQL + """
SELECT count(*) AS n_documents,
       count(*) FILTER (WHERE length(trim(text)) > 0) AS n_with_text,
       count(*) FILTER (WHERE cohort <> 'screen') AS n_labelled,
       count(*) FILTER (WHERE cohort = 'screen') AS n_screen,
       (SELECT count(*) FROM first_screen) AS n_screen_dedup,
       (SELECT count(*) FROM decon) AS n_screen_decontaminated
FROM docs""")
def ag02_selection_funnel(spark, sf_dir):
    """AG2: rows surviving each preparation stage."""
    d = _docs(spark, sf_dir)
    base = d.agg(F.count(F.lit(1)).alias("n_documents"),
                 F.count_if(F.length(F.trim("text")) > 0).alias("n_with_text"),
                 F.count_if(F.col("cohort") != "screen").alias("n_labelled"),
                 F.count_if(F.col("cohort") == "screen").alias("n_screen"))
    first = _screen_first(spark, sf_dir)
    dec = co.decontaminate(first, _labelled(spark, sf_dir))
    out = with_scalars(base, first.agg(F.count(F.lit(1)).alias("n_screen_dedup")))
    return with_scalars(out, dec.agg(F.count(F.lit(1)).alias("n_screen_decontaminated")))


@query("wn02_first_occurrence", with_(DOCS) + _DECON_SQL + """
SELECT key, doc_id FROM first_screen""")
def wn02_first_occurrence(spark, sf_dir):
    return _screen_first(spark, sf_dir)


@query("jn05_decontaminate", with_(DOCS) + _DECON_SQL + """
SELECT key, doc_id FROM decon""")
def jn05_decontaminate(spark, sf_dir):
    return co.decontaminate(_screen_first(spark, sf_dir), _labelled(spark, sf_dir))


@query("ag37_endpoint_summary", with_(DOCS) + """
, lab_keys AS (SELECT DISTINCT key FROM docs WHERE cohort <> 'screen'),
firsts AS (SELECT cohort, key, min(doc_id) AS doc_id FROM docs GROUP BY cohort, key),
lv AS (
  SELECT cohort, 'raw' AS level, doc_id FROM docs
  UNION ALL SELECT cohort, 'dedup', doc_id FROM firsts
  UNION ALL SELECT cohort, 'decontaminated', doc_id FROM firsts
    WHERE cohort = 'screen' AND key NOT IN (SELECT key FROM lab_keys))
SELECT lv.cohort AS population, level, count(*) AS n,
       round(100.0 * avg(d.toxic), 6) AS pct_toxic, round(median(d.n_chars)::DOUBLE, 6) AS median_n_chars
FROM lv JOIN docs d ON lv.doc_id = d.doc_id GROUP BY ALL""")
def ag37_endpoint_summary(spark, sf_dir):
    """AG37: per population and cleaning level: n, % toxic, exact median length."""
    d = _docs(spark, sf_dir)
    # first occurrence within each population: group by (cohort, key)
    firsts = d.groupBy("cohort", "key").agg(F.min("doc_id").alias("doc_id"))
    lab = d.where(F.col("cohort") != "screen")
    decon = co.decontaminate(firsts.where(F.col("cohort") == "screen"), lab)
    levels = (d.select("cohort", F.lit("raw").alias("level"), "doc_id")
              .unionByName(firsts.select("cohort", F.lit("dedup").alias("level"), "doc_id"))
              .unionByName(decon.select("cohort", F.lit("decontaminated").alias("level"), "doc_id")))
    rows = levels.join(d.select("doc_id", "toxic", "n_chars"), "doc_id", "inner") \
        .withColumnRenamed("cohort", "population")
    g = ["population", "level"]
    agg = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n"),
                               (100.0 * F.avg("toxic")).alias("pct_toxic"))
    med = rank.exact_quantile(rows, "n_chars", g, 0.5).withColumnRenamed("quantile", "median_n_chars")
    return finish(agg.join(med, g, "left"))


@query("jn06_identity_overlap", with_(DOCS) + """
, f AS (SELECT key, bool_or(cohort = 'active') AS a, bool_or(cohort = 'inactive') AS i,
               bool_or(cohort = 'screen') AS s FROM docs GROUP BY key)
SELECT 'active' AS cohort_a, 'inactive' AS cohort_b, count(*) FILTER (WHERE a AND i) AS n_shared_keys FROM f
UNION ALL SELECT 'active', 'screen', count(*) FILTER (WHERE a AND s) FROM f
UNION ALL SELECT 'inactive', 'screen', count(*) FILTER (WHERE i AND s) FROM f""")
def jn06_identity_overlap(spark, sf_dir):
    return co.identity_overlap(_docs(spark, sf_dir))


@query("jn07_feature_coverage", with_(DOCS) + """
SELECT cohort, count(*) AS n, count(e.vec_id) AS n_with_features,
       count(*) FILTER (WHERE e.vec_id IS NULL) AS n_without_features
FROM docs LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON docs.doc_id = e.vec_id GROUP BY cohort""")
def jn07_feature_coverage(spark, sf_dir):
    """JN7: which cohort rows have a feature row (embedding with the same id)."""
    feats = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return co.coverage(_docs(spark, sf_dir), feats, "doc_id")


_ARCHIVED_SQL = """
, archived AS (
  SELECT key, (doc_id % 10) / 10.0 AS score FROM docs
  UNION ALL SELECT sha256(lower(trim(text))), (item_id % 10) / 10.0 FROM benchmark)
"""


def _archived(spark, sf_dir):
    """An archived score table: the documents' identities plus the benchmark
    passages (most of which have no exact source document)."""
    d = _docs(spark, sf_dir).select("key", (F.pmod("doc_id", F.lit(10)) / 10.0).alias("score"))
    b = table(spark, sf_dir, "benchmark").select(
        identity_key("text").alias("key"), (F.pmod("item_id", F.lit(10)) / 10.0).alias("score"))
    return d.unionByName(b)


@query("jn08_recovery_alignment", with_(DOCS) + _ARCHIVED_SQL + """
, src AS (SELECT key, count(*) AS c FROM docs GROUP BY key)
SELECT CASE WHEN c IS NULL THEN 'unmatched' WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
       count(*) AS n, count(*) FILTER (WHERE score < 0.7) AS n_below_cutoff
FROM archived LEFT JOIN src USING (key) GROUP BY ALL""")
def jn08_recovery_alignment(spark, sf_dir):
    return co.recovery_alignment(_archived(spark, sf_dir), _docs(spark, sf_dir), "key", "score", 0.7)


@query("jn08_alignment_rows", with_(DOCS) + """
, arch AS (
  SELECT 'd' || doc_id AS archived_id, key, (doc_id % 10) / 10.0::DOUBLE AS score FROM docs UNION ALL
  SELECT 'b' || item_id, sha256(lower(trim(text))), (item_id % 10) / 10.0::DOUBLE FROM benchmark),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY archived_id) AS pos, count(*) OVER (PARTITION BY key) AS n_archived FROM arch),
s AS (SELECT doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS pos FROM docs),
c AS (SELECT key, count(*) AS n_source FROM docs GROUP BY key)
SELECT a.archived_id, s.doc_id AS source_id, a.score, n_archived, coalesce(n_source, 0) AS n_source,
       CASE WHEN n_source IS NULL THEN 'unmatched' WHEN n_source = 1 AND n_archived = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
       a.score < 0.7 AS below_cutoff
FROM a LEFT JOIN s ON a.key = s.key AND a.pos = s.pos LEFT JOIN c ON a.key = c.key""")
def jn08_alignment_rows(spark, sf_dir):
    """JN8 as rows: every archived row with its source row, its status and whether it
    is listed as a candidate below the cutoff."""
    d = _docs(spark, sf_dir)
    arch = d.select(F.concat(F.lit("d"), "doc_id").alias("archived_id"), "key", (F.pmod("doc_id", F.lit(10)) / 10.0).alias("score"))
    b = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("archived_id"), identity_key("text").alias("key"), (F.pmod("item_id", F.lit(10)) / 10.0).alias("score"))
    return co.align_rows(arch.unionByName(b), "archived_id", d.select("key", F.col("doc_id").alias("source_id")), "source_id", "key", "score", 0.7) \
        .select("archived_id", "source_id", "score", "n_archived", "n_source", "status", "below_cutoff")


@query("jn09_point_lookup", with_(DOCS) + """
, firsts AS (SELECT key, min(doc_id) AS doc_id FROM docs GROUP BY key)
SELECT b.item_id, f.doc_id FROM benchmark b LEFT JOIN firsts f ON sha256(lower(trim(b.text))) = f.key""")
def jn09_point_lookup(spark, sf_dir):
    """JN9: benchmark passage -> first document with the same identity."""
    firsts = co.first_occurrence(_docs(spark, sf_dir), "key", "doc_id")
    b = table(spark, sf_dir, "benchmark").select("item_id", identity_key("text").alias("key"))
    return co.point_lookup(b, firsts, "key", "doc_id").select("item_id", "doc_id")


@query("jn16_reference_overlap", with_(DOCS) + """
SELECT d.doc_id, d.key IN (SELECT key FROM docs WHERE cohort <> 'screen') AS in_reference_key,
       d.grp IN (SELECT grp FROM docs WHERE cohort <> 'screen') AS in_reference_group
FROM docs d WHERE cohort = 'screen'""")
def jn16_reference_overlap(spark, sf_dir):
    d = _docs(spark, sf_dir)
    out = co.overlap_flags(d.where(F.col("cohort") == "screen"), _labelled(spark, sf_dir), "key", "grp")
    return out.select("doc_id", "in_reference_key", "in_reference_group")


@query("st01_inventory_difference", """
SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)
UNION ALL
SELECT doc_id, 'extra' FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)""")
def st01_inventory_difference(spark, sf_dir):
    """ST1: expected inventory (labelled ids) vs actual (documents)."""
    exp = table(spark, sf_dir, "labels").select("doc_id")
    act = table(spark, sf_dir, "documents").select("doc_id")
    return co.inventory_difference(exp, act)


def _doc_registry(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("quality", F.lit(0)).alias("y"), "grp")
    return sp.split_registry(d, "doc_id", "y", "grp")


def _st02_sql() -> str:
    from tessera.plans.splits import _h, _sss_sql
    return with_(DOCS) + """
, e AS (SELECT doc_id AS id, coalesce(quality, 0) AS y, grp FROM docs),
reg AS (
  SELECT printf('random_%02d', repeat) AS split_id, set, id FROM (""" + _sss_sql(10, 0.8) + """)
  UNION ALL
  SELECT 'grouped_00', CASE WHEN """ + _h('grp') + """ % 5 = 0 THEN 'test' ELSE 'train' END, id FROM e),
j AS (SELECT r.split_id, r.set, d.doc_id::VARCHAR AS i, d.key, d.grp FROM reg r JOIN docs d ON r.id = d.doc_id),
s AS (SELECT split_id, 'doc_id' AS kind, i AS value, set FROM j UNION ALL
      SELECT split_id, 'key', key, set FROM j UNION ALL SELECT split_id, 'grp', grp, set FROM j),
per AS (SELECT split_id, kind, value, bool_or(set = 'train') AND bool_or(set = 'test') AS both_sides
        FROM s GROUP BY ALL)
SELECT split_id, count(*) FILTER (WHERE kind = 'doc_id' AND both_sides) AS shared_doc_id,
       count(*) FILTER (WHERE kind = 'key' AND both_sides) AS shared_key,
       count(*) FILTER (WHERE kind = 'grp' AND both_sides) AS shared_grp
FROM per GROUP BY split_id"""


@query("st02_leakage_audit", _st02_sql())
def st02_leakage_audit(spark, sf_dir):
    """ST2: ids, identity keys and groups shared between train and test per split."""
    reg = _doc_registry(spark, sf_dir).withColumnRenamed("id", "doc_id")
    attrs = _docs(spark, sf_dir).select("doc_id", "key", "grp")
    return co.leakage_audit(reg, attrs, "doc_id", ["key", "grp"])


@query("st05_augmentation_union", with_(DOCS) + """
, u AS (SELECT key, n_chars FROM docs WHERE lang = 'en' UNION ALL SELECT key, n_chars FROM docs)
SELECT key, round(avg(n_chars), 6) AS n_chars, count(*) AS n_sources FROM u GROUP BY key""")
def st05_augmentation_union(spark, sf_dir):
    """ST5: English documents extended with all documents, mean per identity."""
    d = _docs(spark, sf_dir)
    return finish(co.augment(d.where(F.col("lang") == "en"), d, "key", "n_chars"))


@query("ag39_class_balance", with_(DOCS) + """
SELECT quality, count(*) AS n, (SELECT count(DISTINCT grp) FROM docs WHERE quality IS NOT NULL) AS n_groups
FROM docs WHERE quality IS NOT NULL GROUP BY quality""")
def ag39_class_balance(spark, sf_dir):
    return co.class_balance(_labelled(spark, sf_dir), "quality", "grp")


@query("fx04_identity_levels", """
SELECT count(DISTINCT sha256(lower(trim(text)))) AS n_keys_exact,
       count(DISTINCT sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))) AS n_keys_loose,
       count(*) AS n_rows
FROM documents""")
def fx04_identity_levels(spark, sf_dir):
    """FX4: identity keys at two normalisation levels."""
    d = table(spark, sf_dir, "documents")
    k = d.select(identity_key("text").alias("k1"), loose_identity_key("text").alias("k2"))
    n1 = k.select("k1").distinct().agg(F.count(F.lit(1)).alias("n_keys_exact"))
    n2 = k.select("k2").distinct().agg(F.count(F.lit(1)).alias("n_keys_loose"))
    n = d.agg(F.count(F.lit(1)).alias("n_rows"))
    return with_scalars(with_scalars(n1, n2), n)


@query("fx03_group_keys", """
WITH g AS (SELECT coalesce(nullif(lower(regexp_extract(text, '^(\\S+)', 1)), ''),
                           sha256(lower(trim(text)))) AS grp FROM documents)
SELECT grp, count(*) AS n FROM g GROUP BY grp""")
def fx03_group_keys(spark, sf_dir):
    """FX3: group = leading token of the text; an empty core is its own group."""
    d = table(spark, sf_dir, "documents")
    core = F.lower(F.regexp_extract("text", r"^(\S+)", 1))
    g = d.select(group_key(core, identity_key("text")).alias("grp"))
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("jn01_alignment_join", """
SELECT count(*) AS n_aligned, sum(l.quality)::BIGINT AS n_active, sum(d.n_chars)::BIGINT AS sum_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN embeddings e ON e.vec_id = d.doc_id""")
def jn01_alignment_join(spark, sf_dir):
    """JN1: documents x labels x embeddings on a unique id; rows missing anywhere drop."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    a = co.align([d, lab, e], "doc_id")
    return a.agg(F.count(F.lit(1)).alias("n_aligned"), F.sum("quality").cast("bigint").alias("n_active"),
                 F.sum("n_chars").cast("bigint").alias("sum_chars"))


@query("jn04_membership_filter", with_(DOCS) + """
SELECT cohort, count(*) AS n FROM docs WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY cohort""")
def jn04_membership_filter(spark, sf_dir):
    """JN4: cohort rows that also have an embedding (semi-join)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return co.member_of(_docs(spark, sf_dir), e, "doc_id").groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"))
