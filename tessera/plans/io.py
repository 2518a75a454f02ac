"""Source and sink queries (SC2-SC7, SK1, SK2, SK4) over the dataset tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import split as sp
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query
from tessera.session import ensure_checkpoint_dir
from tessera.sources import scans, sinks
from tessera.sources.tables import table


@query("sc02_wide_scan", """
SELECT vec_id AS id, len(embedding)::INTEGER AS n_features,
       round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS x_sum FROM embeddings""")
def sc02_wide_scan(spark, sf_dir):
    """SC2: a wide table (key + one column per feature) packed back to one
    array column; the feature list is every column except the key."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    wide = e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].alias(f"f{i}") for i in range(n)])
    packed, feats = scans.wide_scan(wide, "id")
    return finish(packed.select("id", F.size("x").alias("n_features"),
                                F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("x_sum")))


def _sc03_sql() -> str:
    from tessera.plans.splits import _sss_sql
    return """
WITH e AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings)
SELECT set, y, count(*) AS n FROM (""" + _sss_sql(10, 0.8) + """) WHERE repeat = 1 GROUP BY ALL"""


@query("sc03_registry_scan", _sc03_sql())
def sc03_registry_scan(spark, sf_dir):
    """SC3/PR4: registry written partitioned by split_id under the session's
    checkpoint folder, read back with partition pruning on one split."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"))
    e = fx.embeddings(spark, sf_dir).select("id", "y").join(raw, "id")
    reg = sp.split_registry(e, "id", "y", "grp")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    sinks.write_table(reg, path, partition_by=["split_id"])
    r = scans.split_registry_scan(spark, path, "random_01")
    return r.groupBy("set", "y").agg(F.count(F.lit(1)).alias("n"))


@query("sc04_aliased_scan", """
WITH stored AS (
  SELECT doc_id AS ligand,
         CASE WHEN (doc_id * 2654435761) % 4294967296 % 10 <> 4
              THEN (((doc_id * 2246822519) % 4294967296 % 1000) / 1000.0)::DOUBLE END AS proba_dmpnn,
         ((((doc_id * 40503 + 7) % 65536) % 1000) / 1000.0)::DOUBLE AS proba_hgb,
         (((((doc_id * 2246822519) % 4294967296 % 1000) / 1000.0)
           + ((((doc_id * 40503 + 7) % 65536) % 1000) / 1000.0)) / 2.0)::DOUBLE AS prob
  FROM documents WHERE (doc_id * 2654435761) % 4294967296 % 10 >= 3)
SELECT ligand AS id, round(proba_dmpnn, 6) AS proba_dmpnn, round(proba_hgb, 6) AS proba_hgb,
       round(prob, 6) AS prob FROM stored""")
def sc04_aliased_scan(spark, sf_dir):
    """SC4: the stored table under alternative column names; aliases resolve
    at plan time, the first column is the id, ids are normalised."""
    st = fx.stored_scores(spark, sf_dir)
    renamed = st.select(F.lpad(F.col("ligand").cast("string"), 6, "0").alias("compound"),
                        F.col("proba_dmpnn").alias("dmpnn"), F.col("proba_hgb").alias("hgb_prob"),
                        F.col("prob").alias("pred_proba"))
    return finish(scans.resolve_aliases(renamed))


@query("sc05_descriptor_completeness", """
SELECT count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def sc05_descriptor_completeness(spark, sf_dir):
    """SC5: cohort rows without a vector row (the caller recomputes when > 0)."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return scans.descriptor_completeness(vec, table(spark, sf_dir, "documents"), "doc_id")


@query("sc06_endpoint_scan", """
SELECT count(*) AS n_total,
       count(*) FILTER (WHERE NOT (text IS NOT NULL AND length(trim(text)) > 0 AND n_chars IS NOT NULL)) AS n_bad
FROM documents""")
def sc06_endpoint_scan(spark, sf_dir):
    """SC6: endpoint table (text, value) with unusable rows counted and dropped."""
    _, counts = scans.endpoint_scan(table(spark, sf_dir, "documents"), "text", "n_chars")
    return counts


@query("sc07_json_scan", """
SELECT count(*) AS n, count(*) FILTER (WHERE props IS NOT NULL AND try(json_extract(props, '$.k')) IS NULL) AS n_malformed,
       sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events""")
def sc07_json_scan(spark, sf_dir):
    """SC7: JSON records of the events' ``props`` column, malformed ones flagged."""
    ev = scans.parse_json_column(table(spark, sf_dir, "events"), "props", "k bigint")
    return ev.agg(F.count(F.lit(1)).alias("n"), F.count_if("_malformed").alias("n_malformed"),
                  F.sum("_parsed.k").cast("bigint").alias("sum_k"))


@query("sk01_preview", """
SELECT event_id, round(value, 6) AS value, (SELECT count(*) FROM events) AS total_rows,
       (SELECT count(*) FROM events) > 20 AS is_preview
FROM events ORDER BY value DESC, event_id LIMIT 20""")
def sk01_preview(spark, sf_dir):
    """SK1: preview of the full table (top 20 by value) with the total row count."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return finish(sinks.preview(e, [F.col("value").desc(), F.col("event_id").asc()], 20))


@query("sk02_manifest")
def sk02_manifest(spark, sf_dir):
    """SK2: size and SHA-256 of every table file of the dataset folder."""
    return sinks.manifest(spark, f"{sf_dir.rstrip('/')}/*.parquet")


@query("sk02_verify_blocks")
def sk02_verify_blocks(spark, sf_dir):
    """SK2: the events exported twice, the second time with one value changed: per file
    the status and the blocks that differ."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    ev = table(spark, sf_dir, "events").select("event_id", "event_type").orderBy("event_id")
    for name, kind in (("a", F.col("event_type")), ("b", F.when(F.col("event_id") == 100, F.upper("event_type")).otherwise(F.col("event_type")))):
        ev.select(F.concat_ws(",", "event_id", kind).alias("line")).coalesce(1).write.text(f"{root}/{name}")
    # the writer's names hold a job id: the number of the part stays
    def part(name):
        found = sinks.block_manifest(spark, f"{root}/{name}/*.txt", block_bytes=4096)
        return found.withColumn("file", F.regexp_extract("file", "^(part-[0-9]+)", 1))
    return sinks.verify_blocks(part("b"), part("a"))


@query("sk02_block_manifest")
def sk02_block_manifest(spark, sf_dir):
    """SK2: size, blocks and root digest of every table file of the dataset folder."""
    return sinks.root_digests(sinks.block_manifest(spark, f"{sf_dir.rstrip('/')}/*.parquet"))


_LINE = "CASE WHEN event_id % 77 = 0 THEN '' WHEN event_id % 50 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"


@query("sc07_quarantine", f"""
WITH l AS (SELECT event_id, {_LINE} AS line FROM events)
SELECT CASE WHEN trim(line) = '' THEN 'empty' WHEN NOT json_valid(line) THEN 'malformed'
            WHEN try_cast(json_extract_string(line, '$.k') AS BIGINT) IS NULL THEN 'missing k' ELSE 'good' END AS reason,
       count(*) AS n, sum(CASE WHEN json_valid(line) THEN try_cast(json_extract_string(line, '$.k') AS BIGINT) END)::BIGINT AS sum_k
FROM l GROUP BY ALL""")
def sc07_quarantine(spark, sf_dir):
    """SC7: JSON lines written from the events, some cut or blank, read back into good
    rows and rejects."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.expr(_LINE).alias("line")).where("line IS NOT NULL").write.text(path)
    good, rejected = scans.quarantine_scan(spark, path, "k bigint", required=["k"])
    counts = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("sum_k"))
    kept = good.agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("bigint").alias("sum_k")).select(F.lit("good").alias("reason"), "n", "sum_k")
    return kept.unionByName(counts)


@query("sk04_provenance", """
WITH c AS (
  SELECT 'labels' AS input, count(*) AS n_rows,
         sum(('0x' || substr(sha256(concat_ws('|', doc_id, quality, toxic)), 1, 8))::BIGINT)::BIGINT AS checksum
  FROM labels
  UNION ALL
  SELECT 'nation', count(*), sum(('0x' || substr(sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)), 1, 8))::BIGINT)::BIGINT
  FROM nation)
SELECT input, n_rows, checksum, 'k=5;seed=42' AS params, 'computed' AS evidence_kind FROM c""")
def sk04_provenance(spark, sf_dir):
    """SK4: input checksums (order-insensitive), parameters and evidence kind."""
    a = sinks.table_checksum(table(spark, sf_dir, "labels"), "labels", ["doc_id", "quality", "toxic"])
    b = sinks.table_checksum(table(spark, sf_dir, "nation"), "nation", ["n_nationkey", "n_name", "n_regionkey"])
    out = sinks.provenance(a.unionByName(b), {"seed": "42", "k": "5"})
    params = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("input", "n_rows", "checksum", params.alias("params"), "evidence_kind")


def _sk03_sql() -> str:
    from tessera.plans.auditing import _COMPUTED_SQL
    return _COMPUTED_SQL + """
SELECT count(*) AS n_checks, count(*) FILTER (WHERE match) AS n_matched, count(*) AS n_rows FROM checks"""


@query("sk03_json_summary", _sk03_sql())
def sk03_json_summary(spark, sf_dir):
    """SK3: a nested run summary (audit totals with the per-check rows as an
    array of structs) written as JSON under the checkpoint folder and read back."""
    from tessera.plans import auditing
    checks = auditing.ag42_audit_checks(spark, sf_dir)
    summary = checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("match").alias("n_matched"),
                         F.sort_array(F.collect_list(F.struct("metric", "computed", "match"))).alias("checks"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/summary-{uuid.uuid4().hex}"
    sinks.write_json_summary(summary, path)
    return spark.read.json(path).select("summary.n_checks", "summary.n_matched",
                                        F.size("summary.checks").cast("bigint").alias("n_rows"))
