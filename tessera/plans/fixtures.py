"""Stand-in inputs derived from the dataset tables (see FIXTURES.md part B).

Each fixture is a lazy DataFrame built from whole tables; nothing is sampled
or capped.  The DuckDB oracle builds the same fixtures in SQL
(``tessera.plans.oracle``) independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import identity_key, mul_mod32
from tessera.session import retain
from tessera.sources.tables import spread, table

_MEMO: dict[tuple[str, str], DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived input reused by several queries of one session (e.g. the
    document fingerprints): built once, persisted (memory, spilling to disk;
    recomputed from lineage if an executor is lost) and memoised per
    (dataset folder, name).  One entry per input, so repeated queries do not
    accumulate cached copies."""
    key = (sf_dir, name)
    df = _MEMO.get(key)
    if df is not None and df.sparkSession is spark and df.storageLevel.useMemory:
        return df
    # a projection of its own, so a builder's intermediates stay separate; release() drops it
    df = _MEMO[key] = build().select("*").transform(retain)
    return df


# The six targets of the F-PANEL fixture, in dimension order
# (ord, target, role).  Scores per target are defined in ``panel_wide``.
TARGETS = [
    (1, "quantity", "volume"),
    (2, "extendedprice", "price"),
    (3, "discount", "rate"),
    (4, "tax", "rate"),
    (5, "net_price", "price"),
    (6, "retail_price", "list"),
]


def targets(spark: SparkSession) -> DataFrame:
    """JN3 dimension table (6 rows)."""
    return spark.createDataFrame(TARGETS, "ord int, target string, role string")


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-PANEL: lineitem x part; cohort from the return flag; 6 score columns.

    ``tax`` drops the value 0.03 (NULL) so per-column missing handling is exercised.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(pt, li.l_partkey == pt.p_partkey, "inner")
    cohort = (F.when(F.col("l_returnflag") == "A", "active")
              .when(F.col("l_returnflag") == "R", "inactive")
              .when(F.col("l_returnflag") == "N", "screen"))
    return j.select(
        cohort.alias("cohort"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.nullif(F.col("l_tax"), F.lit(0.03)).alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        F.col("p_retailprice").alias("retail_price"))


def panel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR5: one row per (row, target) with that target's score; each target
    drops only its own missing values."""
    wide = panel_wide(spark, sf_dir)
    names = [t for _, t, _ in TARGETS]
    long = wide.unpivot(["cohort"], names, "target", "score")
    return long.where(F.col("score").isNotNull())


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-SCORES: events with a 0/1 label, a fold and two deterministic scores."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    y = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)
    eid = F.col("event_id")
    p_a = (F.pmod(mul_mod32(eid, 2654435761), F.lit(700)) + 300 * y) / 1000.0
    p_b = (F.pmod(F.pmod(eid * 40503 + 7, F.lit(65536)), F.lit(800)) + 200 * y) / 1000.0
    return ev.select(eid.alias("id"), y.alias("y"), F.pmod(eid, F.lit(5)).alias("fold"),
                     p_a.cast("double").alias("p_a"), p_b.cast("double").alias("p_b"))


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-SCORES as a long prediction table (fold, id, y, model, p).

    Models: ``a``, ``b``, the product veto ``veto`` (PR13) and the mean fusion
    ``mean`` (PR14)."""
    s = scores(spark, sf_dir)
    s = s.withColumn("veto", F.col("p_a") * F.col("p_b")) \
         .withColumn("mean", 0.5 * (F.col("p_a") + F.col("p_b")))
    return s.unpivot(["fold", "id", "y"], ["p_a", "p_b", "veto", "mean"], "model", "p") \
        .withColumn("model", F.regexp_replace("model", "^p_", ""))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-DOCS cohort: documents left-joined to labels.

    id = doc_id, key = sha256(lower(trim(text))), grp = source,
    cohort from quality: 1 active, 0 inactive, missing screen."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    cohort = (F.when(F.col("quality") == 1, "active")
              .when(F.col("quality") == 0, "inactive").otherwise("screen"))
    return j.select("doc_id", identity_key("text").alias("key"), F.col("source").alias("grp"),
                    "lang", "n_chars", "quality", "toxic", cohort.alias("cohort"), "text")


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-STORED: an archived prediction table over documents.

    Ids with ``hash % 10 < 3`` are absent; on another residue one component
    is missing so the stored blend has to be used."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    h = F.pmod(mul_mod32(F.col("doc_id"), 2654435761), F.lit(10))
    p1 = (F.pmod(mul_mod32(F.col("doc_id"), 2246822519), F.lit(1000)) / 1000.0).cast("double")
    p2 = (F.pmod(F.pmod(F.col("doc_id") * 40503 + 7, F.lit(65536)), F.lit(1000)) / 1000.0).cast("double")
    out = d.where(h >= 3).select(
        F.col("doc_id").alias("ligand"),
        F.when(h != 4, p1).alias("proba_dmpnn"),
        p2.alias("proba_hgb"),
        ((p1 + p2) / 2.0).cast("double").alias("prob"))
    return out


def dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-DOSE: part as an endpoint table: MW = retail price, -log value = size/10,
    second species -log value = (partkey % 97)/12, population = brand."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("population"),
                    F.col("p_retailprice").alias("mw"),
                    (F.col("p_size") / 10.0).cast("double").alias("p_value_a"),
                    (F.pmod(F.col("p_partkey"), F.lit(97)) / 12.0).cast("double").alias("p_value_b"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB: vec_id, features as array<double>, y = label < 5."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("x"),
                    F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))


def embeddings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB in long form: (id, y, feature index j, value)."""
    e = embeddings(spark, sf_dir)
    return e.select("id", "y", F.posexplode("x").alias("j", "value"))
