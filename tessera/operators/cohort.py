"""Keyed cohort operations (PR2, PR3, AG1, AG2, AG37, AG39, WN2, JN1, JN4-JN9,
JN16, ST1, ST2, ST5).

Every operator is a grouped aggregation or an equi-join on a key.  Hot keys
(one identity key holding a large share of rows) are handled by partial
aggregation before the shuffle (dedup, overlap flags) and by de-duplicating
the build side of anti/semi joins to distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.operators import rank

ROLES = ("active", "inactive", "screen")


def role(label: Column | str) -> Column:
    """PR2: label 1 / 0 / missing -> active / inactive / screen."""
    label = F.col(label) if isinstance(label, str) else label
    return (F.when(label == 1, "active").when(label == 0, "inactive").otherwise("screen"))


def validity_counts(df: DataFrame, valid: Column) -> DataFrame:
    """PR3: rows kept / dropped by a validity predicate, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count_if(valid).alias("n_valid"),
                  F.count_if(~valid | valid.isNull()).alias("n_dropped"))


def cohort_counts(df: DataFrame, cohort: str = "cohort", key: str = "key") -> DataFrame:
    """AG1: rows and distinct keys per cohort, with the active share of labelled rows.

    Distinct keys are counted as rows of a (cohort, key) aggregate, which is
    exact and combines map-side (no per-group set is held in memory)."""
    per = df.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(cohort, key).distinct().groupBy(cohort).agg(F.count(F.lit(1)).alias("n_keys"))
    out = per.join(keys, cohort, "left")
    tot = df.agg(F.count_if(F.col(cohort) == "active").alias("_na"),
                 F.count_if(F.col(cohort).isin("active", "inactive")).alias("_nl"))
    share = (F.col("_na") / F.greatest(F.col("_nl"), F.lit(1))).alias("active_share")
    return with_scalars(out, tot.select(share))


def first_occurrence(df: DataFrame, key: str, order: str, cols: Sequence[str] = ()) -> DataFrame:
    """WN2: stable dedup, keep the row with the lowest ``order`` per key.

    ``min(struct(order, ...))`` is a partially aggregated group-by, so a key
    holding a third of all rows is collapsed map-side before any shuffle."""
    if not cols:  # a plain min keeps the hash aggregate (no sort)
        return df.groupBy(key).agg(F.min(order).alias(order))
    packed = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])).alias("_m")
    return df.groupBy(key).agg(packed).select(
        key, F.col("_m._o").alias(order), *[F.col(f"_m.{c}").alias(c) for c in cols])


def decontaminate(df: DataFrame, reference: DataFrame, key: str = "key") -> DataFrame:
    """JN5: drop rows whose key occurs in the reference set (anti-join on
    distinct reference keys)."""
    return df.join(reference.select(key).distinct(), key, "left_anti")


def member_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """JN4: keep rows whose key is present in ``other`` (semi-join)."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail if ``keys`` are not unique; returns the duplicate-count row table
    (one aggregation, nothing collected but a number)."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"alignment keys {list(keys)} are not unique")
    return df


def align(tables: Sequence[DataFrame], key: str, check_unique: bool = True) -> DataFrame:
    """JN1: inner alignment of several keyed tables on a normalised key;
    rows missing on any side drop.  Keys are asserted unique first."""
    if check_unique:
        for t in tables:
            assert_unique(t, [key])
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "inner")
    return out


def identity_overlap(df: DataFrame, key: str = "key", cohort: str = "cohort",
                     roles: Sequence[str] = ROLES) -> DataFrame:
    """JN6: number of identity keys shared by each pair of cohorts.

    Per key, one boolean per cohort (max over rows, partially aggregated);
    pair counts are then a single aggregation over the key table."""
    flags = df.groupBy(key).agg(*[F.max(F.col(cohort) == r).alias(f"_in_{r}") for r in roles])
    aggs = []
    names = []
    for i, a in enumerate(roles):
        for b in roles[i + 1:]:
            aggs.append(F.count_if(F.col(f"_in_{a}") & F.col(f"_in_{b}")).alias(f"{a}__{b}"))
            names.append(f"{a}__{b}")
    wide = flags.agg(*aggs)
    long = wide.unpivot([], names, "pair", "n_shared_keys")
    parts = F.split("pair", "__")
    return long.select(parts[0].alias("cohort_a"), parts[1].alias("cohort_b"), "n_shared_keys")


def coverage(df: DataFrame, features: DataFrame, key: str, cohort: str = "cohort") -> DataFrame:
    """JN7: per cohort, rows that have / lack a feature row."""
    f = features.select(key).distinct().withColumn("_has", F.lit(True))
    j = df.join(f, key, "left")
    return j.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"),
                                 F.count_if(F.col("_has").isNotNull()).alias("n_with_features"),
                                 F.count_if(F.col("_has").isNull()).alias("n_without_features"))


def recovery_alignment(archived: DataFrame, source: DataFrame, key: str = "key",
                       score: str = "score", cutoff: float = 0.7) -> DataFrame:
    """JN8: align an archived score table to the source by exact identity.

    Each archived row is ``matched`` (one source row with its key),
    ``ambiguous`` (several) or ``unmatched`` (none).  Also counts matched rows
    whose archived score is below the cutoff."""
    src = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n_src"))
    j = archived.join(src, key, "left")
    status = (F.when(F.col("_n_src").isNull(), "unmatched")
              .when(F.col("_n_src") == 1, "matched").otherwise("ambiguous"))
    return j.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(score) < cutoff).alias("n_below_cutoff"))


def _places(df: DataFrame, key: str, id_col: str, n: str, at: str) -> DataFrame:
    """The place (from 0) of every row among those of its key by id, and their number;
    counted by ranges, so a frequent key is no single task."""
    counted = rank.prefix_sums(df.where(F.col(key).isNotNull()).withColumn("_one", F.lit(1)), [key], ["_one"], order_col=id_col)
    return counted.select(*df.columns, F.col("cum__one").alias(at), F.col("tot__one").alias(n))


def align_rows(archived: DataFrame, archived_id: str, source: DataFrame, source_id: str, key: str = "key",
               score: str = "score", cutoff: float = 0.7) -> DataFrame:
    """JN8: every archived row with its source row, one to one.

    Within a key both sides are paired in order of their ids.  ``matched``: one row
    on both sides; ``ambiguous``: more on a side (a surplus archived row has no
    source row); ``unmatched``: no source row, or a missing key.  ``below_cutoff``
    lists the candidates whose score is below the cutoff."""
    a = _places(archived, key, archived_id, "n_archived", "_at")
    s = _places(source.select(key, source_id), key, source_id, "n_source", "_at")
    first = s.where("_at = 0").select(key, "n_source")
    keyless = archived.where(F.col(key).isNull()).withColumn("_at", F.lit(0).cast("long")).withColumn("n_archived", F.lit(1).cast("long"))
    joined = a.unionByName(keyless).join(s.drop("n_source"), [key, "_at"], "left").join(first, key, "left")
    status = (F.when(F.col("n_source").isNull(), "unmatched")
              .when((F.col("n_source") == 1) & (F.col("n_archived") == 1), "matched").otherwise("ambiguous"))
    return joined.select(*archived.columns, source_id, "n_archived", F.coalesce("n_source", F.lit(0).cast("long")).alias("n_source"),
                         status.alias("status"), (F.col(score) < cutoff).alias("below_cutoff"))


def point_lookup(queries: DataFrame, first_rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """JN9: identity -> first row id (NULL when absent)."""
    return queries.join(first_rows.select(key, id_col), key, "left")


def overlap_flags(candidates: DataFrame, reference: DataFrame, key: str, group: str) -> DataFrame:
    """JN16: flag candidates whose identity key or group key occurs in the reference."""
    rk = reference.select(key).distinct().withColumn("in_reference_key", F.lit(True))
    rg = reference.select(group).distinct().withColumn("in_reference_group", F.lit(True))
    out = candidates.join(rk, key, "left").join(rg, group, "left")
    return out.withColumn("in_reference_key", F.coalesce("in_reference_key", F.lit(False))) \
              .withColumn("in_reference_group", F.coalesce("in_reference_group", F.lit(False)))


def inventory_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """ST1: rows missing from / extra in ``actual`` relative to ``expected``
    (multiset difference both ways), with a ``side`` column."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    extra = actual.exceptAll(expected).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def leakage_audit(registry: DataFrame, attrs: DataFrame, id_col: str, keys: Sequence[str],
                  split: str = "split_id", part: str = "set") -> DataFrame:
    """ST2: per split, the number of ids / identity keys / groups present on
    both the train and the test side (each must be zero for a clean split).

    All key kinds are stacked into one long (split, kind, value) table, so the
    registry is read once and shuffled once."""
    reg = registry.join(attrs, id_col, "inner")
    kinds = [id_col, *keys]
    stacked = reg.select(split, part, F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds
    ])).alias("_kv")).select(split, part, "_kv.kind", "_kv.value")
    per = stacked.groupBy(split, "kind", "value").agg(
        F.max(F.col(part) == "train").alias("_tr"), F.max(F.col(part) == "test").alias("_te"))
    cnt = per.groupBy(split, "kind").agg(F.count_if(F.col("_tr") & F.col("_te")).alias("n_shared"))
    wide = cnt.groupBy(split).pivot("kind", kinds).agg(F.first("n_shared"))
    return wide.select(split, *[F.coalesce(F.col(k), F.lit(0)).alias(f"shared_{k}") for k in kinds])


def augment(base: DataFrame, extra: DataFrame, key: str, value: str) -> DataFrame:
    """ST5 (own rule): union two endpoint tables, one row per identity with the mean value."""
    u = base.select(key, value).unionByName(extra.select(key, value))
    return u.groupBy(key).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_sources"))


def class_balance(df: DataFrame, label: str, group: str) -> DataFrame:
    """AG39: value counts of the label and the number of distinct groups."""
    vc = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ng = df.select(group).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    return with_scalars(vc, ng)
