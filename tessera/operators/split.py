"""Reproducible splits (SP1-SP5, ST4).

Assignments are functions of a portable hash of (seed, id), so they are
stable across engines, re-runs and lost executors.  Stratified variants need
each row's position inside its class; that position comes from the bucketed
prefix sums of ``operators.rank`` (no per-class window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import md5_int32
from tessera.operators import rank


def seeded_hash(id_col: Column | str, seed: int) -> Column:
    """32-bit md5 hash of ``'<seed>:<id>'`` (portable)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return md5_int32(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SP1: fold = hash(seed, id) mod k."""
    return df.withColumn("fold", F.pmod(seeded_hash(id_col, seed), F.lit(k)))


def position_in_class(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """0-based position of each row inside its class when ordered by
    (hash(seed, id), id), plus the class size."""
    h = df.select(id_col, label, seeded_hash(id_col, seed).alias("v")).withColumn("n", F.lit(1))
    ps = rank.prefix_sums(h, [label], ["n"], tiebreak=[id_col])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_size"))
    return (ps.select(id_col, label, F.col("cum_n").alias("position"))
            .join(sizes, label, "inner"))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SP2: class shares equal per fold: fold = position-in-class mod k."""
    pos = position_in_class(df, id_col, label, seed)
    return df.join(pos.select(id_col, F.pmod("position", F.lit(k)).alias("fold")), id_col, "inner")


def stratified_shuffle(df: DataFrame, id_col: str, label: str, n_repeats: int = 4,
                       train_frac: float = 0.7, seed: int = 42) -> DataFrame:
    """SP3: ``n_repeats`` stratified train/test shuffles; in each class the
    first round(train_frac * class_size) rows by hash(seed + repeat, id) are train.

    All repeats are ranked in one pass: rows are replicated per repeat and the
    repeat joins the class as a prefix-sum group.  Returns (repeat, id, label, set)."""
    rep = df.select(id_col, label,
                    F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    seeded = F.concat(F.col("repeat") + F.lit(seed), F.lit(":"), F.col(id_col).cast("string"))
    h = rep.select("repeat", id_col, label, md5_int32(seeded).alias("v")).withColumn("n", F.lit(1))
    ps = rank.prefix_sums(h, ["repeat", label], ["n"], tiebreak=[id_col])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_size"))
    pos = ps.join(sizes, label, "inner")
    return pos.select("repeat", id_col, label, F.when(
        F.col("cum_n") < F.bround(F.lit(train_frac) * F.col("class_size")), "train")
        .otherwise("test").alias("set"))


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SP4: fold = hash(seed, group) mod k; no group spans two folds."""
    return df.withColumn("fold", F.pmod(seeded_hash(group, seed), F.lit(k)))


def balanced_group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42, label: str | None = None) -> DataFrame:
    """SP4 with folds of near-equal size (and, with ``label``, near-equal class
    shares): no group spans two folds.

    Groups are dealt in a snake (0..k-1, k-1..0, ...) from the largest down,
    separately for groups with and without a majority of label 1; the order is
    a prefix count over the table of groups, ties broken by hash, then name."""
    positives = F.sum(F.coalesce(F.col(label).cast("long"), F.lit(0))) if label else F.lit(0)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), positives.alias("_p"))
    order = sizes.select(group, (F.col("_p") * 2 >= F.col("_n")).cast("int").alias("_s"), (-F.col("_n")).alias("v"),
                         seeded_hash(group, seed).alias("_h"), F.lit(1).alias("n"))
    place = F.pmod(F.col("cum_n"), F.lit(2 * k))
    dealt = rank.prefix_sums(order, ["_s"], ["n"], tiebreak=["_h", group])
    folds = dealt.select(group, F.when(place < k, place).otherwise(2 * k - 1 - place).cast("long").alias("fold"))
    return rank.join_null_safe(df, folds, [group])


def split_registry(df: DataFrame, id_col: str, label: str, group: str, n_random: int = 10,
                   test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """SP5: long registry (split_id, set, id, y): ``n_random`` stratified
    random splits plus one grouped split (groups hashed to the test side)."""
    rnd = stratified_shuffle(df, id_col, label, n_random, 1.0 - test_frac, seed).select(
        F.format_string("random_%02d", F.col("repeat")).alias("split_id"), "set",
        F.col(id_col).alias("id"), F.col(label).alias("y"))
    k = int(round(1.0 / test_frac))
    grp = df.select(F.lit("grouped_00").alias("split_id"),
                    F.when(F.pmod(seeded_hash(group, seed), F.lit(k)) == 0, "test")
                    .otherwise("train").alias("set"),
                    F.col(id_col).alias("id"), F.col(label).alias("y"))
    return rnd.unionByName(grp)


def size_grid_frame(rows: DataFrame, n_points: int = 90, lo: int = 2) -> DataFrame:
    """ST4: (p, m) rounded evenly spaced feature counts between ``lo`` and every
    p of ``rows``, each once."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")
    g = rows.select("p", i)
    # same operation order as an evenly spaced grid: start + i * ((stop - start) / (n - 1))
    x = F.col("i") * ((F.col("p") - lo) / float(n_points - 1)) + F.lit(float(lo))
    return g.select("p", F.least(F.greatest(F.bround(x, 0).cast("int"), F.lit(lo)), F.col("p"))
                    .alias("m")).distinct()
