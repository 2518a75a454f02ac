"""Scoring and evaluation of probabilities (PR11-PR15, PR23, AG19-AG36, WN7, JN13).

Inputs are long prediction tables ``(groups..., id, y, p)``; every metric is
computed per group (split, model, rung, ...) in grouped aggregations whose
partial aggregates combine map-side.  Rank metrics reuse ``operators.rank``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.operators import rank
from tessera.session import retain

EPS = 1e-7


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_on_groups(a: DataFrame, b: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on the group keys; without groups ``b`` is a one-row aggregate
    attached to every row of ``a``."""
    if groups:
        return rank.join_null_safe(a, b, list(groups), how)
    return with_scalars(a, b, how)


# ---------------------------------------------------------------- scalar fusions
def known(p: Column | str) -> Column:
    """A score as double, NULL where it is missing (NULL or NaN)."""
    d = _c(p).cast("double")
    return F.when(~F.isnan(d), d)


def clip_prob(p: Column | str, eps: float = EPS) -> Column:
    """PR11: clip a probability to [eps, 1 - eps]; a missing score stays missing
    (``greatest`` and ``least`` alone would skip NULL)."""
    d = known(p)
    return F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(eps)), F.lit(1.0 - eps)))


def veto(a: Column | str, b: Column | str) -> Column:
    """PR13: product veto; can only lower a score."""
    return _c(a) * _c(b)


def mean_fusion(a: Column | str, b: Column | str) -> Column:
    """PR14: symmetric mean fusion."""
    return 0.5 * (_c(a) + _c(b))


def geometric_fusion(a: Column | str, b: Column | str, w: float = 0.5) -> Column:
    """PR23 (own definition): exp(w ln a + (1-w) ln b) on clipped scores."""
    return F.exp(F.lit(w) * F.ln(clip_prob(a)) + F.lit(1.0 - w) * F.ln(clip_prob(b)))


def flag(p: Column | str, t: float) -> Column:
    """PR15: inclusive threshold flag ``p >= t``; a missing score is not flagged."""
    return F.coalesce(known(p) >= F.lit(t), F.lit(False))


def inner_edges(n_bins: int) -> list[float]:
    """Inner bin edges exactly as an evenly spaced grid on [0, 1] produces them
    (0.30000000000000004 included, see trap T4)."""
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]


def bin_index(p: Column | str, n_bins: int) -> Column:
    """Bin of ``p`` among equal-width bins: number of inner edges <= p
    (left-closed inner edges, last bin closed); a missing score has no bin."""
    p = known(p)
    idx = F.lit(0)
    for e in inner_edges(n_bins):
        idx = idx + F.when(p >= F.lit(e), 1).otherwise(0)
    return F.when(p.isNotNull(), idx)


def scored_rows(df: DataFrame, p: str, y: str) -> DataFrame:
    """Rows that calibration counts: score and label present."""
    return df.where(known(p).isNotNull() & F.col(y).isNotNull())


# ---------------------------------------------------------------- threshold metrics
def confusion(df: DataFrame, p: str, y: str, groups: Sequence[str], t: float = 0.5) -> DataFrame:
    """AG22: TP/FP/TN/FN at ``p >= t`` per group, one pass."""
    hit = flag(p, t)
    pos = F.col(y) == 1
    return df.groupBy(*groups).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))


def rates(conf: DataFrame) -> DataFrame:
    """AG23/AG24 from confusion counts: FPR and recall (denominators floored at 1),
    precision, F1, accuracy, balanced accuracy."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    fpr = fp / F.greatest(fp + tn, F.lit(1.0))
    rec = tp / F.greatest(tp + fn, F.lit(1.0))
    return conf.select(
        "*", fpr.alias("fpr"), rec.alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        (0.5 * (rec + tn / F.greatest(tn + fp, F.lit(1.0)))).alias("balanced_accuracy"))


def veto_effect(df: DataFrame, base: str, vetoed: str, y: str, groups: Sequence[str],
                t: float = 0.5) -> DataFrame:
    """AG23: FPR / recall before and after a veto, reduction % and TP lost, over the
    rows with both scores."""
    both = known(base).isNotNull() & known(vetoed).isNotNull()
    pos, neg = both & (F.col(y) == 1), both & (F.col(y) == 0)
    n_pos = F.greatest(F.count_if(pos), F.lit(1)).cast("double")
    n_neg = F.greatest(F.count_if(neg), F.lit(1)).cast("double")
    a = df.groupBy(*groups).agg(
        (F.count_if(neg & flag(base, t)) / n_neg).alias("fpr_before"),
        (F.count_if(neg & flag(vetoed, t)) / n_neg).alias("fpr_after"),
        (F.count_if(pos & flag(base, t)) / n_pos).alias("recall_before"),
        (F.count_if(pos & flag(vetoed, t)) / n_pos).alias("recall_after"),
        (F.count_if(pos & flag(base, t) & ~flag(vetoed, t))).alias("tp_lost"))
    red = 100.0 * (F.col("fpr_before") - F.col("fpr_after")) / F.greatest(F.col("fpr_before"), F.lit(1e-9))
    return a.withColumn("fpr_reduction_pct", red)


def f1_optimal(df: DataFrame, p: str, y: str, groups: Sequence[str]) -> DataFrame:
    """AG25: threshold with the best F1 among distinct scores (tie -> lower
    threshold), with FPR and recall there.  Uses the WN4 cumulative counts."""
    dc = rank.descending_counts(df, p, y, groups)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn = F.col("pos_total") - tp
    f1 = F.try_divide(2 * tp, 2 * tp + fp + fn)
    s = dc.select(*groups, "v", f1.alias("f1"),
                  (fp / F.greatest(F.col("neg_total").cast("double"), F.lit(1.0))).alias("fpr"),
                  (tp / F.greatest(F.col("pos_total").cast("double"), F.lit(1.0))).alias("recall"))
    best = F.max(F.struct(F.col("f1"), (-F.col("v")).alias("neg_v"), "fpr", "recall"))
    return s.groupBy(*groups).agg(best.alias("b")).select(
        *groups, F.col("b.f1").alias("f1_opt"), (-F.col("b.neg_v")).alias("threshold_f1_opt"),
        F.col("b.fpr").alias("fpr_at_f1_opt"), F.col("b.recall").alias("recall_at_f1_opt"))


# ---------------------------------------------------------------- calibration
def calibration_bins(df: DataFrame, p: str, y: str, groups: Sequence[str],
                     n_bins: int = 10) -> DataFrame:
    """AG29: non-empty equal-width bins of the clipped p: weight, mean p, observed rate.
    Rows with a missing score or label are left out."""
    pc = clip_prob(p)
    b = scored_rows(df, p, y).select(*groups, pc.alias("_p"), F.col(y).cast("double").alias("_y"),
                  bin_index(pc, n_bins).alias("bin"))
    per = b.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("n_bin"),
                                        F.avg("_p").alias("mean_p"), F.avg("_y").alias("obs_rate"))
    tot = per.groupBy(*groups).agg(F.sum("n_bin").alias("_n"))
    out = join_on_groups(per, tot, groups)
    return out.withColumn("weight", F.col("n_bin") / F.col("_n")).drop("_n")


def confidence_metrics(df: DataFrame, p: str, y: str, groups: Sequence[str],
                       n_bins: int = 10, t_hi: float = 0.7, t_hi2: float = 0.9) -> DataFrame:
    """AG26-AG32 (+AG19) per group, from one ranked table of value counts.

    Every number is a sum over the distinct clipped scores, taken per (group, bin)
    in one pass that also adds up the rank statistic of the AUC (only with both
    classes present).  Rows with a missing score or label are left out."""
    groups = list(groups)
    rows = scored_rows(df, p, y).select(*groups, clip_prob(p).alias("_p"), F.col(y).alias("_y"))
    counts = rank.prefix_sums(rank.value_counts(rows, "_p", groups, "_y"), groups, ["n", "n_pos"])
    v, n, k = F.col("v"), F.col("n").cast("double"), F.col("n_pos").cast("double")
    below = (F.col("cum_n") - F.col("cum_n_pos")).cast("double")  # negatives with a smaller score
    per_bin = counts.groupBy(*groups, bin_index("v", n_bins).alias("_bin")).agg(
        F.sum(n).alias("nb"), F.sum(n * v).alias("sp"), F.sum(k).alias("sy"),
        F.sum(k * F.pow(v - 1, 2) + (n - k) * v * v).alias("sse"),
        F.sum(-(k * F.ln(v) + (n - k) * F.ln(1 - v))).alias("sll"), F.sum(n * v * v).alias("spp"),
        *[F.sum(F.when(v >= t, n).otherwise(0.0)).alias(f"n{c}") for c, t in ((70, t_hi), (90, t_hi2))],
        *[F.sum(F.when(v >= t, k)).alias(f"y{c}") for c, t in ((70, t_hi), (90, t_hi2))],
        F.sum(k * (below + (n - k) / 2.0)).alias("u"),
        F.first("tot_n").cast("double").alias("_tn"), F.first("tot_n_pos").cast("double").alias("_ty"))
    w = F.col("nb") / F.col("_tn")
    mp, oy, obar = F.col("sp") / F.col("nb"), F.col("sy") / F.col("nb"), F.col("_ty") / F.col("_tn")
    total, positive = F.first("_tn"), F.first("_ty")
    return per_bin.groupBy(*groups).agg(
        (F.sum("sse") / total).alias("brier"),
        (F.sum("sll") / total).alias("log_loss"),
        F.sum(w * F.abs(mp - oy)).alias("ece"),
        F.sum(w * F.pow(mp - oy, 2)).alias("reliability"),
        F.sum(w * F.pow(oy - obar, 2)).alias("resolution"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("spp") / total - F.pow(F.sum("sp") / total, 2))).alias("sharpness_std"),
        F.try_divide(F.sum("y70"), F.sum("n70")).alias("precision_at_0_7"),
        (F.sum("n70") / total).alias("coverage_at_0_7"),
        F.try_divide(F.sum("y90"), F.sum("n90")).alias("precision_at_0_9"),
        (F.sum("n90") / total).alias("coverage_at_0_9"),
        (positive / total).alias("base_rate"),
        F.try_divide(F.sum("u"), positive * (total - positive)).alias("auc"))


def threshold_metrics(df: DataFrame, p: str, y: str, groups: Sequence[str], t: float = 0.5) -> DataFrame:
    """AG19, AG20, AG22, AG25 per group from one ranked table of value counts: n_pos,
    n_neg, auc, average_precision, tp, fp, tn, fn at ``p >= t``, and the threshold of the
    best F1 (tie -> lower threshold).  Rows with a missing score or label are left
    out; a metric that needs a class that is absent is missing."""
    groups = list(groups)
    c = rank.descending_counts(df, p, y, groups)
    k, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pos_total, neg_total = F.col("pos_total"), F.col("neg_total")
    f1 = F.try_divide(2 * tp, tp + fp + pos_total)
    at = F.col("v") >= t
    a = c.groupBy(*groups).agg(
        F.first("pos_total").alias("n_pos"), F.first("neg_total").alias("n_neg"),
        F.sum(k * (neg_total - fp + neg / 2.0)).alias("_u"),
        F.sum(F.try_divide(k, pos_total) * tp / (tp + fp)).alias("average_precision"),
        F.coalesce(F.max(F.when(at, F.col("tp"))), F.lit(0).cast("long")).alias("tp"),
        F.coalesce(F.max(F.when(at, F.col("fp"))), F.lit(0).cast("long")).alias("fp"),
        F.max(F.struct(f1.alias("f1"), (-F.col("v")).alias("neg_v"))).alias("_best"))
    return a.select(*groups, "n_pos", "n_neg", F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "average_precision",
                    "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"),
                    F.col("_best.f1").alias("f1_opt"), (-F.col("_best.neg_v")).alias("threshold_f1_opt"))


def reliability_curve(df: DataFrame, p: str, y: str, groups: Sequence[str],
                      n_bins: int = 10) -> DataFrame:
    """AG33: pooled reliability points (mean p, observed rate) per group."""
    return calibration_bins(df, p, y, groups, n_bins).select(
        *groups, "bin", "n_bin", "mean_p", "obs_rate")


def score_histogram(df: DataFrame, p: str, groups: Sequence[str], n_bins: int = 25) -> DataFrame:
    """AG33: histogram of raw p on [0, 1] with ``n_bins`` equal bins (last closed)."""
    return (df.where(F.col(p).between(0.0, 1.0))
            .groupBy(*groups, bin_index(p, n_bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def rmse(df: DataFrame, pred: str, y: str, groups: Sequence[str]) -> DataFrame:
    """AG21: root mean squared error."""
    return df.groupBy(*groups).agg(
        F.sqrt(F.avg(F.pow(F.col(pred) - F.col(y), 2))).alias("rmse"))


# ---------------------------------------------------------------- across splits
def split_summary(metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """AG34: NaN-ignoring mean, population sd and sample sd across splits."""
    v = F.col(value)
    return metrics.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd_samp"),
        F.count(F.lit(1)).alias("n_splits"))


def paired_signed_rank(metrics: DataFrame, split: str, rung: str, metric: str,
                       baseline: str, value: str = "value") -> DataFrame:
    """AG35: per (rung, metric) vs the baseline rung: mean difference and the
    Wilcoxon signed-rank statistic W = min(W+, W-) over non-zero differences.

    Groups are (rung, metric) with one row per split, so the average-rank
    window holds at most n_splits rows."""
    base = metrics.where(F.col(rung) == baseline).select(
        split, metric, F.col(value).alias("_base"))
    cur = metrics.where(F.col(rung) != baseline)
    d = cur.join(base, [split, metric], "inner").select(
        rung, metric, split, (F.col(value) - F.col("_base")).alias("d"))
    nz = d.where(F.col("d") != 0).withColumn("ad", F.abs("d"))
    w = Window.partitionBy(rung, metric).orderBy("ad")
    wt = Window.partitionBy(rung, metric, "ad")
    ranked = nz.withColumn("t", F.count(F.lit(1)).over(wt)).withColumn("r", F.rank().over(w) + (F.col("t") - 1) / 2.0)
    ws = ranked.groupBy(rung, metric).agg(
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.count(F.lit(1)).alias("n_nonzero"),
        F.sum(F.col("t") * F.col("t") - 1).alias("tie_term"),  # sum of t^3 - t over the tied runs
        F.sort_array(F.collect_list((2 * F.col("r")).cast("int"))).alias("ranks"))  # doubled, one per split
    delta = d.groupBy(rung, metric).agg(F.avg("d").alias("delta"), F.count(F.lit(1)).alias("n_pairs"))
    return delta.join(ws, [rung, metric], "left").withColumn(
        "w_stat", F.least("w_plus", "w_minus"))


# ---------------------------------------------------------------- matched coverage
def top_n_positives(df: DataFrame, p: str, y: str, id_col: str, n_per_group: DataFrame,
                    groups: Sequence[str]) -> DataFrame:
    """WN7/AG36: positives among the n highest-scored rows of each group
    (ties in score broken by ascending id), without a per-group window.

    ``n_per_group`` has (groups..., n_top).  Rows strictly above the cut
    score come from cumulative counts; the tie group at the cut is resolved
    by a bucketed prefix count over ids.  A NULL group is a group; one with fewer
    scored rows than n is taken whole, and its precision is over its own rows.
    """
    groups = list(groups)
    dc = rank.descending_counts(df, p, y, groups)
    # rows with score >= v: tp + fp; the cut is the v where that first reaches n_top
    j = join_on_groups(dc, n_per_group, groups).withColumn("_n", F.least("n_top", F.col("pos_total") + F.col("neg_total")))
    at_or_above = F.col("tp") + F.col("fp")
    above = at_or_above - F.col("n")
    cut = j.where((above < F.col("_n")) & (at_or_above >= F.col("_n"))).select(
        *groups, F.col("v").alias("_cut"), "_n",
        (F.col("tp") - F.col("n_pos")).alias("_pos_above"),
        (F.col("_n") - above).alias("_need")).transform(retain)  # read three times
    # tie group at the cut: first ``_need`` rows by id.  ``cut`` has one row
    # per group (group-count-sized).
    rows = df.where(F.col(y).isNotNull()).select(*groups, id_col, F.col(y).cast("bigint").alias("_y"), F.col(p).alias("_v"))
    ties = join_on_groups(rows, cut, groups).where(F.col("_v") == F.col("_cut"))
    tvc = ties.groupBy(*groups, F.col(id_col).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_pos"))
    tps = join_on_groups(rank.prefix_sums(tvc, groups, ["n"]), cut, groups)
    tie_pos = tps.where(F.col("cum_n") < F.col("_need")).groupBy(*groups).agg(
        F.sum("n_pos").alias("_tie_pos"))
    res = join_on_groups(cut, tie_pos, groups, "left").select(
        *groups, "_n", (F.col("_pos_above") + F.coalesce(F.col("_tie_pos"), F.lit(0))).alias("pos_top"))
    out = join_on_groups(n_per_group, res, groups, "left")
    return out.withColumn("matched_precision", F.when(F.col("_n") > 0, F.col("pos_top") / F.col("_n"))).drop("_n")


def paired_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN13: the same (split, id) scored by two models.

    One full outer join on the (unique) keys gives the paired count and both
    one-sided differences (``exceptAll`` each way) in a single aggregation."""
    ka = a.select(*keys).withColumn("_a", F.lit(True))
    kb = b.select(*keys).withColumn("_b", F.lit(True))
    fo = ka.join(kb, list(keys), "full_outer")
    return fo.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                  F.count_if(F.col("_a") & F.col("_b")).alias("n_paired"),
                  F.count_if(F.col("_b").isNull()).alias("n_only_a"),
                  F.count_if(F.col("_a").isNull()).alias("n_only_b"))
