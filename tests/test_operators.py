"""Invariants of composed operators."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_TINY
from tessera.functions.stats import signed_rank_exact_p
from tessera.operators import cohort as co
from tessera.operators import evaluate as ev
from tessera.operators import similar as sm
from tessera.plans import fixtures as fx
from tessera.plans import similarity as simq


def test_veto_never_raises_a_score(spark):
    s = fx.scores(spark, SF_TINY)
    bad = s.where(ev.veto("p_a", "p_b") > F.least("p_a", "p_b") + 1e-12).count()
    assert bad == 0


def test_anti_plus_semi_is_everything(spark):
    d = fx.docs(spark, SF_TINY)
    lab = d.where(F.col("cohort") != "screen")
    scr = d.where(F.col("cohort") == "screen")
    assert co.decontaminate(scr, lab).count() + co.member_of(scr, lab, "key").count() == scr.count()


@pytest.mark.parametrize("part", [8192, 50])
def test_tiles_and_equijoin_neighbours_agree(spark, part):
    q, r, _ = simq._sides(spark, SF_SMALL)
    a = sm.topk_neighbours(q, r, 5, part=part).select(
        "qid", "rid", "nn_rank", F.round("sim", 12).alias("s"))
    b = sm.topk_neighbours(q, r, 5, strategy="equijoin").select("qid", "rid", "nn_rank",
                                                                 F.round("sim", 12).alias("s"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_matched_precision_against_sort(spark):
    lng = fx.scores_long(spark, SF_TINY).where(F.col("model").isin("a", "veto"))
    n_top = lng.select("fold", "model").distinct().withColumn("n_top", F.lit(37))
    got = {(r["fold"], r["model"]): r["pos_top"]
           for r in ev.top_n_positives(lng, "p", "y", "id", n_top, ["fold", "model"]).collect()}
    pdf = lng.toPandas()
    for (f, m), part in pdf.groupby(["fold", "model"]):
        top = part.sort_values(["p", "id"], ascending=[False, True]).head(37)
        assert got[(f, m)] == top.y.sum()


def test_signed_rank_exact_p_by_enumeration():
    import itertools
    n = 7
    ranks = np.arange(1, n + 1)
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in (0, 3, 7, 10, 14):
        lo = min(w, n * (n + 1) / 2 - w)
        brute = min(1.0, 2 * np.mean([s <= lo for s in sums]))
        assert signed_rank_exact_p(w, n) == pytest.approx(brute)


def test_bin_edges_follow_linspace():
    edges = ev.inner_edges(10)
    assert edges[2] == 0.30000000000000004


def test_oof_covers_each_id_once(spark):
    from tessera.plans import learning as L
    oof = L._oof(spark, SF_TINY, lambda tr, te: te.select("id", "y", F.lit(0.5).alias("p")), "const")
    n = fx.embeddings(spark, SF_TINY).count()
    assert oof.count() == n and oof.select("id").distinct().count() == n


def test_group_kfold_keeps_groups_together(spark):
    from tessera.operators import split as sp
    d = fx.docs(spark, SF_TINY).select("doc_id", "grp")
    f = sp.group_kfold(d, "grp", 5)
    assert f.groupBy("grp").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0


def test_stratified_kfold_balances_classes(spark):
    from tessera.operators import split as sp
    e = fx.embeddings(spark, SF_SMALL).select("id", "y")
    f = sp.stratified_kfold(e, "id", "y", 5).groupBy("y", "fold").count().toPandas()
    for _, part in f.groupby("y"):
        assert part["count"].max() - part["count"].min() <= 1


def test_screening_fallback_runs(spark):
    from tessera.plans import screening as scq
    out = scq._fallback_scores(spark, SF_TINY)
    rows = out.collect()
    assert rows and all(0.0 <= r["proba"] <= 1.0 for r in rows)


def test_minhash_recall_against_exact(spark):
    q, r, _ = simq._sides(spark, SF_SMALL)
    exact = sm.topk_neighbours(q, r, 50, strategy="equijoin").where(F.col("sim") >= 0.8) \
        .select("qid", "rid")
    approx = sm.minhash_join(q, r, threshold=0.6).select("qid", "rid")
    n_exact = exact.count()
    if n_exact == 0:
        pytest.skip("no highly similar pairs in this fixture")
    found = exact.join(approx, ["qid", "rid"], "left_semi").count()
    assert found / n_exact >= 0.9


def test_flagship_pvalues_and_bh(spark):
    import math
    from tessera.plans import panel
    rows = panel.compare_targets(spark, SF_TINY).collect()
    z = np.array([r["z"] for r in rows])
    p = np.minimum(1.0, np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in z]))
    for r, pv in zip(rows, p):
        assert r["p_value"] == pytest.approx(pv, abs=1e-6)
    order = np.argsort(p, kind="stable")
    m = len(p)
    q = p[order] * m / np.arange(1, m + 1)
    adj = np.empty(m)
    adj[order] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
    for r, a in zip(rows, adj):
        assert r["p_adjusted"] == pytest.approx(a, abs=1e-6)
        assert r["significant"] == (r["p_adjusted"] < 0.001)
