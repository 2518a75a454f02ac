"""Spark ML protocols on F-EMB (ML1-ML8, ML11, ML13-ML17, TK2).

Feature blocks of the 64-wide embedding play the reference's feature sets:
``base`` = features 0-31 (structure block), ``extra6`` = 32-37 (six global
scores), ``wide`` = 38-63 (the wide block that gets denoised).  Trained
scorers are checked by invariants (rows-only), never by value.
Boosted trees run up to 400 iterations and stop early on their held-out tenth.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.functions.stats import signed_rank_p
from tessera.operators import denoise as dn
from tessera.operators import evaluate as ev
from tessera.operators import learn as ln
from tessera.operators import rank
from tessera.operators import split as sp
from tessera.operators.extratrees import fit_extra_trees
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.denoising import chosen_size
from tessera.plans.registry import query
from tessera.sources.tables import table
from tessera.session import drop_shared, retain, write_shared

GBT_ITERS = 400
BASE, EXTRA6, WIDE = list(range(0, 32)), list(range(32, 38)), list(range(38, 64))


def _blocks(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)

    def pick(idx):
        return F.array(*[F.col("x")[i] for i in idx])
    return e.select("id", "y", "x", pick(BASE).alias("base"), pick(EXTRA6).alias("extra6"),
                    pick(WIDE).alias("wide"))


def _train_test(spark, sf_dir):
    e = sp.hash_kfold(_blocks(spark, sf_dir), "id", 5)
    return e.where(F.col("fold") != 0), e.where(F.col("fold") == 0)


def _gbt(tr, te):
    return ln.fit_gbt(tr, te, max_iter=GBT_ITERS)


@query("pr07_assembled_blocks", """
SELECT vec_id AS id, 38 AS width, round(list_sum(list_slice(embedding, 1, 38))::DOUBLE, 4) AS total,
       round(embedding[33]::DOUBLE, 6) AS first_of_extra FROM embeddings""")
def pr07_assembled_blocks(spark, sf_dir):
    """PR7: blocks concatenated in order into one vector."""
    v = vector_to_array(F.col("features"))
    a = ln.assemble(_blocks(spark, sf_dir), ["base", "extra6"])
    return a.select("id", F.size(v).alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
                    F.round(v[32], 6).alias("first_of_extra"))


@query("ml01_gbt_scores")
def ml01_gbt_scores(spark, sf_dir):
    """ML1: boosted-tree P(class 1) on the held-out fold."""
    tr, te = _train_test(spark, sf_dir)
    return finish(_gbt(ln.assemble(tr, ["x"]), ln.assemble(te, ["x"])))


@query("ml02_logistic_scores")
def ml02_logistic_scores(spark, sf_dir):
    """ML2: balanced logistic model on standardised features (training statistics)."""
    tr, te = _train_test(spark, sf_dir)
    st = dn.zscore_fit(tr)
    a = ln.assemble(dn.zscore_apply(tr, st), ["z"])
    b = ln.assemble(dn.zscore_apply(te, st), ["z"])
    return finish(ln.fit_logistic(a, b))


@query("ml03_linear_svc_scores")
def ml03_linear_svc_scores(spark, sf_dir):
    """ML3: linear SVM margins, per block and combined."""
    tr, te = _train_test(spark, sf_dir)
    tasks = []
    for name, cols in [("base", ["base"]), ("extra6", ["extra6"]), ("wide", ["wide"]), ("combined", ["x"])]:
        a, b = ln.assemble(tr, cols), ln.assemble(te, cols)
        tasks.append(({"block": name}, (lambda a=a, b=b: ln.fit_linear_svc(a, b))))
    return finish(ln.run_parallel(tasks))


@query("ml04_regressor_rmse")
def ml04_regressor_rmse(spark, sf_dir):
    """ML4: regression of the raw label value; RMSE per learner."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    e = sp.hash_kfold(fx.embeddings(spark, sf_dir).join(raw, "id"), "id", 5)
    e = ln.assemble(e.withColumn("y", F.col("label").cast("double")), ["x"])
    tr, te = e.where(F.col("fold") != 0), e.where(F.col("fold") == 0)
    tasks = [({"model": k}, (lambda k=k: ln.fit_regressor(tr, te, k, max_iter=GBT_ITERS)))
             for k in ("gbt", "forest", "linear")]
    return finish(ev.rmse(ln.run_parallel(tasks), "p", "y", ["model"]))


@query("ml05_forest_scores")
def ml05_forest_scores(spark, sf_dir):
    """ML5: randomised-forest P(class 1) on the held-out fold."""
    tr, te = _train_test(spark, sf_dir)
    return finish(ln.fit_forest(ln.assemble(tr, ["x"]), ln.assemble(te, ["x"])))


@query("ml05_extra_trees_scores")
def ml05_extra_trees_scores(spark, sf_dir):
    """ML5: extremely randomised trees' P(class 1) on the held-out fold."""
    tr, te = _train_test(spark, sf_dir)
    return finish(fit_extra_trees(ln.assemble(tr, ["x"]), ln.assemble(te, ["x"])))


def _denoised_blocks(tr, te):
    """Denoise the wide block on training rows; add the selected and the
    reconstructed-selected columns to both sides.  Their number is chosen by
    inner selection (ML10) on the training rows."""
    fit_rows = tr.select("id", F.col("wide").alias("x"), "y")
    with ThreadPoolExecutor(max_workers=1) as pool:
        size = pool.submit(chosen_size, tr.sparkSession, fit_rows)
        sel = dn.denoise_fit(fit_rows)
        cols = sel.order[:size.result()]
    out = []
    for d in (tr, te):
        rec = dn.reconstruct(d.withColumnRenamed("x", "_x_all").withColumnRenamed("wide", "x"),
                             sel.spectrum, sel.mean, sel.scale) \
            .withColumnRenamed("x", "wide").withColumnRenamed("_x_all", "x")
        rec = rec.withColumn("sel", F.array(*[F.col("wide")[c] for c in cols])) \
                 .withColumn("rec", F.array(*[F.col("x_rec")[c] for c in cols]))
        out.append(rec)
    return out[0], out[1]


RUNGS = [("structure", ["base"]), ("+extra6", ["base", "extra6"]), ("+wide", ["base", "wide"]),
         ("+wide_sel", ["base", "sel"]), ("+wide_rec", ["base", "rec"])]


@query("ml06_feature_ablation")
def ml06_feature_ablation(spark, sf_dir):
    """ML6: one learner, five feature variants; AUC and AP each, best marked (TK2)."""
    tr, te = _train_test(spark, sf_dir)
    tr, te = _denoised_blocks(tr, te)
    tasks = [({"variant": v}, (lambda c=c: _gbt(ln.assemble(tr, c), ln.assemble(te, c))))
             for v, c in RUNGS]
    preds = ln.run_parallel(tasks)
    auc = rank.rank_sum_test(preds, "p", "y", ["variant"]).select("variant", "auc")
    ap = rank.average_precision(preds, "p", "y", ["variant"])
    res = auc.join(ap, "variant")
    order = {v: i for i, (v, _) in enumerate(RUNGS)}
    ordc = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    best = res.agg(F.max(F.struct("auc", (-ordc[F.col("variant")]).alias("_o"), "variant")).alias("b"))
    return finish(with_scalars(res, best.select(F.col("b.variant").alias("_best")))
        .select("variant", "auc", "average_precision", (F.col("variant") == F.col("_best")).alias("is_best")))


def _group():
    """The group of an embedding: the index of its largest component."""
    return F.array_position(F.col("x"), F.array_max("x"))


def _registry_splits(spark, sf_dir, n_random):
    e = _blocks(spark, sf_dir)
    return e, sp.split_registry(e.withColumn("grp", _group()), "id", "y", "grp", n_random=n_random)


@query("ml07_calibration_ablation")
def ml07_calibration_ablation(spark, sf_dir):
    return calibration_ablation(spark, sf_dir)


def calibration_ablation(spark, sf_dir, n_random=10):
    """ML7: rungs x (``n_random`` random + 1 grouped) splits -> calibration metrics (AG26-AG32),
    per scheme the across-split mean / sd (AG34), over the random splits the paired
    signed-rank test against the structure rung (AG35), and the veto/fusion block.

    The registry is stored once, each split's rows are persisted and its denoised blocks
    stored (splits in parallel) for the steps and the six fits that read them.  Predictions
    are stored before the blocks are dropped: what follows neither recomputes nor plans the
    fits again."""
    e, reg = _registry_splits(spark, sf_dir, n_random)
    reg = write_shared(reg.select("split_id", "id", "set"), "registry")
    splits = [r[0] for r in reg.select("split_id").distinct().orderBy("split_id").collect()]
    cores = spark.sparkContext.defaultParallelism

    def blocks(s):
        part = e.join(reg.where(F.col("split_id") == s).select("id", "set"), "id").transform(retain)
        rows = ln.in_few(part, part.count())
        both = _denoised_blocks(rows.where(F.col("set") == "train"), rows.where(F.col("set") == "test"))
        kept = [write_shared(d.select("id", "y", "base", "extra6", "wide", "sel", "rec"), "ablation-set") for d in both]
        tr, te = [ln.in_few(d, d.count()) for d in kept]
        part.unpersist()
        return s, tr, te, kept

    with ThreadPoolExecutor(max_workers=len(splits) or 1) as pool:
        per_split = list(pool.map(blocks, splits))
    tasks = []
    for s, tr, te, _ in per_split:
        for v, c in RUNGS:
            tasks.append(({"split_id": s, "rung": v},
                          (lambda c=c, tr=tr, te=te: _gbt(ln.assemble(tr, c), ln.assemble(te, c)))))
        tasks.append(({"split_id": s, "rung": "denoised_only"},
                      (lambda tr=tr, te=te: _gbt(ln.assemble(tr, ["rec"]), ln.assemble(te, ["rec"])))))
    preds = write_shared(ln.run_parallel(tasks).coalesce(cores), "ablation-scores")
    drop_shared(reg, *[d for *_, kept in per_split for d in kept])
    with ThreadPoolExecutor(max_workers=1) as pool:
        veto_rows = pool.submit(_veto_block, preds)
        m = ev.confidence_metrics(preds.where(F.col("rung") != "denoised_only"), "p", "y", ["split_id", "rung"]).transform(retain)
        veto_rows = veto_rows.result()
    cols = [c for c in m.columns if c not in ("split_id", "rung")]
    frame = m.unpivot(["split_id", "rung"], cols, "metric", "value")
    scheme = F.regexp_extract("split_id", "^[a-z]+", 0)
    every = frame.unionByName(veto_rows).withColumn("scheme", scheme)
    paired = ev.paired_signed_rank(frame.where(F.col("split_id").startswith("random")), "split_id", "rung", "metric", "structure")
    paired = paired.select(F.lit("random").alias("scheme"), "rung", "metric", "delta", "w_stat",
                           signed_rank_p("w_plus", "w_minus", "ranks").alias("p_value"))
    return finish(ev.split_summary(every, ["scheme", "rung", "metric"]).join(paired, ["scheme", "rung", "metric"], "left"))


def _veto_block(preds):
    """ML7 veto / fusion block per split: structure score vs the product veto
    and the mean fusion with the denoised scorer (rates at 0.5, AUC, AP, Brier, matched
    precision at the veto's 0.7 coverage); long (split_id, rung, metric, value)."""
    w = preds.where(F.col("rung").isin("structure", "denoised_only")) \
        .groupBy("split_id", "id", "y").pivot("rung", ["structure", "denoised_only"]).agg(F.first("p"))
    w = w.withColumn("veto", ev.veto("structure", "denoised_only")) \
         .withColumn("mean_fusion", ev.mean_fusion("structure", "denoised_only")).transform(retain)
    eff = ev.veto_effect(w, "structure", "veto", "y", ["split_id"], 0.5)
    rates = eff.unpivot(["split_id"], ["fpr_before", "fpr_after", "recall_before", "recall_after",
                                       "fpr_reduction_pct"], "metric", "value")
    lng = w.unpivot(["split_id", "id", "y"], ["structure", "veto", "mean_fusion"], "model", "p")
    n_top = w.groupBy("split_id").agg(F.count_if(F.col("veto") >= 0.7).alias("n_top"))
    nt = lng.select("split_id", "model").distinct().join(n_top, "split_id")
    keys = ["split_id", "model"]
    # each ranks the scores in jobs of its own
    with ThreadPoolExecutor(max_workers=3) as pool:
        auc, mp, ap = (f.result() for f in [pool.submit(rank.rank_sum_test, lng, "p", "y", keys),
                                            pool.submit(ev.top_n_positives, lng, "p", "y", "id", nt, keys),
                                            pool.submit(rank.average_precision, lng, "p", "y", keys)])
    auc = auc.select("split_id", F.concat(F.lit("auc_"), F.col("model")).alias("metric"), F.col("auc").alias("value"))
    mp = mp.select("split_id", F.concat(F.lit("matched_precision_"), F.col("model")).alias("metric"),
                   F.col("matched_precision").alias("value"))
    ap = ap.select("split_id", F.concat(F.lit("average_precision_"), F.col("model")).alias("metric"), F.col("average_precision").alias("value"))
    brier = lng.groupBy("split_id", "model").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("value")).select(
        "split_id", F.concat(F.lit("brier_"), F.col("model")).alias("metric"), "value")
    out = rates.unionByName(auc).unionByName(mp).unionByName(ap).unionByName(brier)
    return out.select("split_id", F.lit("veto_block").alias("rung"), "metric", "value")


@query("ml08_single_block")
def ml08_single_block(spark, sf_dir):
    """ML8: single-block baselines: each block alone and all combined."""
    tr, te = _train_test(spark, sf_dir)
    blocks = [("base", ["base"]), ("extra6", ["extra6"]), ("wide", ["wide"]), ("combined", ["x"])]
    tasks = [({"block": b}, (lambda c=c: _gbt(ln.assemble(tr, c), ln.assemble(te, c)))) for b, c in blocks]
    preds = ln.run_parallel(tasks)
    return finish(rank.rank_sum_test(preds, "p", "y", ["block"]).select("block", "n_pos", "n_neg", "auc"))


@query("ml11_veto_pipeline")
def ml11_veto_pipeline(spark, sf_dir):
    """ML11: structure scorer x denoised scorer: AUC before/after and FPR/recall rates."""
    tr, te = _train_test(spark, sf_dir)
    tr, te = _denoised_blocks(tr, te)
    tasks = [({"model": "structure"}, (lambda: _gbt(ln.assemble(tr, ["base"]), ln.assemble(te, ["base"])))),
             ({"model": "denoised"}, (lambda: _gbt(ln.assemble(tr, ["rec"]), ln.assemble(te, ["rec"]))))]
    preds = ln.run_parallel(tasks)
    wide = preds.groupBy("id", "y").pivot("model", ["structure", "denoised"]).agg(F.first("p"))
    wide = wide.withColumn("veto", ev.veto("structure", "denoised"))
    eff = ev.veto_effect(wide.withColumn("_g", F.lit(0)), "structure", "veto", "y", ["_g"], 0.5)
    lng = wide.unpivot(["id", "y"], ["structure", "veto"], "model", "p").withColumn("_g", F.lit(0))
    auc = rank.rank_sum_test(lng, "p", "y", ["_g", "model"]).groupBy("_g").pivot(
        "model", ["structure", "veto"]).agg(F.first("auc"))
    auc = auc.select("_g", F.col("structure").alias("auc_before"), F.col("veto").alias("auc_after"))
    return finish(eff.join(auc, "_g").drop("_g"))


def _oof(spark, sf_dir, fitter, model, fold_df=None):
    e = fold_df if fold_df is not None else sp.stratified_kfold(_blocks(spark, sf_dir), "id", "y", 5)
    e = ln.assemble(e, ["x"])
    return ln.cv_predictions(e, "fold", fitter, model)


@query("ml13_kfold_cv")
def ml13_kfold_cv(spark, sf_dir):
    """ML13: stratified 5-fold CV AUC of the boosted trees: mean and population sd."""
    return finish(ln.cv_score(_oof(spark, sf_dir, _gbt, "gbt")))


@query("ml14_oof_table")
def ml14_oof_table(spark, sf_dir):
    """ML14: out-of-fold table; every id appears once."""
    return finish(_oof(spark, sf_dir, _gbt, "gbt"))


@query("ml15_two_model_blend")
def ml15_two_model_blend(spark, sf_dir):
    """ML15: two OOF models, fixed 0.5 blend, best blend weight (AG40/TK2) and lift (AG41)."""
    folds = ln.assemble(sp.stratified_kfold(_blocks(spark, sf_dir), "id", "y", 5), ["x"])
    both = ln.cv_predictions_many(folds, "fold", {
        "gbt": _gbt, "forest": ln.fit_forest})
    a, b = both.where(F.col("model") == "gbt"), both.where(F.col("model") == "forest")
    grid = ln.blend_grid(a, b, 41)
    half = grid.where(F.col("w") == 0.5).select(F.col("metric").alias("auc_half_blend"))
    best = ln.best_blend(grid)
    return finish(with_scalars(best, half))


def _learners():
    return {
        "gbt": _gbt,
        "forest": ln.fit_forest,
        "logistic": ln.fit_logistic,
        "svc": ln.fit_linear_svc,
        "extra_trees": fit_extra_trees,
    }


def _stack(spark, sf_dir, folds):
    oofs = ln.cv_predictions_many(ln.assemble(folds, ["x"]), "fold", _learners())
    base = rank.rank_sum_test(oofs, "p", "y", ["model"]).select("model", "auc")
    wide = oofs.groupBy("id", "y", "fold").pivot("model", list(_learners())).agg(F.first("p"))
    names = list(_learners())
    # mean blend of all learners; a margin enters through the logistic function
    parts = [1.0 / (1.0 + F.exp(-F.col(n))) if n == "svc" else F.col(n) for n in names]
    wide = wide.withColumn("mean_blend", sum(parts) / float(len(parts)))
    mean_auc = rank.rank_sum_test(wide.withColumn("_m", F.lit("mean_blend")), "mean_blend", "y", ["_m"]) \
        .select(F.col("_m").alias("model"), "auc")
    # meta-learner CV on the OOF columns (non-nested, as in the reference protocol)
    meta_in = ln.assemble(wide, names)
    meta = ln.cv_predictions(meta_in, "fold", lambda tr, te: ln.fit_logistic(tr, te, balanced=False), "meta")
    meta_auc = rank.rank_sum_test(meta, "p", "y", ["model"]).select("model", "auc")
    return base.unionByName(mean_auc).unionByName(meta_auc)


@query("ml16_stack")
def ml16_stack(spark, sf_dir):
    """ML16: five learners' OOF scores, their mean blend and a logistic meta-learner."""
    folds = sp.stratified_kfold(_blocks(spark, sf_dir), "id", "y", 5)
    return finish(_stack(spark, sf_dir, folds))


@query("ml17_grouped_eval")
def ml17_grouped_eval(spark, sf_dir):
    """ML17: as ML16 with group folds balanced in size and class; the group is the
    index of the largest embedding component (no group spans two folds)."""
    b = _blocks(spark, sf_dir)
    folds = sp.balanced_group_kfold(b.withColumn("grp", _group()), "grp", 5, label="y").drop("grp")
    return finish(_stack(spark, sf_dir, folds))


@query("ml16_stack_regression")
def ml16_stack_regression(spark, sf_dir):
    """ML16/ML13/AG40/AG41 for an RMSE endpoint: regressors' OOF predictions of
    the raw label value, their CV RMSE, a linear meta-learner on the OOF
    columns, and the best two-model blend with its sign-aware lift."""
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    e = fx.embeddings(spark, sf_dir).join(raw, "id").withColumn("y", F.col("label").cast("double"))
    folds = sp.hash_kfold(e.select("id", "y", "x"), "id", 5)
    learners = {"gbt": lambda tr, te: ln.fit_regressor(tr, te, "gbt", max_iter=GBT_ITERS),
                "forest": lambda tr, te: ln.fit_regressor(tr, te, "forest"),
                "linear": lambda tr, te: ln.fit_regressor(tr, te, "linear"),
                "extra_trees": fit_extra_trees,
                "extra_trees_shallow": lambda tr, te: fit_extra_trees(tr, te, max_depth=5, seed=43)}
    oofs = ln.cv_predictions_many(ln.assemble(folds, ["x"]), "fold", learners)
    scores = ln.cv_score(oofs, task="regression")
    wide = oofs.groupBy("id", "y", "fold").pivot("model", list(learners)).agg(F.first("p"))
    meta = ln.cv_predictions(ln.assemble(wide, list(learners)), "fold",
                             lambda tr, te: ln.fit_regressor(tr, te, "linear"), "meta_linear")
    meta_score = ln.cv_score(meta, task="regression")
    grid = ln.blend_grid(oofs.where(F.col("model") == "gbt"), oofs.where(F.col("model") == "forest"),
                         41, task="regression")
    best = ln.best_blend(grid, higher_is_better=False).select(
        F.lit("blend_gbt_forest").alias("model"), F.col("best_metric").alias("mean"),
        F.lit(None).cast("double").alias("sd"), F.lit(None).cast("long").alias("n_folds"),
        "best_w", "lift")
    out = scores.unionByName(meta_score).withColumn("best_w", F.lit(None).cast("double")) \
        .withColumn("lift", F.lit(None).cast("double"))
    return finish(out.unionByName(best))
