"""Denoising queries on F-EMB (PR9, PR10, AG10-AG18, TK1, TK6, WN8, ML9, ML10).

Training rows are the embeddings outside hash fold 0 (SP1, k=5, seed 42);
test rows are fold 0.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tessera.operators import denoise as dn
from tessera.operators import learn as ln
from tessera.operators import prefixfit as pf
from tessera.operators import rank
from tessera.operators import split as sp
from tessera.plans import fixtures as fx
from tessera.plans.common import finish
from tessera.plans.registry import query
from tessera.plans.sql_fixtures import EMB_LONG, with_
from tessera.session import drop_shared, retain, write_shared


def _split(spark, sf_dir):
    e = sp.hash_kfold(fx.embeddings(spark, sf_dir), "id", 5)
    return e.where(F.col("fold") != 0).drop("fold"), e.where(F.col("fold") == 0).drop("fold")


_STATS = with_(EMB_LONG) + """
, tr AS (SELECT * FROM emb_long WHERE is_train),
n AS (SELECT count(DISTINCT id) AS n FROM tr),
st AS (SELECT j, avg(value) AS mean, count(value) AS c, stddev_pop(value) AS sd FROM tr GROUP BY j),
sc AS (SELECT j, mean, CASE WHEN coalesce(sd, 0) * sqrt(c / n) < 1e-12 THEN 1.0
                          ELSE coalesce(sd, 0) * sqrt(c / n) END AS scale FROM st, n),
z AS (SELECT e.id, e.y, e.j, e.is_train, (coalesce(e.value, sc.mean) - sc.mean) / sc.scale AS z
      FROM emb_long e JOIN sc USING (j))
"""


@query("pr09_zscore_fit", _STATS + """
SELECT j, round(mean, 6) AS mean, round(scale, 6) AS scale FROM sc""")
def pr09_zscore_fit(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    return finish(dn.zscore_fit(tr))


@query("pr10_scaler_apply", _STATS + """
SELECT id, round(sum(z), 6) AS z_sum, round(sum(z * z), 6) AS z_sq FROM z WHERE NOT is_train GROUP BY id""")
def pr10_scaler_apply(spark, sf_dir):
    """PR10: training statistics applied to the held-out rows."""
    tr, te = _split(spark, sf_dir)
    z = dn.zscore_apply(te, dn.zscore_fit(tr))
    return finish(z.select("id",
                           F.aggregate("z", F.lit(0.0), lambda a, v: a + v).alias("z_sum"),
                           F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v).alias("z_sq")))


@query("ag10_correlation", _STATS + """
SELECT a.j::BIGINT AS j, b.j::BIGINT AS k, round(sum(a.z * b.z) / ((SELECT n FROM n) - 1), 6) AS c
FROM z a JOIN z b ON a.id = b.id AND a.is_train AND b.is_train GROUP BY a.j, b.j""")
def ag10_correlation(spark, sf_dir):
    """AG10: Z^T Z/(n-1) of the z-scored training rows, summed from partition partials."""
    tr, _ = _split(spark, sf_dir)
    z = dn.zscore_apply(tr, dn.zscore_fit(tr))
    return finish(dn.correlation_frame(z))


@query("ag11_noise_edge", with_(EMB_LONG) + """
, n AS (SELECT count(DISTINCT id) AS n, count(DISTINCT j) AS p FROM emb_long WHERE is_train)
SELECT n, p, round(p / n, 6) AS q, round(pow(1 + sqrt(p / n), 2), 6) AS lambda_plus FROM n""")
def ag11_noise_edge(spark, sf_dir):
    """AG11: q = p/n and the noise edge (1 + sqrt(q))^2 of the training block."""
    tr, _ = _split(spark, sf_dir)
    n = tr.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).cast("bigint").alias("p"))
    q = F.col("p") / F.col("n")
    return finish(n.select("n", "p", q.alias("q"), F.pow(1 + F.sqrt(q), 2).alias("lambda_plus")))


@query("ag11_spectrum")
def ag11_spectrum(spark, sf_dir):
    """AG11: eigenvalues (descending) with the strict signal flag."""
    tr, _ = _split(spark, sf_dir)
    values, signal = dn.full_spectrum(*dn.correlation(dn.zscore_apply(tr, dn.zscore_fit(tr))))
    rows = [(i + 1, float(v), bool(f)) for i, (v, f) in enumerate(zip(values, signal))]
    return finish(spark.createDataFrame(rows, "position int, eigenvalue double, is_signal boolean"))


@query("ag12_feature_prior")
def ag12_feature_prior(spark, sf_dir):
    tr, _ = _split(spark, sf_dir)
    rows = [(i, float(v)) for i, v in enumerate(dn.fit_signal(tr)[0].prior)]
    return finish(spark.createDataFrame(rows, "j int, prior double"))


@query("ag13_spearman", with_(EMB_LONG) + """
, tr AS (SELECT * FROM emb_long WHERE is_train),
r AS (SELECT j, y, rank() OVER (PARTITION BY j ORDER BY value)
                   + (count(*) OVER (PARTITION BY j, value) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY j ORDER BY y) + (count(*) OVER (PARTITION BY j, y) - 1) / 2.0 AS ry
      FROM tr)
SELECT j, round(coalesce(abs(corr(rx, ry)), 0.0), 6) AS abs_rho FROM r GROUP BY j""")
def ag13_spearman(spark, sf_dir):
    """AG13: |Spearman rho| of each feature with the label (average ranks)."""
    tr, _ = _split(spark, sf_dir)
    return finish(dn.spearman_to_label(tr))


@query("ag14_hybrid_order")
def ag14_hybrid_order(spark, sf_dir):
    """AG14: hybrid score prior * |rho| and its order."""
    tr, _ = _split(spark, sf_dir)
    z = dn.zscore_apply(tr, dn.zscore_fit(tr))
    return finish(dn.hybrid_order(dn.fit_signal(tr)[0].prior, dn.spearman_to_label(z.select("z", "y"), "z"), spark))


@query("tk01_top_features")
def tk01_top_features(spark, sf_dir):
    """TK1: the 15 best features by hybrid score."""
    return ag14_hybrid_order(spark, sf_dir).orderBy(F.col("hybrid").desc(), "j").limit(15)


_GIVEN = with_(EMB_LONG) + """
, tr AS (SELECT * FROM emb_long WHERE is_train),
pri AS (SELECT j, stddev_pop(value) AS prior FROM tr GROUP BY j),
r AS (SELECT j, y, rank() OVER (PARTITION BY j ORDER BY value)
                   + (count(*) OVER (PARTITION BY j, value) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY j ORDER BY y) + (count(*) OVER (PARTITION BY j, y) - 1) / 2.0 AS ry
      FROM tr),
rho AS (SELECT j, coalesce(abs(corr(rx, ry)), 0.0) AS abs_rho FROM r GROUP BY j),
h AS (SELECT j::INTEGER AS j, prior, abs_rho, prior * abs_rho AS hybrid, row_number() OVER (ORDER BY prior * abs_rho DESC, j) AS position
      FROM pri JOIN rho USING (j)),
e AS (SELECT j::INTEGER AS j, prior, coalesce(sum(prior) OVER (ORDER BY prior DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
             / sum(prior) OVER () AS cum_share_before FROM pri)
"""


def _given_prior(spark, sf_dir):
    """A prior that SQL can state: the spread of every feature over the training rows."""
    tr, _ = _split(spark, sf_dir)
    rows = dn.long_features(tr, "x", []).groupBy("j").agg(F.stddev_pop("value").alias("prior")).orderBy("j").collect()
    return [r["prior"] for r in rows], tr


@query("ag14_hybrid_order_given", _GIVEN + """
SELECT j, round(prior, 6) AS prior, round(abs_rho, 6) AS abs_rho, round(hybrid, 6) AS hybrid, position::INTEGER AS position FROM h""")
def ag14_hybrid_order_given(spark, sf_dir):
    """AG14 on a given prior."""
    prior, tr = _given_prior(spark, sf_dir)
    return finish(dn.hybrid_order(prior, dn.spearman_to_label(tr.select("x", "y")), spark))


@query("tk01_top_features_given", _GIVEN + """
SELECT j, round(prior, 6) AS prior, round(abs_rho, 6) AS abs_rho, round(hybrid, 6) AS hybrid, position::INTEGER AS position
FROM h WHERE position <= 15""")
def tk01_top_features_given(spark, sf_dir):
    """TK1 on a given prior: the 15 best features."""
    return ag14_hybrid_order_given(spark, sf_dir).orderBy("position").limit(15)


@query("ag17_energy_gate_given", _GIVEN + """
SELECT j, round(prior, 6) AS prior, round(cum_share_before, 6) AS cum_share_before, cum_share_before < 0.98 AS kept FROM e""")
def ag17_energy_gate_given(spark, sf_dir):
    """AG17 on a given prior."""
    return finish(dn.energy_gate(_given_prior(spark, sf_dir)[0], spark, 0.98))


@query("ag15_reconstruction")
def ag15_reconstruction(spark, sf_dir):
    """AG15: signal-subspace reconstruction of every row (training statistics)."""
    tr, _ = _split(spark, sf_dir)
    spec, _, mean, scale = dn.fit_signal(tr)
    rec = dn.reconstruct(fx.embeddings(spark, sf_dir), spec, mean, scale)
    return finish(rec.select("id", F.aggregate("x_rec", F.lit(0.0), lambda a, v: a + v).alias("rec_sum")))


@query("ag16_block_sum", with_(EMB_LONG) + """
SELECT id, round(sum(value), 6) AS block_sum FROM emb_long WHERE j < 8 GROUP BY id""")
def ag16_block_sum(spark, sf_dir):
    """AG16: summed column of a declared feature block (features 0-7)."""
    e = fx.embeddings(spark, sf_dir)
    return finish(e.select("id", dn.block_sum("x", range(8)).alias("block_sum")))


@query("ag17_energy_gate")
def ag17_energy_gate(spark, sf_dir):
    """AG17 (own definition): features kept up to 98 % of the prior mass."""
    tr, _ = _split(spark, sf_dir)
    return finish(dn.energy_gate(dn.fit_signal(tr)[0].prior, spark, 0.98))


@query("ag18_constant_filter", with_(EMB_LONG) + """
SELECT j, round(stddev_pop(value), 6) AS sd, coalesce(stddev_pop(value) = 0, true) AS is_constant
FROM emb_long GROUP BY j""")
def ag18_constant_filter(spark, sf_dir):
    return finish(dn.constant_filter(fx.embeddings(spark, sf_dir)))


def _prefix_scores(spark, sf_dir):
    e = sp.hash_kfold(fx.embeddings(spark, sf_dir), "id", 5)
    p = e.agg(F.max(F.size("x"))).first()[0]
    grid = _sizes(spark, int(p))
    cum = F.transform(F.sequence(F.lit(1), F.size("x")),
                      lambda i: F.aggregate(F.slice("x", 1, i), F.lit(0.0), lambda a, v: a + v))
    long = e.select("fold", "id", "y", F.posexplode(cum).alias("pos", "score")) \
        .withColumn("m", F.col("pos") + 1).where(F.col("m").isin(grid))
    return rank.rank_sum_test(long, "score", "y", ["fold", "m"]).select("fold", "m", "auc")


@query("tk06_best_m", with_(EMB_LONG) + """
, pre AS (SELECT id, y, j + 1 AS m, sum(value) OVER (PARTITION BY id ORDER BY j) AS score,
                 ('0x' || substr(md5('42:' || id::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM emb_long),
rk AS (SELECT fold, m, y, rank() OVER (PARTITION BY fold, m ORDER BY score)
                  + (count(*) OVER (PARTITION BY fold, m, score) - 1) / 2.0 AS ar FROM pre WHERE m >= 2),
auc AS (SELECT fold, m, (sum(ar) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
                 / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc FROM rk GROUP BY fold, m),
per AS (SELECT m, avg(auc) AS mean_metric, stddev_pop(auc) AS sd_metric FROM auc GROUP BY m)
SELECT m::INTEGER AS m_opt, round(mean_metric, 6) AS mean_metric, round(sd_metric, 6) AS sd_metric
FROM per WHERE mean_metric = (SELECT max(mean_metric) FROM per) ORDER BY m LIMIT 1""")
def tk06_best_m(spark, sf_dir):
    """TK6: best feature count over the size grid by mean fold AUC of the
    prefix-sum score (ties -> smallest count)."""
    return finish(dn.best_size(_prefix_scores(spark, sf_dir)))


@query("wn08_fold_order")
def wn08_fold_order(spark, sf_dir):
    """WN8: feature order re-ranked inside each inner training fold."""
    tr, _ = _split(spark, sf_dir)
    sss = sp.stratified_shuffle(tr.select("id", "y"), "id", "y", 4, 0.7)

    def order(r):
        fit_ids = sss.where((F.col("repeat") == r) & (F.col("set") == "train")).select("id")
        return dn.denoise_fit(tr.join(fit_ids, "id", "left_semi")).order

    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = [(r, pos + 1, j) for r, found in enumerate(pool.map(order, range(4))) for pos, j in enumerate(found)]
    return spark.createDataFrame(rows, "fold int, position int, j int")


def _sizes(spark, p: int, n_points: int = 90) -> list[int]:
    """The feature counts of ST4 for one p, ascending."""
    return sorted(r["m"] for r in sp.size_grid_frame(spark.createDataFrame([(p,)], "p int"), n_points).collect())


def inner_selection(spark, train, grid_points: int = 90, n_inner: int = 4):
    """ML10: inner choice of the feature count: per stratified 70/30 shuffle,
    re-rank features on the fit part, then for each m fit the balanced
    logistic model on the standardised top-m features and score the
    validation part.  Returns the (fold, m, auc) table.

    The top-m columns are a prefix of the fold's ordered block: all counts of all
    folds are fitted together (``prefixfit``)."""
    p = train.agg(F.max(F.size("x"))).first()[0]
    grid = _sizes(spark, int(p), grid_points)
    sss = sp.stratified_shuffle(train.select("id", "y"), "id", "y", n_inner, 0.7)
    sets = sss.groupBy("id").agg(*[F.max(F.when(F.col("repeat") == r, (F.col("set") == "train").cast("int"))).alias(f"s{r}") for r in range(n_inner)])
    # stored, then persisted: some twenty jobs read the rows, and none plans the shuffles again
    stored = write_shared(train.select("id", "x", "y").join(sets, "id").select(
        "x", "y", F.array(*[f"s{r}" for r in range(n_inner)]).alias("sets")), "inner-rows")
    kept = stored.transform(retain)
    rows = ln.in_few(kept, kept.count(), int(p))
    fitted = dn.denoise_fits(rows, n_inner)
    folds = [pf.Fold(r, f.order, f.mean, f.scale, w) for r, (f, w) in enumerate(zip(fitted, pf.train_weights(rows, n_inner)))]
    preds = pf.score_prefixes(rows, folds, pf.fit_prefixes(rows, folds, grid, ln.LOGISTIC_C))
    out = write_shared(rank.rank_sum_test(preds, "p", "y", ["fold", "m"]).select("fold", "m", "auc"), "inner-scores")
    kept.unpersist()
    drop_shared(stored)
    return out


def chosen_size(spark, train) -> int:
    """TK6 of ML10: the feature count chosen on the training rows (id, x, y) alone."""
    return int(dn.best_size(inner_selection(spark, train)).first()["m_opt"])


def _inner_scores(spark, sf_dir):
    """The (fold, m, auc) table of the training split over the 90-point grid,
    shared by ML9 and ML10 within a session."""
    def build():
        tr, _ = _split(spark, sf_dir)
        return inner_selection(spark, tr)
    return fx.shared(spark, sf_dir, "inner_selection_scores", build)


@query("ml10_inner_selection")
def ml10_inner_selection(spark, sf_dir):
    """ML10: mean inner AUC per candidate feature count."""
    scores = _inner_scores(spark, sf_dir)
    return finish(scores.groupBy("m").agg(F.avg("auc").alias("mean_auc"),
                                          F.stddev_pop("auc").alias("sd_auc")))


@query("ml09_denoise_select")
def ml09_denoise_select(spark, sf_dir):
    """ML9: denoised selection on the training rows: order, noise edge,
    signal count and the chosen feature count."""
    tr, _ = _split(spark, sf_dir)
    sel = dn.denoise_fit(tr)
    best = dn.best_size(_inner_scores(spark, sf_dir)).first()
    m = int(best["m_opt"])
    rows = [(pos + 1, j, pos < m) for pos, j in enumerate(sel.order)]
    out = spark.createDataFrame(rows, "position int, j int, selected boolean")
    s = sel.spectrum
    return finish(out.withColumn("m_opt", F.lit(m)).withColumn("lambda_plus", F.lit(s.lambda_plus))
                  .withColumn("q", F.lit(s.q)).withColumn("n_signal", F.lit(len(s.values))))
