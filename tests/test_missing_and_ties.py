"""Missing scores and labels, NULL groups, one-row groups, big and text keys, ties."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.functions.stats import signed_rank_p
from tessera.operators import dose, evaluate, learn, rank, screen, similar


@pytest.mark.parametrize("buckets", [None, 1, 4])
def test_values_keep_their_type(spark, buckets):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big,), (big - 1,), (5,)], "v long")
    got = rank.average_ranks(df, "v", n_buckets=buckets)
    assert got.schema["v"].dataType.simpleString() == "bigint"
    assert {r["v"]: r["avg_rank"] for r in got.collect()} == {5: 1.0, big - 1: 2.0, big: 3.0}
    text = rank.average_ranks(spark.createDataFrame([("b",), ("a",), ("b",)], "v string"), "v", n_buckets=buckets)
    assert {r["v"]: r["avg_rank"] for r in text.collect()} == {"a": 1.0, "b": 2.5}


@pytest.mark.parametrize("buckets", [None, 4])
def test_missing_labels_values_and_groups(spark, buckets):
    rows = [("a", 0.9, 1), ("a", 0.1, 0), ("a", 0.95, None), ("a", None, 1), ("a", float("nan"), 0), (None, 0.2, 1),
            (None, 0.8, 0), ("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    auc = {r["g"]: (r["auc"], r["n_pos"], r["n_neg"], r["z"]) for r in rank.rank_sum_test(df, "p", "y", ["g"], buckets).collect()}
    assert auc["a"][:3] == (1.0, 1, 1) and auc[None][:3] == (0.0, 1, 1)
    assert auc["one"] == (None, 1, 0, None)  # no division by zero
    ap = {r["g"]: r["average_precision"] for r in rank.average_precision(df, "p", "y", ["g"], buckets).collect()}
    assert ap == {"a": 1.0, None: 0.5, "one": 1.0}
    med = {r["g"]: r["quantile"] for r in rank.exact_quantile(df, "p", ["g"], n_buckets=buckets).collect()}
    assert med == {"a": 0.9, None: 0.5, "one": 0.5}
    bh = rank.bh_adjust(spark.createDataFrame([(None, 0.01), (None, 0.04), ("x", 0.5)], "g string, p double"), "p", ["g"], buckets)
    assert {(r["g"], r["p"]): r["p_adjusted"] for r in bh.collect()} == {(None, 0.01): 0.02, (None, 0.04): 0.04, ("x", 0.5): 0.5}


def test_tied_scores_spread_over_ranges(spark):
    n = 2000
    df = spark.createDataFrame([(f"id{k:05d}", 0.5 if k % 5 else k / n) for k in range(n)], "id string, score double")
    vc = df.select("id", F.col("score").alias("v"), (-F.col("score")).alias("o")).withColumn("n", F.lit(1))
    ranges = rank.add_ranges(vc, [], "o", 8, ["id"]).groupBy(rank.BUCKET).count().collect()
    assert max(r["count"] for r in ranges) < 0.3 * n
    got = {r["id"]: r["place"] for r in screen.positions(df, "score", "id", "place").collect()}
    want = sorted(((-s, i) for i, s in df.collect()))
    assert [got[i] for _, i in want] == list(range(1, n + 1))


def test_missing_scores_are_left_out_of_calibration(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.2), ("m", 1, 0.6), ("m", 0, None), ("m", 1, float("nan")), ("m", None, 0.7)]
    df = spark.createDataFrame(rows, "model string, y int, p double")
    r = evaluate.confidence_metrics(df, "p", "y", ["model"]).first()
    assert r["brier"] == pytest.approx((0.01 + 0.04 + 0.16) / 3)
    assert r["base_rate"] == pytest.approx(2 / 3) and r["auc"] == 1.0
    assert sum(b["n_bin"] for b in evaluate.calibration_bins(df, "p", "y", ["model"]).collect()) == 3
    clipped = df.select(evaluate.clip_prob("p").alias("c"), evaluate.flag("p", 0.5).alias("f"), evaluate.bin_index("p", 10).alias("b")).collect()
    assert [c["c"] for c in clipped][3:5] == [None, None] and [c["b"] for c in clipped][3:5] == [None, None]
    assert [c["f"] for c in clipped] == [True, False, True, False, False, True]


def test_top_n_with_text_ids(spark):
    df = spark.createDataFrame([("g", f"d{k}", 0.5, int(k in (1, 3))) for k in range(8)], "grp string, id string, p double, y int")
    n = spark.createDataFrame([("g", 4)], "grp string, n_top int")
    assert evaluate.top_n_positives(df, "p", "y", "id", n, ["grp"]).first()["pos_top"] == 2


def test_signed_rank_with_ties(spark):
    d = [0.1, 0.1, 0.3, -0.5, 0.5]
    rows = [(k, "base", "auc", 0.0) for k in range(5)] + [(k, "x", "auc", v) for k, v in enumerate(d)]
    r = evaluate.paired_signed_rank(spark.createDataFrame(rows, "split int, rung string, metric string, value double"),
                                    "split", "rung", "metric", "base")
    r = r.withColumn("p", signed_rank_p("w_plus", "w_minus", "ranks")).first()
    ties = (2 ** 3 - 2) * 2
    assert (r["w_plus"], r["w_minus"], r["tie_term"]) == (10.5, 4.5, ties)
    # exact: over the 32 sign assignments of the tied ranks
    ranks = (1.5, 1.5, 3.0, 4.5, 4.5)
    sums = [sum(r for k, r in enumerate(ranks) if m >> k & 1) for m in range(32)]
    assert r["p"] == pytest.approx(2 * sum(w >= 10.5 for w in sums) / 32)


def test_linear_regressor_is_ridge_with_alpha_one(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(400)
    rows = [(k, float(3 * v + 0.1 * e), [float(v)]) for k, (v, e) in enumerate(zip(x, rng.standard_normal(400)))]
    df = spark.createDataFrame(rows, "id long, y double, x array<double>").withColumn("features", array_to_vector("x"))
    probe = spark.createDataFrame([(0, 0.0, [0.0]), (1, 0.0, [1.0])], "id long, y double, x array<double>").withColumn("features", array_to_vector("x"))
    p = {r["id"]: r["p"] for r in learn.fit_regressor(df, probe, "linear").collect()}
    y = np.array([r[1] for r in rows])
    xc, yc = x - x.mean(), y - y.mean()
    assert p[1] - p[0] == pytest.approx((xc @ yc) / (xc @ xc + 1.0), rel=1e-4)


def test_zero_molecular_weight_has_no_dose(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 100.0)], "mgkg double, mw double")
    assert [r[0] is None for r in df.select(dose.mgkg_to_neglog("mgkg", "mw")).collect()] == [True, False]


def test_neighbour_paths_agree(spark):
    rng = np.random.default_rng(6)
    def side(name, n):
        return spark.createDataFrame([(k, sorted({int(x) for x in rng.integers(0, 60_000, rng.integers(1, 40)) % 300 * 200})) for k in range(n)],
                                     f"{name} long, bits array<int>")
    q, r = side("qid", 40), side("rid", 90)
    got = [sorted((x["qid"], x["rid"], round(x["sim"], 9), x["nn_rank"]) for x in similar.topk_neighbours(
        q, r, 5, strategy=s, part=16, n_bits=60_000).collect()) for s in ("tiles", "equijoin")]
    assert got[0] == got[1]
