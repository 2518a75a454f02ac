"""Metrics of one ranked scan equal those of the single operators, and plain formulas."""
import random

import pytest

from tessera.operators import evaluate as ev
from tessera.operators import rank

NAN = float("nan")


def frame(spark):
    rng = random.Random(11)
    rows = [(g, rng.randint(0, 1), rng.choice([0.0, 0.1, 0.3, 0.5, 0.5, 0.7, 0.95, 1.0])) for g in ("a", "b", None) for _ in range(60)]
    rows += [("a", 1, NAN), ("a", None, 0.4), ("b", 0, None), ("only", 1, 0.6), ("only", 1, 0.2), ("none", 0, 0.6)]
    return spark.createDataFrame(rows, "g string, y int, p double")


def by(df, *columns):
    return {r["g"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_one_scan_equals_the_single_operators(spark):
    df = frame(spark)
    got = {r["g"]: r for r in ev.threshold_metrics(df, "p", "y", ["g"], 0.5).collect()}
    auc, ap = by(rank.rank_sum_test(df, "p", "y", ["g"]), "n_pos", "n_neg", "auc"), by(rank.average_precision(df, "p", "y", ["g"]), "average_precision")
    f1 = by(ev.f1_optimal(df, "p", "y", ["g"]), "f1_opt", "threshold_f1_opt")
    known = df.where("p IS NOT NULL AND NOT isnan(p) AND y IS NOT NULL")
    conf = by(ev.confusion(known, "p", "y", ["g"], 0.5), "tp", "fp", "tn", "fn")
    assert set(got) == {"a", "b", None, "only", "none"}
    for g, r in got.items():
        assert (r["n_pos"], r["n_neg"]) == auc[g][:2] and r["auc"] == pytest.approx(auc[g][2])
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == conf[g]
        assert r["average_precision"] == (pytest.approx(ap[g][0]) if g in ap else None)
        assert (r["f1_opt"], r["threshold_f1_opt"]) == pytest.approx(f1[g])


def test_confidence_metrics_equal_plain_formulas(spark):
    import math
    df = frame(spark)
    rows = [(r["y"], min(max(r["p"], 1e-7), 1 - 1e-7)) for r in df.collect() if r["g"] == "a" and r["y"] is not None and r["p"] == r["p"] and r["p"] is not None]
    got = {r["g"]: r for r in ev.confidence_metrics(df, "p", "y", ["g"]).collect()}["a"]
    n = len(rows)
    assert got["brier"] == pytest.approx(sum((p - y) ** 2 for y, p in rows) / n)
    assert got["log_loss"] == pytest.approx(-sum(math.log(p if y else 1 - p) for y, p in rows) / n)
    assert got["base_rate"] == pytest.approx(sum(y for y, _ in rows) / n)
    high = [y for y, p in rows if p >= 0.7]
    assert got["precision_at_0_7"] == pytest.approx(sum(high) / len(high)) and got["coverage_at_0_7"] == pytest.approx(len(high) / n)
    mean = sum(p for _, p in rows) / n
    assert got["sharpness_std"] == pytest.approx(math.sqrt(sum((p - mean) ** 2 for _, p in rows) / n))
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    assert got["auc"] == pytest.approx(wins / (sum(y for y, _ in rows) * (n - sum(y for y, _ in rows))))


def test_one_class_has_no_auc(spark):
    got = {r["g"]: r for r in ev.confidence_metrics(frame(spark), "p", "y", ["g"]).collect()}
    assert got["only"]["auc"] is None and got["none"]["auc"] is None and got["only"]["base_rate"] == 1.0
    assert ev.threshold_metrics(frame(spark).where("g = 'zz'"), "p", "y", ["g"]).collect() == []
