"""Missing scores, NULL groups and order columns of any type in ranks, cutoffs, vetoes and matched precision."""
import math

import pytest

from tessera.operators import evaluate, rank, screen, similar

NAN = float("nan")


def test_ranks_of_missing_scores_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, NAN), ("a", 3, 0.9), (None, 4, 0.1), (None, 5, 0.2), (None, 6, None)],
                               "g string, id long, s double")
    got = {r["id"]: r["place"] for r in screen.positions(df, "s", "id", "place", ["g"]).collect()}
    assert got == {1: 2, 2: None, 3: 1, 4: 2, 5: 1, 6: None}


@pytest.mark.parametrize("kind,values", [("string", ["b", "a", "c", "b"]), ("long", [-2**63, 5, 2**63 - 1, 5]), ("date", None)])
def test_descending_ranks_of_any_type(spark, kind, values):
    from datetime import date
    values = values or [date(2020, 1, 1), date(2021, 1, 1), date(1999, 1, 1), date(2021, 1, 1)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id long, s {kind}")
    got = {r["id"]: r["place"] for r in screen.positions(df, "s", "id", "place").collect()}
    order = sorted(range(len(values)), key=lambda k: k)
    order.sort(key=lambda k: values[k], reverse=True)
    assert got == {k: i + 1 for i, k in enumerate(order)}


def test_a_missing_score_is_no_candidate(spark):
    df = spark.createDataFrame([(1, NAN, "x"), (2, 0.8, "y"), (3, None, "z"), (4, 0.9, "seen")], "id long, s double, key string")
    seen = spark.createDataFrame([("seen",)], "key string")
    assert [r["id"] for r in screen.top_candidates(df, "s", "id", seen, "key", 0.7, 5).collect()] == [2]


def test_veto_counts_rows_with_both_scores(spark):
    df = spark.createDataFrame([(0, 0.9, NAN), (0, 0.9, 0.9), (1, 0.9, None), (1, 0.8, 0.1), (0, 0.2, 0.1)], "y int, a double, b double")
    r = evaluate.veto_effect(df, "a", "b", "y", []).first()
    assert (r["fpr_before"], r["fpr_after"], r["fpr_reduction_pct"], r["tp_lost"]) == (0.5, 0.5, 0.0, 1)


def test_matched_precision_of_null_and_small_groups(spark):
    rows = [(None, 1, 1, 0.9), (None, 2, 0, 0.8), (None, 3, 1, 0.8), ("b", 4, 1, 0.5), ("b", 5, 0, NAN), ("c", 6, 1, None)]
    df = spark.createDataFrame(rows, "g string, id long, y int, p double")
    n = spark.createDataFrame([(None, 2), ("b", 5), ("c", 1)], "g string, n_top long")
    got = {r["g"]: (r["pos_top"], r["matched_precision"]) for r in evaluate.top_n_positives(df, "p", "y", "id", n, ["g"]).collect()}
    assert got == {None: (1, 0.5), "b": (1, 1.0), "c": (None, None)}


def test_a_missing_distance_has_no_domain(spark):
    df = spark.createDataFrame([(0.5, 1.0), (None, 1.0), (NAN, 1.0), (0.5, None)], "d double, t double")
    got = [r[0] for r in df.select(similar.ad_kernel("d", "t")).collect()]
    assert got == [pytest.approx(math.exp(-0.25)), None, None, None]


def test_prefix_sums_descend_within_groups(spark):
    df = spark.createDataFrame([("a", v, k, 1) for k, v in enumerate([3.0, 1.0, 3.0, 2.0])], "g string, v double, k long, n long")
    got = {r["k"]: r["cum_n"] for r in rank.prefix_sums(df, ["g"], ["n"], descending=True, tiebreak=["k"]).collect()}
    assert got == {0: 0, 2: 1, 3: 2, 1: 3}
