"""Source mixing: the optimum at the anchor of the queries."""
import numpy as np
import pytest

from tessera.llm import mixing


@pytest.mark.parametrize("seed,mix,wanted,max_rate", [
    (1, [1, 1, 1], [0.75, 0.23, 0.02], np.inf), (2, [6, 3, 0.3], [0.75, 0.23, 0.02], np.inf), (3, [1, 5, 2], [0.80, 0.20, 0.0], 1.0),
    (4, [0.2, 0.2, 0.2], [0.75, 0.23, 0.02], np.inf), (5, [2, 8, 0.1], [0.80, 0.20, 0.0], 1.0)])
def test_rates_are_the_optimum(spark, seed, mix, wanted, max_rate):
    rng, anchor, wanted = np.random.default_rng(seed), 1e-3, np.array(wanted)
    p, c = rng.dirichlet(mix, 400), rng.random(400)
    c /= c.sum()
    totals = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(p, c)], "p array<double>, c double")
    rate, _ = mixing._replay(p, mixing.fit_rates(totals, wanted, anchor, max_rate, 200), anchor, max_rate)
    want = np.ones(400)
    for _ in range(40_000):
        want = np.clip(want - (p @ ((c * want) @ p - wanted) + anchor * (want - 1)) / (1 + anchor), 0, max_rate)

    def objective(r):
        return 0.5 * (((c * r) @ p - wanted) ** 2).sum() + anchor / 2 * (c * (r - 1) ** 2).sum()
    gradient = p @ ((c * rate) @ p - wanted) + anchor * (rate - 1)
    assert np.abs(rate - np.clip(rate - gradient, 0, max_rate)).max() < 1e-9
    assert objective(rate) == pytest.approx(objective(want), abs=1e-9)
    assert rate == pytest.approx(want, abs=1e-6)


def test_a_fit_that_does_not_end_raises(spark):
    totals = spark.createDataFrame([([0.9, 0.1], 0.5), ([0.2, 0.8], 0.5)], "p array<double>, c double")
    with pytest.raises(RuntimeError):
        mixing.fit_rates(totals, np.array([0.1, 0.9]), 1e-3, 1.0, 1)
