"""Leading eigenpairs by passes over the rows, against the dense matrix."""
import numpy as np
import pytest

from tessera.operators import denoise as dn
from tessera.operators import lanczos


def block(n, p, factors, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    for k in range(factors):
        x += np.outer(rng.normal(size=n), rng.normal(size=p)) * (1.0 + 0.5 * k)
    return x


def frame(spark, x, y=None):
    y = np.zeros(len(x), int) if y is None else y
    return spark.createDataFrame([(k, r.tolist(), int(c)) for k, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, y int").repartition(4)


@pytest.mark.parametrize("factors", [0, 1, 5])
def test_signal_equals_the_dense_one(spark, factors):
    x = block(400, 64, factors, factors)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / scale
    values, vectors = np.linalg.eigh(z.T @ z / (len(x) - 1))
    edge = lanczos.noise_edge(64 / 400)
    above = np.flatnonzero((values > edge) | (np.arange(64) == 63))
    s = lanczos.signal_spectrum(frame(spark, x), mean, scale, len(x), block=6)
    assert s.lambda_plus == edge and s.values == pytest.approx(values[above][::-1], abs=1e-9)
    v = vectors[:, above]
    assert s.prior == pytest.approx(np.diagonal(v @ np.diag(values[above]) @ v.T), abs=1e-8)
    assert np.abs(s.vectors @ s.vectors.T - v @ v.T).max() < 1e-8


def test_missing_values_stand_at_the_mean(spark):
    x = block(120, 10, 2, 3)
    holes = np.random.default_rng(0).random(x.shape) < 0.1
    rows = [(k, [None if h else float(v) for v, h in zip(r, hr)], k % 2) for k, (r, hr) in enumerate(zip(x, holes))]
    sel = dn.denoise_fit(spark.createDataFrame(rows, "id long, x array<double>, y int"))
    known = np.where(holes, np.nan, x)
    mean = np.nanmean(known, axis=0)
    filled = np.where(holes, mean, x)
    z = (filled - mean) / filled.std(axis=0)
    values = np.linalg.eigvalsh(z.T @ z / (len(x) - 1))[::-1]
    assert sel.spectrum.values == pytest.approx(values[:len(sel.spectrum.values)], abs=1e-9)
    assert sorted(sel.order) == list(range(10))


def test_twenty_thousand_features_without_a_square_matrix(spark):
    n, p = 60, 20_000
    x = block(n, p, 2, 5)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    s = lanczos.signal_spectrum(frame(spark, x), mean, scale, n)
    z = (x - mean) / scale
    want = np.linalg.eigvalsh(z @ z.T / (n - 1))[::-1]  # the same non-zero eigenvalues, n x n
    assert s.vectors.shape == (p, len(s.values)) and s.values == pytest.approx(want[:len(s.values)], rel=1e-9)
    assert len(s.values) == max(1, int((want > s.lambda_plus).sum()))
