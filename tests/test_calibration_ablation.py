"""The calibration ablation stores its predictions once and fits small splits in few partitions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import denoise as dn
from tessera.operators import learn as ln
from tessera.plans import learning
from tessera.session import release


def _rows(spark, folder, n=400):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0.3 * (i % 10 < 5), 1.0) for _ in range(64)], i % 10) for i in range(n)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(8).write.parquet(f"{folder}/embeddings.parquet")


def test_metrics_read_stored_predictions(spark, tmp_path, monkeypatch):
    _rows(spark, tmp_path)
    parts, plans = [], []
    metrics = learning.ev.confidence_metrics

    def fit(tr, te):
        parts.extend([tr.rdd.getNumPartitions(), te.rdd.getNumPartitions()])
        return te.select("id", "y", (1.0 / (1.0 + F.exp(-F.element_at(learning.vector_to_array("features"), 1)))).alias("p"))

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return metrics(df, *args)
    monkeypatch.setattr(learning, "_gbt", fit)
    monkeypatch.setattr(learning, "chosen_size", lambda spark, rows: 3)
    monkeypatch.setattr(learning.ev, "confidence_metrics", seen)
    rows = learning.calibration_ablation(spark, str(tmp_path), 2).collect()
    release()
    assert len(parts) == 2 * 6 * 3 and set(parts) == {1}
    assert len(plans) == 1 and "Union" not in plans[0] and "InMemoryRelation" not in plans[0]
    got = {(r["scheme"], r["rung"], r["metric"]): r for r in rows}
    assert {s for s, *_ in got} == {"random", "grouped"} and {r for _, r, _ in got} == {v for v, _ in learning.RUNGS} | {"veto_block"}
    assert got["random", "structure", "auc"]["n_splits"] == 2 and got["grouped", "structure", "auc"]["n_splits"] == 1
    # one rung's first feature scores all that hold the structure block alike
    assert got["random", "+wide", "auc"]["delta"] == 0.0 and got["random", "structure", "auc"]["mean"] == got["random", "veto_block", "auc_structure"]["mean"]


def test_registered_query_runs_the_whole_protocol(spark, tmp_path, monkeypatch):
    _rows(spark, tmp_path, 100)
    seen, splits = [], learning._registry_splits

    class Seen(Exception):
        pass

    def registry(*args):
        _, reg = splits(*args)
        seen.extend(sorted(r[0] for r in reg.select("split_id").distinct().collect()))
        raise Seen
    monkeypatch.setattr(learning, "_registry_splits", registry)
    with pytest.raises(Seen):
        learning.ml07_calibration_ablation(spark, str(tmp_path))
    assert seen == ["grouped_00"] + [f"random_{k:02d}" for k in range(10)]


def test_denoise_fits_share_passes(spark, monkeypatch):
    seen, spectrum = [], dn.signal_spectrum
    monkeypatch.setattr(dn, "signal_spectrum", lambda rows, *a: (seen.append(rows.rdd.getNumPartitions()), spectrum(rows, *a))[1])
    rnd = random.Random(6)
    rows = [([rnd.gauss(i % 2, 1.0) if i % 9 else None, rnd.gauss(0, 1.0), 1.0, float(i)], i % 2, [1, int(i % 3 > 0)]) for i in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, y int, sets array<int>").repartition(8)
    both = dn.denoise_fits(df, 2)
    each = [dn.denoise_fit(df.where(F.col("sets")[k] == 1)) for k in range(2)]
    assert seen == [1] * 4 and [b.n_rows for b in both] == [200, 133]
    for k, (a, b) in enumerate(zip(both, each)):
        stats = dn.zscore_fit(df.where(F.col("sets")[k] == 1)).orderBy("j").collect()
        assert a.order == b.order and sorted(a.order) == [0, 1, 2, 3] and a.scale[2] == 1.0
        for got in (a, b):
            assert np.allclose(got.mean, [r["mean"] for r in stats], rtol=1e-12) and np.allclose(got.scale, [r["scale"] for r in stats], rtol=1e-12)
        assert np.allclose(a.spectrum.prior, b.spectrum.prior, rtol=1e-9)


def test_wide_rows_keep_their_partitions(spark):
    df = spark.range(0, 4096, 1, 8)
    assert [ln.in_few(df, 4096, p).rdd.getNumPartitions() for p in (26, 64, 130, 6400)] == [1, 1, 3, 8]
