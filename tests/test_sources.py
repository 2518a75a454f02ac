"""Scans and sinks on small files written by the test (F-FILES)."""
import hashlib
import json
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import scans, sinks


def test_aliased_scan_skips_bad_keys(spark):
    df = spark.createDataFrame([("0012", 0.2, 0.9), (" 13 ", 0.4, None), ("x1", 0.5, 0.5)],
                               "compound string, dmpnn double, prob double")
    out = scans.resolve_aliases(df).orderBy("id").collect()
    assert [r["id"] for r in out] == [12, 13]
    assert out[0]["proba_hgb"] is None and out[0]["proba_dmpnn"] == 0.2


def test_aliased_scan_without_scores_is_none(spark):
    assert scans.resolve_aliases(spark.createDataFrame([("1",)], "id string")) is None


def test_endpoint_scan_requires_columns(spark):
    df = spark.createDataFrame([("a", "1.5"), ("", "2"), ("b", "oops"), (None, "3")], "smiles string, y string")
    clean, counts = scans.endpoint_scan(df, "smiles", "y")
    c = counts.first()
    assert (c["n_total"], c["n_bad"]) == (4, 3) and clean.count() == 1
    with pytest.raises(ValueError):
        scans.endpoint_scan(df, "smiles", "missing")


def test_json_directory_scan_flags_malformed(spark):
    d = tempfile.mkdtemp(prefix="tessera-json-")
    with open(os.path.join(d, "good.json"), "w") as f:
        json.dump({"metric": "auc", "value": 0.9}, f)
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("{not json")
    df = scans.json_directory_scan(spark, d, "metric string, value double, _corrupt_record string")
    rows = {r["stem"]: r for r in df.collect()}
    assert rows["good"]["value"] == 0.9 and rows["bad"]["_corrupt_record"] is not None


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "k int, v double")
    assert scans.nan_to_null(df).where(F.col("v").isNull()).count() == 2


def test_manifest_verify_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tessera-art-")
    for name, body in [("a.txt", b"alpha"), ("b.txt", b"beta")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(body)
    first = sinks.manifest(spark, f"{d}/*.txt")
    m = spark.createDataFrame(first.collect(), first.schema)  # the stored manifest
    assert sinks.verify_manifest(m, m).where("status <> 'ok'").count() == 0
    with open(os.path.join(d, "b.txt"), "wb") as f:
        f.write(b"changed")
    st = {r["file"]: r["status"] for r in sinks.verify_manifest(sinks.manifest(spark, f"{d}/*.txt"), m).collect()}
    assert st == {"a.txt": "ok", "b.txt": "changed"}


def test_json_summary_and_preview(spark):
    d = tempfile.mkdtemp(prefix="tessera-sum-")
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    sinks.write_json_summary(df.limit(3), os.path.join(d, "summary"))
    assert spark.read.json(os.path.join(d, "summary")).count() == 3
    p = sinks.preview(df, [F.col("v").desc()], 5).collect()
    assert len(p) == 5 and p[0]["total_rows"] == 50 and p[0]["is_preview"]


def test_registry_partition_pruning(spark):
    from tessera.session import ensure_checkpoint_dir
    d = os.path.join(ensure_checkpoint_dir(spark), "reg-test")
    reg = spark.createDataFrame([("s1", "train", 1, 0), ("s1", "test", 2, 1), ("s2", "train", 3, 1)],
                                "split_id string, set string, id int, y int")
    sinks.write_table(reg, d, partition_by=["split_id"])
    r = scans.split_registry_scan(spark, d, "s1")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and r.count() == 2


def test_manifest_streams_large_files(spark, tmp_path):
    import hashlib
    held = {"a b%20.bin": b"x" * 3000, "c.bin": bytes(range(256)) * 20, "d.bin": b"small"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    longest = "spark.sql.sources.binaryFile.maxLength"  # 2 GB unless set: more does not fit in a cell
    spark.conf.set(longest, 1000)
    try:
        got = sorted(map(tuple, sinks.manifest(spark, f"{tmp_path}/*.bin", cell_bytes=1000).collect()))
    finally:
        spark.conf.unset(longest)
    assert got == sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in held.items())


def test_block_manifest_names_changed_blocks(spark):
    d = tempfile.mkdtemp(prefix="tessera-blocks-")
    body = {"big.bin": bytes(range(256)) * 40, "small.bin": b"abc", "none.bin": b"", "gone.bin": b"x" * 100}
    for name, data in body.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    ranges = sinks.block_manifest(spark, f"{d}/*.bin", block_bytes=1000, cell_bytes=50)
    cells = sinks.block_manifest(spark, f"{d}/*.bin", block_bytes=1000)
    key = lambda r: (r["file"], r["size"], r["block"], r["sha256"])
    want = sorted((n, len(b), k, hashlib.sha256(b[k * 1000:(k + 1) * 1000]).hexdigest())
                  for n, b in body.items() for k in range(max(1, -(-len(b) // 1000))))
    assert sorted(map(key, ranges.collect())) == sorted(map(key, cells.collect())) == want
    stored = spark.createDataFrame(cells.collect(), cells.schema)
    roots = {r["file"]: (r["n_blocks"], r["root"]) for r in sinks.root_digests(stored).collect()}
    assert roots["big.bin"] == (11, hashlib.sha256("".join(w[3] for w in want if w[0] == "big.bin").encode()).hexdigest())
    with open(os.path.join(d, "big.bin"), "r+b") as f:
        f.seek(3500)
        f.write(b"!!")
        f.seek(0, 2)
        f.write(b"tail" * 300)
    os.replace(os.path.join(d, "gone.bin"), os.path.join(d, "new.bin"))
    got = {r["file"]: (r["status"], list(r["changed"])) for r in sinks.verify_blocks(
        sinks.block_manifest(spark, f"{d}/*.bin", block_bytes=1000), stored).collect()}
    assert got == {"big.bin": ("changed", [3, 10, 11]), "small.bin": ("ok", []), "none.bin": ("ok", []),
                   "gone.bin": ("missing", [0]), "new.bin": ("extra", [0])}


def test_small_blocks_of_one_file_take_linear_time(spark):
    d = tempfile.mkdtemp(prefix="tessera-blocks-")
    data = random.Random(3).randbytes(48 << 20)
    with open(os.path.join(d, "one.bin"), "wb") as f:
        f.write(data)
    want = {k: hashlib.sha256(data[k * 4096:(k + 1) * 4096]).hexdigest() for k in range(len(data) // 4096)}
    for cell in (sinks.CELL_BYTES, 1 << 20):
        start = time.monotonic()
        got = {r["block"]: r["sha256"] for r in sinks.block_manifest(spark, f"{d}/*.bin", block_bytes=4096, cell_bytes=cell).collect()}
        assert got == want
        assert time.monotonic() - start < 30  # a copy of the file per block: 590 GB


def test_quarantine_of_whole_files(spark):
    d = tempfile.mkdtemp(prefix="tessera-quarantine-")
    files = {"a/m1.json": '{"metric": "auc",\n "value": 0.9}', "b/m1.json": '{"metric": "auc", "value": 0.1}', "a/m2.json": "{not json",
             "a/m3.json": "", "a/m4.json": '{"value": 2}', "a/m5.json": " \n ", "b/m6.json": '{"metric": "f1", "value": 1.0}'}
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    good, bad = scans.quarantine_scan(spark, d, "metric string, value double", whole_files=True, required=["metric"])
    assert sorted((r["stem"], r["metric"], r["value"]) for r in good.collect()) == [("m1", "auc", 0.9), ("m6", "f1", 1.0)]
    got = {r["path"][-9:]: (r["reason"], r["raw"]) for r in bad.collect()}
    assert got == {k: (v, files[k]) for k, v in {"b/m1.json": "duplicate stem", "a/m2.json": "malformed", "a/m3.json": "empty",
                                                 "a/m4.json": "missing metric", "a/m5.json": "empty"}.items()}


def test_quarantine_of_csv_lines(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("1,2.5\n\n2,oops\n3,\n4,1.0\n")
    good, bad = scans.quarantine_scan(spark, d, "id int, y double", fmt="csv", required=["y"])
    assert sorted((r["id"], r["y"]) for r in good.collect()) == [(1, 2.5), (4, 1.0)]
    assert sorted((r["reason"], r["raw"]) for r in bad.collect()) == [("empty", ""), ("malformed", "2,oops"), ("missing y", "3,")]
