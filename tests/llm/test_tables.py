"""Licence scan, sharding, language-model scores, mixing: SQL oracles and brute force."""
import textwrap

import numpy as np
import pytest
from conftest import SF_TINY
from helpers import norm, rows_of, same_rows
from llm_cases import documents, empty_documents
from pyspark.sql import functions as F

from tessera.llm import licenses, lmscore, mixing, sharding
from tessera.llm.queries import ORACLE, QUERIES


MIT_FILE = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    res = duck(SF_TINY).execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    want = [tuple(norm(x) for x in r) for r in res.fetchall()]
    got, got_cols = rows_of(QUERIES[name](spark, SF_TINY))
    assert len(got) == len(want) and same_rows(got, got_cols, want, cols)


def test_license_spellings_and_copyright_lines(spark):
    mit = licenses.KNOWN["MIT"]
    variant = "Copyright (c) 2020 Jane Doe\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace("COPYRIGHT HOLDERS", "COPYRIGHT  OWNERS") + "\n\n"
    rows = [(1, mit), (2, variant), (3, mit + " and more"), (4, "Intro.\n  released under the MIT licence\nend"), (5, None), (6, " ")]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.license_scan(
        spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert got == {1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, ["MIT-notice"]), 5: (None, []), 6: (None, [])}


def test_licenses_do_not_depend_on_wrapping_or_title(spark):
    real = MIT_FILE
    cut = {k: v for k, v in licenses.KNOWN.items() if not k.endswith("-notice")}
    body = real.split("\n\n", 2)[2]
    rows = [("MIT", real), ("MIT", body), ("MIT", "Copyright Henry Holt\n\n" + body), ("MIT", "MIT License\n\nCopyright: Ho\nCopyright 2020 Noto\n\n" + body),
            ("MIT", "(c) Jane Doe\n" + body), ("MIT", "/*\n * Copyright (C) 2019-2020, Jane Doe. All rights\n * reserved.\n *\n"
                                              + "".join(f" * {x}\n" for x in body.splitlines()) + " */")]
    for width in (1, 10, 30, 47, 60, 72, 79, 80, 100, 10_000):
        for name, text in cut.items():
            lines = textwrap.fill(" ".join(text.split()), width, break_long_words=False, break_on_hyphens=False)
            rows += [(name, lines), (name, f"Copyright © 2021 Jane Doe\n\n{lines}"), (name, f"{licenses.TITLES[name][0]}\n\n{lines}")]
    rows += [(None, body.replace("COPYRIGHT HOLDERS", "")), (None, body.replace("(c)", "") + "\n(c) You must keep this."), (None, "Apache License\n\n" + body)]
    docs = spark.createDataFrame([(i, want, text) for i, (want, text) in enumerate(rows)], "doc_id long, want string, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == {i: want for i, (want, _) in enumerate(rows)}


def test_licenses_of_wrapped_texts_match_oracle(spark, duck):
    mit = licenses.KNOWN["MIT"]
    texts = ["MIT License\n\nCopyright (c) 2020 A\n\n" + mit, "copyright ho\n" + mit, "copyright holders of\n" + mit, "(c) A\n" + mit, mit + "\n(c) A",
             "© A\n\n" + mit, "x\n\nCopyright N\n" + mit, "Copyright", "copyright noticed\n\ncopyright hold\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duck(SF_TINY)
    con.execute("CREATE TABLE mine (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO mine VALUES (?, ?)", list(enumerate(texts)))
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM mine")
    want = {r[0]: r[1:] for r in con.execute(licenses.oracle()).fetchall()}
    got = licenses.license_scan(docs, licenses.known_licenses(spark)).collect()
    assert {r["doc_id"]: (r["digest"], r["license_id"], ",".join(r["notices"])) for r in got} == want


def test_licenses_of_awkward_rows(spark):
    known = licenses.known_licenses(spark)
    assert licenses.license_scan(documents(spark), known).count() == 11
    assert licenses.license_scan(empty_documents(spark), known).count() == 0
    assert licenses.license_scan(documents(spark), known.where("false")).where("license_id is not null").count() == 0


@pytest.mark.parametrize("limit", [3_000, 40_000])
def test_shards_match_oracle_and_fit(spark, duck, limit):
    res = duck(SF_TINY).execute(sharding.oracle(limit))
    cols = [d[0] for d in res.description]
    want = [tuple(norm(x) for x in r) for r in res.fetchall()]
    df = sharding.assign_shards(spark.read.parquet(f"{SF_TINY}/documents.parquet"), limit)
    got, got_cols = rows_of(df)
    assert same_rows(got, got_cols, want, cols)
    assert all(r["shard_bytes"] <= limit or r["shard_rows"] == 1 for r in df.collect())


def test_shards_of_a_hot_key_use_overflow_pages(spark, tmp_path):
    rows = [(7, "x" * 100)] * 400 + [(i, "y" * 50) for i in range(100, 300)] + [(None, None), (None, "z" * 30), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.assign_shards(docs, 1_000).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 1_000 for v in sizes.values())
    assert all(r["shard_bytes"] == sum(sizes[r["shard"]]) and r["shard_rows"] == len(sizes[r["shard"]]) for r in out)
    assert sharding.assign_shards(documents(spark), 10**9).select("shard").distinct().collect()[0]["shard"] == "b"
    assert sharding.assign_shards(empty_documents(spark), 1000).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 40) for i in range(60)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).where("n > 500").isEmpty()


def test_model_parts_give_the_same_scores(spark):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").limit(60)
    target = docs.where("doc_id % 3 = 0").select("doc_id")

    def scored(**how):
        return {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, target, **how).collect()}
    one, many = scored(), scored(part_rows=500)
    assert one.keys() == many.keys()
    for k in one:
        assert one[k]["n_tokens"] == many[k]["n_tokens"]
        assert one[k]["score"] == pytest.approx(many[k]["score"], abs=1e-9)


def test_scores_of_awkward_rows(spark):
    docs = documents(spark)
    got = lmscore.cross_entropy_difference(docs, docs.where("lang = 'fr'").select("doc_id")).collect()
    assert len(got) == 11
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["n_tokens"] == 0 and by_id[2]["score"] is None and by_id[3]["score"] is None
    assert by_id[8]["score"] < by_id[1]["score"]
    assert by_id[5]["n_tokens"] == 170_000
    untargeted = lmscore.cross_entropy_difference(docs, docs.where("false").select("doc_id")).where("doc_id = 1").first()
    assert untargeted["loss_target"] > untargeted["loss_all"]
    assert lmscore.cross_entropy_difference(empty_documents(spark), docs.select("doc_id")).count() == 0


def test_projected_gradient_reaches_the_least_squares_optimum(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 60)
    c = rng.random(60)
    c /= c.sum()
    wanted, anchor = np.array([0.6, 0.3, 0.1]), 1e-2
    totals = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(p, c)], "p array<double>, c double")
    residuals = mixing.fit_rates(totals, wanted, anchor, float("inf"), 40)
    rate, _ = mixing._replay(p, residuals, anchor, np.inf)

    def objective(r):
        return 0.5 * (((c * r) @ p - wanted) ** 2).sum() + anchor / 2 * (c * (r - 1) ** 2).sum()
    plain = np.ones(60)
    for _ in range(20_000):
        plain = np.maximum(0, plain - (p @ ((c * plain) @ p - wanted) + anchor * (plain - 1)) / (1 + anchor))
    assert rate.min() >= 0
    assert objective(rate) == pytest.approx(objective(plain), rel=2e-3)


def test_mixed_totals_meet_the_targets(spark):
    out = QUERIES["op10_source_mixing"](spark, SF_TINY).toPandas()
    names = ["high", "low", "toxic"]
    shares = np.array([(out["n_tokens"] * out["rate"] * out[f"p_{d}"]).sum() for d in names]) / out["n_tokens"].sum()
    start = np.array([(out["n_tokens"] * out[f"p_{d}"]).sum() for d in names]) / out["n_tokens"].sum()
    wanted = np.array([0.75, 0.23, 0.02])
    assert out["rate"].min() >= 0
    assert np.abs(shares - wanted).max() < 0.02 < np.abs(start - wanted).max()
    assert ((out["copies"] == np.floor(out["rate"])) | (out["copies"] == np.floor(out["rate"]) + 1)).all()


def test_mixing_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, "a"), (6, "a"), (8, "b"), (8, "c"), (99, "b")], "doc_id long, domain string")
    out = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}, iterations=5).collect()
    assert len(out) == 11 and set(out[0].asDict()) == {*docs.columns, "_mix"}
    assert all(r["_mix"]["rate"] >= 0 and len(r["_mix"]["posterior"]) == 2 for r in out)
    alone = mixing.mix(docs, labels.where("domain = 'a'"), {"a": 0.5, "b": 0.5}, iterations=3).collect()
    assert all(r["_mix"]["posterior"] == [1.0, 0.0] for r in alone)
    none = mixing.mix(empty_documents(spark), labels, {"a": 0.5, "b": 0.5}, iterations=3)
    assert none.count() == 0
