"""The equi-join and the MinHash join of sets, counted by block, against all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import postings, similar


def dense(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + i, sorted(rng.sample(range(64), rng.randint(1, 40)))) for i in range(n)]


def sim(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("own", [False, True])
def test_equijoin_equals_all_pairs_without_a_row_per_position(spark, monkeypatch, own):
    monkeypatch.setattr(postings, "PACK", 7)
    monkeypatch.setattr(postings, "LEAST_BLOCK", 5)
    refs = dense(1, 90) + [(500, []), (501, None)]
    queries = refs if own else dense(2, 40, 1000) + [(2000, [9999, -3])]
    q, r = spark.createDataFrame(queries, "qid long, bits array<int>"), spark.createDataFrame(refs, "rid long, bits array<int>")
    got = similar.topk_neighbours(q, r, 4, own, strategy="equijoin")
    assert "Generate explode" not in plan(got)
    want = []
    for i, a in queries:
        best = sorted((-sim(a, b), j) for j, b in refs if a and b and set(a) & set(b) and not (own and i == j))[:4]
        want += [(i, j, round(-s, 9), k + 1) for k, (s, j) in enumerate(best)]
    assert sorted((x["qid"], x["rid"], round(x["sim"], 9), x["nn_rank"]) for x in got.collect()) == sorted(want)


def test_repeated_ids_count_as_in_the_exploded_join(spark):
    q = spark.createDataFrame([(1, [1, 2, 3]), (1, [3, 4]), (None, [1])], "qid long, bits array<int>")
    r = spark.createDataFrame([(7, [1, 2, 3, 9, 10, 11, 12]), (8, [3]), (8, [3, 5, 6, 8, 9]), (None, [1])], "rid long, bits array<int>")
    shared = q.select("qid", F.explode("bits").alias("b")).join(r.select("rid", F.explode("bits").alias("b")), "b").groupBy("qid", "rid").count()
    sized = shared.join(q.select("qid", F.size("bits").alias("nq")), "qid").join(r.select("rid", F.size("bits").alias("nr")), "rid")
    union = F.col("nq") + F.col("nr") - F.col("count")
    want = sized.select("qid", "rid", F.when(union > 0, F.col("count") / union).otherwise(0.0).alias("sim"))
    got = similar.topk_neighbours(q, r, 99, strategy="equijoin").select("qid", "rid", "sim")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 6


def test_minhash_join_keeps_the_candidates_within_the_distance(spark, monkeypatch):
    from pyspark.ml.feature import MinHashLSH

    from tessera.functions.descriptors import fingerprint_vector
    monkeypatch.setattr(postings, "LEAST_BLOCK", 5)
    q = spark.createDataFrame(dense(3, 30, 100) + dense(4, 5, 300) * 2 + [(400, None)], "qid long, bits array<int>")
    r = spark.createDataFrame(dense(4, 40) + dense(4, 2) + [(90, [])], "rid long, bits array<int>")
    got = similar.minhash_join(q, r, threshold=0.7, num_tables=2, n_bits=64)
    assert "Generate explode" not in plan(got)

    def prep(df):
        tok = spark.createDataFrame([x for x in df.collect() if x["bits"]], df.schema).withColumn("t", F.transform("bits", lambda x: x.cast("string")))
        return fingerprint_vector("t", "features", 64).transform(tok)
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=2, seed=42).fit(prep(r))
    want = [(x["datasetA"]["qid"], x["datasetB"]["rid"], round(sim(x["datasetA"]["bits"], x["datasetB"]["bits"]), 9))
            for x in model.approxSimilarityJoin(prep(q), prep(r), 0.7 + 1e-9).collect()]
    assert sorted((x["qid"], x["rid"], round(x["sim"], 9)) for x in got.collect()) == sorted(want) and len(want) > 20
