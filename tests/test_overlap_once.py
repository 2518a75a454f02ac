"""AG9 reads the neighbours that it is given once."""
from tessera.operators import similar


def test_overlap_summary_runs_the_search_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    schema = "qid long, sim double, nn_active boolean"
    nn = spark.createDataFrame([(i, i / 10, i % 3 == 0) for i in range(11)], schema).mapInPandas(count, schema)
    row = similar.overlap_summary(nn).first()
    assert (row["n_queries"], row["median_nn_similarity"], row["band"]) == (11, 0.5, "partially")
    assert seen.value == 11
