"""Cross-validated fits read their rows in no more partitions than there are cores, and few
rows in few."""
from pyspark.sql import functions as F

from tessera.operators import learn


def test_histograms_are_not_shuffled_per_input_partition(spark):
    cores, seen = spark.sparkContext.defaultParallelism, []
    df = spark.range(0, 400, 1, 8 * cores).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 4).alias("fold"))

    def fitter(train, test):
        seen.append(train.rdd.getNumPartitions())
        return test.select("id", "y", F.lit(0.5).alias("p"))
    out = learn.cv_predictions_many(df, "fold", {"a": fitter})
    assert out.count() == 400 and seen == [1, 1, 1, 1]


def test_large_inputs_keep_a_partition_per_core(spark, monkeypatch):
    monkeypatch.setattr(learn, "FIT_ROWS", 5)
    cores, seen = spark.sparkContext.defaultParallelism, []
    df = spark.range(0, 400, 1, 8 * cores).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 4).alias("fold"))

    def fitter(train, test):
        seen.append(train.rdd.getNumPartitions())
        return test.select("id", "y", F.lit(0.5).alias("p"))
    assert learn.cv_predictions_many(df, "fold", {"a": fitter}).count() == 400
    assert seen == [cores] * 4
