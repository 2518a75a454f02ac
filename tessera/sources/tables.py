"""Readers for the parquet tables a query runs on.

Every reader returns a lazy DataFrame; Catalyst prunes columns and pushes
filters into the parquet scan, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder: ``{sf_dir}/{name}.parquet``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a table up to which ``spread`` deals its rows out.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table out over the cores before row-level work on long
    texts: one row group is one task, however many cores there are.  A larger
    table has row groups for all of them and is left as it is."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no JVM plan behind this session
        return df
    return df.repartition(cores) if int(str(size)) <= SPREAD_BYTES else df


def file_uri(path: Column) -> Column:
    """One spelling of a file's URI."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def empty_files(scan: DataFrame) -> DataFrame:
    """(path) of the files of a scan that hold no byte: Spark lists them, but makes no
    split of them."""
    listed = scan.sparkSession.createDataFrame([(p,) for p in scan.inputFiles()], "path string").select(file_uri(F.col("path")).alias("path"))
    return listed.join(scan.select(file_uri(F.col("_metadata.file_path")).alias("path")).distinct(), "path", "left_anti")
