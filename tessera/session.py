"""Spark session helpers.

Library code never creates a session; it receives one.  ``local_session`` is
for tests, the bench and the smoke entry only.  Cluster jobs bring their own
session, and ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale as much as locally: AQE re-plans joins from
# runtime sizes (broadcast only when the measured side is small), coalesces
# tiny shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "tessera") -> SparkSession:
    """A ``local[N]`` session for tests and benchmarks (UI off, no servers)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
               .config("spark.default.parallelism", str(cpus)))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def share(spark: SparkSession, value):
    """Ship a bounded driver-side value to the tasks: a broadcast variable on a
    classic session; captured in the task closure where no SparkContext is
    reachable (Spark Connect).  Returns a zero-argument getter."""
    try:
        bc = spark.sparkContext.broadcast(value)
        return lambda: bc.value
    except Exception:  # noqa: BLE001 - no JVM SparkContext behind this session
        return lambda: value


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only for
    ``local`` masters.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; when a cluster session has none, this raises, because a machine-local
    folder would not be seen by the other executors.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext is reachable from this session
        if conf_dir:
            return conf_dir
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
    conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(path)
    return path


#: Bytes of one Arrow batch between Spark and its Python workers.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes: rows differ in size by orders
    of magnitude (long texts, packed tiles), and a worker holds a batch several
    times over.  A smaller bound that is already set is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg") or -1) * scale
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage of iterative plans: a lost executor costs nothing that is
    already written.  Give the frame to ``drop_shared`` once nothing reads it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _SHARED[id(out)] = (out, path)
    return out


_SHARED: dict[int, tuple[DataFrame, str]] = {}


def drop_shared(*frames: DataFrame) -> None:
    """Delete tables of ``write_shared`` that later steps no longer read."""
    for df in frames:
        _, path = _SHARED.pop(id(df), (None, None))
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_PERSISTED: list[DataFrame] = []


def retain(df: DataFrame) -> DataFrame:
    """Persist an intermediate reused by several jobs (memory, spilling to
    disk; recomputed from lineage if an executor is lost) and remember it so
    a long-running application can drop it with ``release()``."""
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(df)
    return df


def release() -> int:
    """Unpersist every intermediate kept by tessera and delete its shared tables;
    returns how many.  Call between independent queries of a long-lived session,
    once their results have been read."""
    n = len(_SHARED)
    drop_shared(*[df for df, _ in _SHARED.values()])
    while _PERSISTED:
        _PERSISTED.pop().unpersist(blocking=False)
        n += 1
    return n
