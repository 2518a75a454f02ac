"""Result sinks (SK1-SK4): full table + preview, artifact manifest with
checksums, JSON summary, run provenance."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import with_scalars
from tessera.sources.tables import empty_files


def preview(df: DataFrame, order: Sequence, k: int = 20) -> DataFrame:
    """SK1: the first k rows by ``order`` (distributed top-k) flagged as a
    preview, with the total row count of the full table."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    top = df.orderBy(*order).limit(k)
    return with_scalars(top, total).withColumn("is_preview", F.col("total_rows") > k)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """SK1: write the full result (no driver collect)."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


#: Bytes of the largest file that the manifest takes in a cell: a task holds it several times over.
FILE_BYTES = 64 << 20


def manifest(spark: SparkSession, path_glob: str, cell_bytes: int = FILE_BYTES) -> DataFrame:
    """SK2: per file name, size and SHA-256 of the content.

    Files of up to ``cell_bytes`` are hashed by the binaryFile scan; a larger one, of any
    size, is read by its task as a stream (the filter on the length keeps its content out of
    the scan).  The digest of a file is sequential: files are dealt out, not their parts."""
    b = spark.read.format("binaryFile").load(path_glob)
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1).alias("file")
    size = F.col("length").alias("size")
    small = b.where(F.col("length") <= cell_bytes).select(name, size, F.sha2(F.col("content"), 256).alias("sha256"))
    large = b.where(F.col("length") > cell_bytes).select("path", name, size)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                local = re.match("file:/+(.*)", path := r.pop("path"), re.DOTALL)
                system, path = (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with system.open_input_stream(path) as f:
                    while held := f.read(BLOCK_BYTES):
                        digest.update(held)
                yield pa.RecordBatch.from_pylist([r | {"sha256": digest.hexdigest()}], schema=_FILES)

    return small.unionByName(large.mapInArrow(read, "file string, size long, sha256 string"))


_FILES = pa.schema([("file", pa.string()), ("size", pa.int64()), ("sha256", pa.string())])


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """SK2 verify: full outer join on file; status ok / changed / missing / extra."""
    a = actual.select("file", F.col("size").alias("size_actual"), F.col("sha256").alias("sha_actual"))
    e = expected.select("file", F.col("size").alias("size_expected"), F.col("sha256").alias("sha_expected"))
    j = e.join(a, "file", "full_outer")
    status = (F.when(F.col("sha_actual").isNull(), "missing")
              .when(F.col("sha_expected").isNull(), "extra")
              .when((F.col("sha_actual") == F.col("sha_expected"))
                    & (F.col("size_actual") == F.col("size_expected")), "ok")
              .otherwise("changed"))
    return j.withColumn("status", status)


#: Bytes of a block, and of the largest file whose content passes through a cell.
BLOCK_BYTES, CELL_BYTES = 8 << 20, 256 << 20


def block_manifest(spark: SparkSession, path_glob: str, block_bytes: int = BLOCK_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """SK2 for files of any size: (file, size, block, sha256), one row per block.

    Files of up to ``cell_bytes`` are read by the binaryFile scan (the filter on the
    length keeps larger contents out of it) and hashed by block in the JVM; the
    blocks of a larger file are dealt out over the tasks in ranges, each of which is
    read once and nothing else.  The digests do not depend on the way.  An empty
    file has one block."""
    b = spark.read.format("binaryFile").load(path_glob)
    named = b.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / block_bytes).cast("int"))
    blocks = F.sequence(F.lit(0), n_blocks - 1)
    # the content as a lambda variable: as a column it is copied whole out of its row for every block
    digests = F.transform(F.array("content"), lambda c: F.transform(
        blocks, lambda k: F.sha2(c.substr((k * block_bytes + 1).cast("int"), F.lit(block_bytes)), 256)))[0]
    small = named.where(F.col("length") <= cell_bytes).select("file", F.col("length").alias("size"), F.posexplode(digests).alias("block", "sha256"))
    together = max(1, BLOCK_BYTES // block_bytes)  # blocks of one range: small ones are read together
    large = named.where(F.col("length") > cell_bytes).select(
        "path", "file", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0), n_blocks - 1, F.lit(together))).alias("block")) \
        .repartition("path", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", r.pop("path")))
                with system.open_input_file(path) as f:
                    f.seek(r["block"] * block_bytes)
                    held = memoryview(f.read(together * block_bytes))
                yield pa.RecordBatch.from_pylist([
                    r | {"block": r["block"] + k, "sha256": hashlib.sha256(held[k * block_bytes:(k + 1) * block_bytes]).hexdigest()}
                    for k in range(-(-len(held) // block_bytes))], schema=_BLOCKS)

    hollow = empty_files(b).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.lit(0).cast("long").alias("size"),
                                   F.lit(0).alias("block"), F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return small.unionByName(hollow).unionByName(large.mapInArrow(read, "file string, size long, block int, sha256 string"))


_BLOCKS = pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int32()), ("sha256", pa.string())])


def root_digests(blocks: DataFrame) -> DataFrame:
    """(file, size, n_blocks, root): root is the SHA-256 of the block digests in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "sha256"))), lambda b: b["sha256"])
    return blocks.groupBy("file", "size").agg(F.count(F.lit(1)).alias("n_blocks"), F.sha2(F.array_join(ordered, ""), 256).alias("root"))


def verify_blocks(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """SK2 verify by block: (file, status, n_blocks, changed): per file ok, changed,
    missing or extra, and the numbers of its blocks that differ, are gone or are new."""
    a = actual.select("file", "block", F.col("sha256").alias("_a"))
    e = expected.select("file", "block", F.col("sha256").alias("_e"))
    j = e.join(a, ["file", "block"], "full_outer")
    same = F.coalesce(F.col("_a") == F.col("_e"), F.lit(False))
    per = j.groupBy("file").agg(F.count("_e").alias("_n_e"), F.count("_a").alias("_n_a"), F.count(F.lit(1)).alias("n_blocks"),
                                F.sort_array(F.collect_list(F.when(~same, F.col("block")))).alias("changed"))
    status = (F.when(F.col("_n_a") == 0, "missing").when(F.col("_n_e") == 0, "extra")
              .when(F.size("changed") == 0, "ok").otherwise("changed"))
    return per.select("file", status.alias("status"), "n_blocks", "changed")


def write_json_summary(df: DataFrame, path: str) -> None:
    """SK3: nested run summary as JSON (one struct per row)."""
    df.select(F.struct(*df.columns).alias("summary")).write.mode("overwrite").json(path)


def table_checksum(df: DataFrame, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """SK4: order-insensitive checksum of a table: row count and the sum of the
    first 32 bits of each row's SHA-256 over ``col1|col2|...`` (string forms)."""
    cols = list(cols or df.columns)
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    h = F.conv(F.substring(F.sha2(row, 256), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).alias("checksum")) \
        .withColumn("input", F.lit(name))


def provenance(checksums: DataFrame, params: dict[str, str], evidence: str = "computed") -> DataFrame:
    """SK4: run parameters, input checksums and the evidence kind in one table."""
    p = F.create_map(*[x for k, v in sorted(params.items()) for x in (F.lit(k), F.lit(str(v)))])
    return checksums.withColumn("params", p).withColumn("evidence_kind", F.lit(evidence))
