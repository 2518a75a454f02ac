"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a key's hash (48 bits of MD5).
It starts with one bucket; a bucket whose rows exceed the byte limit splits on
one more bit, others stay, until every shard fits.  A shard is named by its bits.

The splits are found on totals, not on rows: per round the rows of the open
buckets are summed by some more leading bits, and a row's shard is the first
prefix that fits.  Rows that share all 48 bits (a hot key) cannot split on;
they go to overflow pages, filled in the order of each input partition.

Defined cases: a null key hashes as the empty string; null text has 0 bytes; a
shard of a single row may exceed the limit (a row is not cut); repeated rows
hash alike and use overflow pages when they exceed the limit together; an empty
table has no shard.  Only sizes and hashes are shuffled, never texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import drop_shared, write_shared

HASH_BITS = 48
#: Leading bits that a round adds to the open buckets.
ROUND_BITS = 8


def key_hash(key: Column) -> Column:
    """The first 48 bits of the MD5 of the key's text form."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _bits(prefix: Column, depth: Column) -> Column:
    """``b`` and the prefix as 0s and 1s (a folder name that reads back as text)."""
    return F.concat(F.lit("b"), F.right(F.lpad(F.bin(prefix), HASH_BITS, "0"), depth))


def _settle(cells: DataFrame, bits: int, first: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_rows): the first prefix of each cell,
    of ``first`` to ``bits`` bits, that fits; depth null where none does."""
    depths = F.explode(F.sequence(F.lit(first), F.lit(bits))).alias("depth")
    each = cells.select("cell", "bytes", "rows", depths).withColumn(
        "prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    best = each.join(fits, ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("b"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "b.depth", "b.shard_bytes", "b.shard_rows")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows that share all hash bits, per input partition."""
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        page: dict[int, list[int]] = {}  # hash -> [page number, bytes in it]; one entry per hot key
        for pdf in batches:
            names = []
            for h, size in zip(pdf["h"], pdf["n_bytes"]):
                now = page.setdefault(h, [0, 0])
                if now[1] and now[1] + size > limit:
                    now[0], now[1] = now[0] + 1, 0
                now[1] += size
                names.append(f"b{h:048b}.{part}.{now[0]}")
            yield pdf[["doc_id", "n_bytes"]].assign(shard=names, depth=HASH_BITS)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    paged = write_shared(rows.select("doc_id", "n_bytes", "h").mapInPandas(
        fill, f"doc_id {id_type}, n_bytes long, shard string, depth int"), "pages")
    totals = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return paged.join(totals, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def assign_shards(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows."""
    rows = write_shared(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        key_hash(F.col(doc_id)).alias("h")), "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, first = [], 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + 3)
    open_rows = rows
    while True:
        cell = F.expr(f"shiftright(h, {HASH_BITS - bits})")
        cells = write_shared(open_rows.groupBy(cell.alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")), "cells")
        settled = write_shared(_settle(cells, bits, first, limit), "directory")
        keyed = open_rows.withColumn("cell", cell).join(settled, "cell")
        prefix = F.expr(f"shiftright(cell, {bits} - depth)")
        done.append(keyed.where("depth is not null").select(
            "doc_id", "n_bytes", _bits(prefix, F.col("depth")).alias("shard"), "depth", "shard_bytes", "shard_rows"))
        drop_shared(cells)
        if settled.where("depth is null").isEmpty():
            break
        open_rows = write_shared(keyed.where("depth is null").select("doc_id", "n_bytes", "h"), "open")
        if bits == HASH_BITS:
            done.append(_pages(open_rows, limit))
            break
        first, bits = bits + 1, min(HASH_BITS, bits + ROUND_BITS)
    return reduce(DataFrame.union, done)


def write_shards(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as one folder per shard (``shard=...``) and returns the
    assignment.  The key must be unique here: rows are matched to shards by it."""
    shards = write_shared(assign_shards(docs, limit, doc_id, text), "shards")
    named = shards.select(F.col("doc_id").alias("_key"), "shard")
    (docs.join(named, docs[doc_id].eqNullSafe(named["_key"])).drop("_key")
     .repartition("shard").write.partitionBy("shard").parquet(path))
    return shards


def oracle(limit: int) -> str:
    """The same result in DuckDB SQL over ``documents`` (keys that fit a shard)."""
    return f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h FROM documents),
d AS (SELECT unnest(generate_series(0, {HASH_BITS})) AS depth),
s AS (SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
      FROM r, d GROUP BY ALL),
f AS (SELECT r.doc_id, r.n_bytes, r.h, min(depth) AS depth FROM r, d JOIN s USING (depth)
      WHERE s.prefix = r.h >> ({HASH_BITS} - s.depth) AND (shard_bytes <= {limit} OR shard_rows = 1) GROUP BY ALL)
SELECT f.doc_id, CAST(f.n_bytes AS BIGINT) AS n_bytes,
       'b' || right(lpad(bin(s.prefix), {HASH_BITS}, '0'), CAST(f.depth AS INTEGER)) AS shard,
       CAST(f.depth AS INTEGER) AS depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, s.shard_rows
FROM f JOIN s ON s.depth = f.depth AND s.prefix = f.h >> ({HASH_BITS} - f.depth)"""
