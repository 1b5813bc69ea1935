"""Sharding by jump consistent hashing of a stable key: no ring table, and a new last shard takes rows only into itself.

Defined results: a null key hashes as a key of its own kind; a null text has size 1 and the checksum of
the empty text; repeated rows land in the same shard and get slots of their own; rows that tie in the order of a
shard take its next slots in any order; a very long text counts with its whole size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key among ``shards`` (Lamping and Veach 2014), for all keys at once."""
    key = keys.astype(np.uint64, copy=True)
    at, following = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = following[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        part = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        following[live] = ((at[live] + 1) * (float(1 << 31) / part)).astype(np.int64)
        live = live[following[live] < shards]
    return at


def shard(df: DataFrame, shards: int, key_col: str = "doc_id", key_hash: str = "key_hash") -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one shard more) to every row, by the hash of its key."""
    if {"shard", "grown_shard", key_hash} & set(df.columns):
        df = df.drop("shard", "grown_shard", key_hash)
    keyed = df.withColumn(key_hash, F.xxhash64(F.col(key_col).cast("string")))
    schema = T.StructType([*keyed.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("shard", "grown_shard"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            arrays = [*batch.columns, *(pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "shard", "grown_shard"])

    return keyed.mapInArrow(run, schema)


def slotted(df: DataFrame, order: list[str], bucket_of: str = "key_hash", buckets: int = 4096) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 within each shard.

    A shard is never numbered by one task: its rows are dealt to ``buckets`` by their key hash, numbered
    inside a bucket, and raised by the rows of the buckets before. The table of bucket counts has shards
    x buckets rows at most, whatever the input.
    """
    df = df.withColumn("_bucket", F.pmod(F.hash(F.lit(7), bucket_of), F.lit(buckets)))
    counts = df.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("shard", "_bucket").orderBy(*order)
    numbered = df.withColumn("_rank", F.row_number().over(inner) - 1)
    joined = numbered.join(offsets, ["shard", "_bucket"])
    return joined.withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_before", "_rank")


def assignment(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Size, checksum, shard and slot of every document under the law ``key``."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = slotted(shard(sized, shards), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
