"""Sharding by jump consistent hashing (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

SHARDS = 40
#: Slices of a shard that are numbered apart, so that no task sorts a whole shard.
SLICES = 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all rows at once.

    A key's bucket sequence is drawn from its own linear congruential stream; adding a
    shard moves only the keys whose next jump lands on it.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        k = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        key[going] = k
        jump = ((at[going] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = jump < shards
        going = going[inside]
        at[going] = jump[inside]
    return at


def shard_column(key: Column, *shards: int) -> Column:
    """A struct of the shards s0, s1, ... of an integer key column for each number of shards; a null key counts as 0."""

    @F.pandas_udf(", ".join(f"s{k} int" for k in range(len(shards))))
    def jump(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keys = x.to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame({f"s{k}": jump_hash(keys, n).astype(np.int32) for k, n in enumerate(shards)})

    return jump(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row, by the law `key`.

    Result: doc_id, size (UTF-8 bytes of the text + 16; a null text has none),
    text_crc32, law, shard, slot, grown_shard (with one more shard). Only id and
    shard count decide the shard, so rows with one id, repeated or not, share a shard,
    and appending a shard moves rows only into it. Slots are gapless from 0 in
    each shard; ties in the id are ordered by checksum and size. A null id counts as key
    0; an empty table gives an empty result; further columns are ignored.

    Slots come from counts per (shard, slice) and a rank inside the slice: the
    texts are not shuffled, and a slice is a small part of a shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select(
        "*", shard_column(F.col("doc_id"), shards, shards + 1).alias("at"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLICES)).cast("int").alias("slice"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("at.s0").alias("shard"), F.col("at.s1").alias("grown_shard"), "slice")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x SLICES rows: a size fixed by the arguments.
    starts = rows.groupBy("shard", "slice").count().select(
        "shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "law", "shard",
                (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"))
