"""Keyed tables in hash folders: insert-only merges that can be repeated, in batches and from streams."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .scratch import exists

FOLDER = "_folder"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys; null equals null, so that a row without a key is not inserted twice either."""
    return functools.reduce(operator.and_, (left[k].eqNullSafe(right[k]) for k in keys))


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.parquet(path).drop(FOLDER)


def merge_new(df: DataFrame, path: str, keys: Sequence[str], folders: int = 16) -> int:
    """Insert the rows of df whose keys the table in `path` lacks; the number of folders that were written anew.

    MERGE ... WHEN NOT MATCHED THEN INSERT. Rows lie in `folders` folders by a hash of their keys (the number must not change while the table lives). Only folders that df's keys
    fall in are read, and only those that get a new row are written anew, by dynamic partition overwrite: the job's commit moves them into place, so a job that fails or is
    repeated changes nothing twice. Of rows of df with equal keys the least stays; null is a key like others. An empty df writes nothing.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*others)) if others else F.lit(None)
    single = df.groupBy(*keys).agg(least.alias("_rest")).select(*keys, *(F.col("_rest")[c].alias(c) for c in others)).select(*df.columns)
    fresh = single.withColumn(FOLDER, F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int"))
    if exists(spark, path):
        touched = [r[0] for r in fresh.select(FOLDER).distinct().collect()]  # at most `folders` numbers
        stored = spark.read.parquet(path).filter(F.col(FOLDER).isin(touched))
        fresh = fresh.join(stored, _same(fresh, stored, keys), "left_anti")
        grown = [r[0] for r in fresh.select(FOLDER).distinct().collect()]
        fresh = fresh.filter(F.col(FOLDER).isin(grown)).unionByName(stored.filter(F.col(FOLDER).isin(grown)))
    else:
        grown = [r[0] for r in fresh.select(FOLDER).distinct().collect()]
    if grown:
        fresh.repartition(FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path)
    return len(grown)


def keyed_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], folders: int = 16, before: Callable[[DataFrame, int], DataFrame] | None = None,
                 after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Write a stream into a keyed table, every key once whatever is replayed.

    A batch that was written but not committed to the checkpoint comes again under its number when the query is started again; merged once more, it changes nothing.
    `before` may change a batch; `after` is called when a batch is stored.
    """
    def put(batch: DataFrame, number: int) -> None:
        rows = before(batch, number) if before else batch
        rows.persist()  # read once from the source, as it is used for folders and rows
        try:
            merge_new(rows, path, keys, folders)
        finally:
            rows.unpersist()
        if after:
            after(number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def batch_stream(stream: DataFrame, path: str, checkpoint: str, after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Write a stream without keys, every batch once: a batch has a folder of its number, which a replay writes anew."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
