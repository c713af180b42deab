"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists


def by_target(df: DataFrame, path: str, kind: str = "parquet", key: str = "target") -> None:
    """A folder a target: rows of one target and a bounded number of rows a file."""
    df.write.mode("overwrite").partitionBy(key).option("maxRecordsPerFile", 5_000_000).option("header", True).format(kind).save(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table in a folder, if it is there."""
    return spark.read.parquet(path) if exists(spark, path) else None


def report(df: DataFrame, path: str, line: Column | None = None) -> None:
    """JSON rows, and text lines if a line is given."""
    df.write.mode("overwrite").json(f"{path}/json")
    if line is not None:
        df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/text")


def resume(work: DataFrame, path: str, key: str, run: Callable[[DataFrame], DataFrame], batches: int = 10) -> None:
    """Run work that has no stored `ok` result, in batches by a hash of the key; each batch is stored before the next starts."""
    for k in range(batches):
        part = work.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        stored = _stored(work.sparkSession, path)
        if stored is not None:
            part = part.join(stored.filter("status = 'ok'").select(key), key, "left_anti")
        run(part).write.mode("append").parquet(path)
