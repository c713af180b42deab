"""Shared pieces: scratch tables, connected components, word bytes."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, scratch_path

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written to the scratch folder, when its results have been read."""
    _delete(spark, f"{scratch_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Scratch tables that are not deleted yet, in the order of their making.
_made: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside let go of their shuffle files when they end; what they write stays."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table in the shared scratch folder, in a folder a value of `by` if that is given, and read it back.

    Cuts lineage: what follows survives lost executors without recomputing df, whose shuffle files go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _released(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns as a scratch table; all other scratch that was written for it goes."""
    before = len(_made)
    out = materialize(make(), name)
    for path in _made[before:-1]:
        _delete(out.sparkSession, path)
    del _made[before:-1]
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like materialize, in as many buckets of key as a shuffle has partitions: joins on key do not move the table again.

    df comes from an aggregation by key, so its rows already lie by bucket.
    """
    spark = df.sparkSession
    path, n = scratch_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"sparkloom_{name}_{uuid.uuid4().hex}"
    with _released(spark):
        df.write.option("compression", "zstd").bucketBy(n, key).format("parquet").saveAsTable(table, path=path)
    _made.append(path)
    return spark.table(table)


def drop_bucketed(df: DataFrame) -> None:
    """Drop a table made by bucketed() and its files."""
    drop_scratch(df)
    spark = df.sparkSession
    names = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(names.size()):
        if names.apply(k).catalogTable().isDefined():
            spark.sql(f"DROP TABLE IF EXISTS {names.apply(k).catalogTable().get().identifier().quotedString()}")


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files of tables made by materialize()."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sparkloom/" in name:
                _delete(df.sparkSession, name)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what a worker holds as Python objects at once is a part of an Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the least node reachable.

    Alternating large-star and small-star contraction: each round rewires every
    edge to the least neighbour, so the edge table never grows beyond
    its first size and the rounds grow with the logarithm of the longest path. Only a count
    and a checksum reach the driver. Minima are taken by partial aggregation,
    so a hub's edges meet in no single task; the join back can be split by AQE.
    Self-loops and repeated edges are allowed; null ends are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = e.filter("u is not null and v is not null and u <> v").distinct()
    current = materialize(e, "edges")
    state = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        # Here every edge points from u to a smaller v.
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        following = materialize(small, "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(current)
        current = following
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled edges are stars: each node points at its component's least node.
    stars = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    hubs = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(hubs)
