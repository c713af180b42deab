"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_kept: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without that setting gets a folder of its own (tests);
    a cluster without it is an error, as machine-local files would be lost.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_scratch.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="sparkloom-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the driver ends."""
    folder = f"{scratch_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(_clear, spark.sparkContext._jvm, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _clear(jvm, folder: str) -> None:
    # The JVM may have gone before the driver's Python.
    with contextlib.suppress(Exception):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what follows does not compute it again, whichever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
