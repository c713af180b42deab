"""The package for Python workers that do not have its folder on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, folder: str) -> None:
    """Send the Python files of a package to the application's workers, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    made = tempfile.mkdtemp(prefix="sparkloom-")
    archive = os.path.join(made, f"{os.path.basename(folder)}-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(folder)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
