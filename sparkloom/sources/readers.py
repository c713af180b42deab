"""Readers of the engine's inputs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; a subset of columns is read alone."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    return df.select(*columns) if columns else df


def quoted_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV whose lines are each wrapped in quotes once more: they are unwrapped and read again."""
    lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", r'^\s*"|"\s*$', ""), '""', '"').alias("line"))
    ddl = ", ".join(f"`{n.strip()}` string" for n in names)
    rows = lines.select(F.from_csv("line", ddl).alias("r")).select("r.*")
    first = names[0].strip()
    return rows.filter(F.trim(F.col(f"`{first}`")) != first)  # the header


def split_column(df: DataFrame, column: str, names: Sequence[str], separator: str = ",") -> DataFrame:
    """One column's parts as columns."""
    parts = F.split(column, separator)
    return df.select(*(F.get(parts, i).alias(n) for i, n in enumerate(names)))


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def raw_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_ARTICLES).json(path)


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """A row a search result."""
    return spark.read.schema(schemas.DISCOVERED).json(path).select("date", "query", F.explode("results").alias("r")).select("date", "query", "r.*")


def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path, html of every *.html below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
