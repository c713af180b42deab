"""Keep-first, insert-only merge and resumable work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .quantiles import exact_quantiles


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by order, which should end in a tie-breaker."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and the rows of incoming whose keys it lacks: MERGE ... WHEN NOT MATCHED THEN INSERT."""
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def pending(work: DataFrame, cache: DataFrame, key: str, status: str = "status", done: str = "ok", retry: bool = True) -> DataFrame:
    """Work without a cached result; failed results are tried again if retry."""
    seen = cache.filter(F.col(status) == done) if retry else cache
    return work.join(seen.select(key), key, "left_anti")


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of each column replaced by its exact median; df is stored, as it is read for each step of the medians."""
    df = stored(df, "filled")
    medians = exact_quantiles(df, {c: (c, 0.5) for c in columns})
    return df.withColumns({c: F.coalesce(c, F.lit(medians[c]).cast("double")) for c in columns})


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    return [c for c in df.columns if any(p in c for p in parts)]


def with_key_suffix(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Other columns than the keys renamed, so that two versions can be joined."""
    return df.select(*keys, *(F.col(c).alias(f"{c}{suffix}") for c in df.columns if c not in keys))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """n rows, or n of each group, by a seeded digest of the key: the same whatever the partitions and the engine."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    if not by:
        return df.orderBy(draw, key).limit(n)
    return keep_first(df, by, (draw, F.col(key))) if n == 1 else (
        df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(draw, key))).filter(F.col("_n") <= n).drop("_n"))


def join_on(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left") -> DataFrame:
    """A join on keys that are called differently on the two sides; the right side's keys are dropped."""
    on = [left[a] == right[b] for a, b in pairs.items()]
    return left.join(right, on, how).drop(*(right[b] for b in pairs.values()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, as far as it has them."""
    return df.drop(*names)
