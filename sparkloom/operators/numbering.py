"""Row numbers and running totals of tables of any size: inside range partitions, plus offsets from the partitions' totals."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: monotonically_increasing_id() is the partition above so many bits, and the place inside it below.
_PLACE_BITS = 33


def _placed(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str]) -> DataFrame:
    """df dealt to range partitions by keys and order, sorted there and stored, with _part, its partition, and _at, its place there."""
    by = [F.col(k) if isinstance(k, str) else k for k in (*keys, *order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(placed, "numbered").withColumns({"_part": F.shiftright("_at", _PLACE_BITS), "_at": F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)})


def _offset(placed: DataFrame, amount: Column, keys: Sequence[str]) -> DataFrame:
    """placed with _start: the amount of its key in the partitions before its own.

    At most one key goes on from one partition into the next, so fewer rows than there are partitions are broadcast.
    """
    sums = placed.groupBy("_part", *keys).agg(amount.alias("_amount"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.sum("_amount").over(before)).filter(F.col("_start").isNotNull())
    starts = starts.select(F.col("_part").alias("_p"), F.col("_start"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_p"))
    return placed.join(F.broadcast(starts), same, "left").withColumn("_start", F.coalesce("_start", F.lit(0)))


def numbered(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "number") -> DataFrame:
    """df with `name`: 1, 2, ... by order, in each group of equal keys (null is a group) if keys are given.

    order should end in a tie-breaker; rows that it does not part are numbered in any order and lie in one task.
    A row's number is its place in its range partition plus what partitions before it hold of its key: no task gets a key whole, nor the table.
    What is stored keeps its numbers when a task is run again.
    """
    placed = _placed(df, order, keys)
    own = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_at")) if keys else F.col("_at") + 1
    out = _offset(placed.withColumn("_own", own.cast("long")), F.count("*"), keys)
    return out.select(*df.columns, (F.col("_own") + F.col("_start")).alias(name))


def running_total(df: DataFrame, amount: str, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "before") -> DataFrame:
    """df with `name`: the sum of amount over the rows before this one by order, in each group of equal keys if keys are given; 0 at the first.

    Like numbered(), by sums inside range partitions and offsets of their totals; order must part all rows of a key.
    """
    placed = _placed(df, order, keys)
    earlier = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = _offset(placed.withColumn("_own", F.coalesce(F.sum(amount).over(earlier), F.lit(0))), F.sum(amount), keys)
    return out.select(*df.columns, (F.col("_own") + F.col("_start")).alias(name))
