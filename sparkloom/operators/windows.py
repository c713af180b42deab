"""Lags, rolling means and returns of daily series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .numbering import numbered, running_total


def per_series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def add_lags(df: DataFrame, columns: Sequence[str], w: WindowSpec, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """{column}_lag{k}: the value k rows before, in the series' own order."""
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def add_rolling(df: DataFrame, columns: Sequence[str], w: WindowSpec, n: int = 3, shifted: bool = True) -> DataFrame:
    """{column}_roll{n}: mean of n rows, of those before this one if shifted, else with it; fewer at the start."""
    frame = w.rowsBetween(-n, -1) if shifted else w.rowsBetween(1 - n, 0)
    return df.withColumns({f"{c}_roll{n}": F.avg(c).over(frame) for c in columns})


def moving_average(c: str, w: WindowSpec, n: int, full: bool = True) -> Column:
    """Mean of n rows; null until there are n, if full."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) >= n, F.avg(c).over(frame)) if full else F.avg(c).over(frame)


def next_return(c: str, w: WindowSpec) -> Column:
    """Percent change to the next row; null at the end and where this row is 0."""
    return F.when(F.col(c) != 0, (F.lead(c).over(w) / F.col(c) - 1) * 100)


def absolute_return(c: str, w: WindowSpec) -> Column:
    before = F.lag(c).over(w)
    return F.when(before != 0, F.abs(F.col(c) / before - 1) * 100)


def next_direction(c: str, w: WindowSpec) -> Column:
    """1 if the next return is positive, else 0: also at the end."""
    return F.when(next_return(c, w) > 0, 1).otherwise(0)


def next_label(c: str, w: WindowSpec) -> Column:
    """UP if the next value is greater, else DOWN: also for ties and at the end."""
    return F.when(F.lead(c).over(w) > F.col(c), "UP").otherwise("DOWN")


def in_blocks(df: DataFrame, order: Sequence[str | Column], compute: Callable[[DataFrame, WindowSpec], DataFrame], back: int = 0, ahead: int = 0, block: int = 1 << 16) -> DataFrame:
    """compute(rows, window) over one ordered series of any length, for expressions that look at most `back` rows back and `ahead` rows ahead.

    Rows are numbered across range partitions and cut into blocks; each block gets copies of the last `back` rows before it and the first `ahead` rows after it, so what it computes for
    its own rows is what one window over the whole series gives, and no task gets the series. order must part all rows. compute may add columns and must keep the rows; frames without an end at a side are not for this.
    """
    if not 0 <= max(back, ahead) <= block:
        raise ValueError("back and ahead must not exceed a block")
    at, inside = F.floor((F.col("_n") - 1) / block), F.pmod(F.col("_n") - 1, F.lit(block))
    shares = F.array(at, F.when(inside >= block - back, at + 1), F.when(inside < ahead, at - 1))
    rows = numbered(df, order, name="_n").withColumn("_home", at).withColumn("_block", F.explode(F.array_compact(shares)))
    out = compute(rows, Window.partitionBy("_block").orderBy("_n"))
    return out.filter("_block = _home").drop("_n", "_home", "_block")


def value_ranks(counts: DataFrame, column: str, count: str = "count", keys: Sequence[str] = ()) -> DataFrame:
    """counts(keys, column, count) of distinct values with rank: the mean rank of a value's rows, from running totals of the counts."""
    return running_total(counts, count, [column], keys, "_before").withColumn("rank", F.col("_before") + (F.col(count) + 1) / 2).drop("_before")


def average_ranks(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with the rank of column, the mean rank for ties; null for null.

    Distinct values are counted (partial aggregation, so a common value is one row), summed up in range partitions and joined back.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).count()
    ranks = value_ranks(counts, column, keys=keys).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(column).alias("_value"), F.col("rank").alias(name))
    same = F.col(column) == F.col("_value")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same, "left").select(*df.columns, name)


def spine(df: DataFrame, ends: DataFrame, column: str = "date") -> DataFrame:
    """Every day from _first to _last, of the one row of ends, once for each row of df."""
    days = F.sequence("_first", "_last", F.expr("interval 1 day"))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.explode(days)).drop("_first", "_last")
