"""Exact quantiles of columns of any size, without a buffer of all values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a bracket that one task counts and sorts; wider brackets are narrowed first.
HELD = 1 << 16
#: Of the sketches that narrow a bracket: its ends miss their ranks by at most one part in so many of the rows inside.
ACCURACY = 10_000


@dataclass
class _Bracket:
    """Values from low to high (ends included or not) among which the ranks first and last of a column lie; `below` values are less than those."""

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int
    upto: int
    with_low: bool = True
    with_high: bool = True
    slack: float = 2 / ACCURACY
    settled: bool = False

    def inside(self) -> Column:
        x = _value(self.column)
        return (x >= self.low if self.with_low else x > self.low) & (x <= self.high if self.with_high else x < self.high)

    def open(self, held: int) -> bool:
        return not self.settled and self.upto - self.below > held and self.low < self.high

    def sketch(self) -> Column:
        """Values near the wanted ranks, as shares of the rows inside."""
        n = self.upto - self.below
        a, b = (self.first - self.below) / n - self.slack, (self.last + 1 - self.below) / n + self.slack
        return F.percentile_approx(F.when(self.inside(), _value(self.column)), F.array(F.lit(max(a, 0.0)), F.lit(min(b, 1.0))), ACCURACY)

    def counts(self, low: float, high: float) -> Column:
        x = _value(self.column)
        return F.array(*(F.count_if(c) for c in (x < low, x <= low, x < high, x <= high)))

    def narrowed(self, low: float, high: float, counts: list[int]) -> None:
        """Take an end over where the counted ranks say that the wanted ones lie inside of it."""
        size = self.upto - self.below
        less_low, upto_low, less_high, upto_high = counts
        if upto_low <= self.first:
            self.low, self.with_low, self.below = low, False, upto_low
        elif self.below < less_low <= self.first:
            self.low, self.with_low, self.below = low, True, less_low
        if less_high > self.last:
            self.high, self.with_high, self.upto = high, False, less_high
        elif self.upto > upto_high > self.last:
            self.high, self.with_high, self.upto = high, True, upto_high
        if self.upto - self.below == size:
            # Only ties are left at both ends, or the sketch missed by more than it says: widen it, in the end give up.
            self.settled, self.slack = self.slack >= 0.1, self.slack * 8


def _value(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], held: int = HELD) -> dict[str, float | None]:
    """name: exact linear quantile, for name: (column, share), the value at the place share * (n - 1), between two values in proportion; null and NaN are left out, no value gives None.

    Every value lies first in one bracket. While a bracket holds more than `held` values, a sketch of what it holds (bounded, merged by partial aggregation)
    proposes narrower ends, and counts of the rows below them, which are exact, decide whether the wanted ranks lie inside; so ranks are right whatever the sketch gives.
    The distinct values of the last brackets are counted and summed up. Only bounds, counts and results reach the driver. df is read several times: store it if it is costly.
    """
    columns = sorted({c for c, _ in wanted.values()})
    found = df.agg(*(F.struct(F.count(_value(c)).alias("n"), F.min(_value(c)).alias("low"), F.max(_value(c)).alias("high")).alias(f"c{i}") for i, c in enumerate(columns))).first()
    ends = {c: found[f"c{i}"] for i, c in enumerate(columns)}
    brackets: dict[str, _Bracket] = {}
    for name, (column, share) in wanted.items():
        n = ends[column].n
        if n:
            at = share * (n - 1)
            brackets[name] = _Bracket(column, math.floor(at), math.ceil(at), ends[column].low, ends[column].high, 0, n)
    while wide := [b for b in brackets.values() if b.open(held)]:
        near = df.agg(*(b.sketch().alias(f"b{i}") for i, b in enumerate(wide))).first()
        counts = df.agg(*(b.counts(*near[i]).alias(f"b{i}") for i, b in enumerate(wide))).first()
        for i, b in enumerate(wide):
            b.narrowed(*near[i], counts[i])
    if not brackets:
        return dict.fromkeys(wanted)
    names = list(brackets)
    held_values = [F.when(b.inside(), F.struct(F.lit(i).alias("i"), _value(b.column).alias("value"))) for i, b in enumerate(brackets.values())]
    values = df.select(F.explode(F.array_compact(F.array(*held_values))).alias("v")).groupBy("v.i", "v.value").count()
    values = values.withColumn("upto", F.sum("count").over(Window.partitionBy("i").orderBy("value")))
    rank = lambda pick: F.element_at(F.array(*(F.lit(pick(b) - b.below) for b in brackets.values())), F.col("i") + 1)
    two = values.groupBy("i").agg(*(F.min(F.when(F.col("upto") > rank(pick), F.col("value"))).alias(n) for n, pick in (("a", lambda b: b.first), ("b", lambda b: b.last)))).collect()
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for r in two:
        b, (column, share) = brackets[names[r.i]], wanted[names[r.i]]
        at = share * (ends[column].n - 1)
        out[names[r.i]] = r.a + (r.b - r.a) * (at - b.first)
    return out
