"""Correlations, tests and lines between features and returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .windows import value_ranks


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keep), list(columns), name, value)


def both(a: str, b: str) -> tuple[Column, Column]:
    """Two columns, null where either is."""
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(there, F.col(a).cast("double")), F.when(there, F.col(b).cast("double"))


def correlations(df: DataFrame, features: Sequence[str], target: str, digits: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """feature, n, r: Pearson over the rows that have both, in one pass for all features."""
    long = unpivoted(df.select(*keys, target, *(F.col(c).cast("double").alias(c) for c in features)), features, [*keys, target])
    x, y = both("value", target)
    return long.groupBy(*keys, "feature").agg(F.count(x).alias("n"), F.round(F.nanvl(F.corr(x, y), F.lit(None)), digits).alias("r"))


def spearman(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """n, rho: Pearson of average ranks over the rows that have both; null if either is constant.

    Rows are counted by their pair of values, ranks come from running totals of the values' counts, and the mean rank, which is known, is taken off before products are summed.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = stored(rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("w")), "pairs")
    rank = lambda c: value_ranks(pairs.groupBy(c).agg(F.sum("w").alias("count")), c).select(c, F.col("rank").alias(f"r{c}"))
    ranked = pairs.join(rank("x"), "x").join(rank("y"), "y")
    middle = pairs.agg(((F.sum("w") + 1) / 2).alias("middle"))  # one row
    x, y, w = F.col("rx") - F.col("middle"), F.col("ry") - F.col("middle"), F.col("w")
    sums = ranked.crossJoin(F.broadcast(middle)).agg(F.coalesce(F.sum(w), F.lit(0)).alias("n"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    rho = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy")))
    return sums.select("n", F.round(rho, digits).alias("rho"))


def line(df: DataFrame, y: str, x: str, digits: int = 6) -> DataFrame:
    """n, slope, intercept, r of the least-squares line."""
    a, b = both(y, x)
    return df.agg(
        F.count(a).alias("n"), F.round(F.regr_slope(a, b), digits).alias("slope"),
        F.round(F.regr_intercept(a, b), digits).alias("intercept"), F.round(F.corr(a, b), digits).alias("r"))


def welch(df: DataFrame, signals: Sequence[str], target: str, least: int = 5, digits: int = 6) -> DataFrame:
    """signal, n1, n0, mean1, mean0, diff, t, df: rows with the signal against those without; more than `least` of each."""
    long = unpivoted(df.filter(F.col(target).isNotNull()).select(target, *signals), signals, [target], "signal")
    on, off = F.when(F.col("value") == 1, F.col(target)), F.when(F.col("value") == 0, F.col(target))
    g = long.groupBy("signal").agg(
        F.count(on).alias("n1"), F.count(off).alias("n0"), F.avg(on).alias("m1"), F.avg(off).alias("m0"),
        (F.var_samp(on) / F.count(on)).alias("s1"), (F.var_samp(off) / F.count(off)).alias("s0")).filter((F.col("n1") > least) & (F.col("n0") > least))
    s = F.col("s1") + F.col("s0")
    return g.select(
        "signal", "n1", "n0", F.round("m1", digits).alias("mean1"), F.round("m0", digits).alias("mean0"), F.round(F.col("m1") - F.col("m0"), digits).alias("diff"),
        F.round(F.when(s > 0, (F.col("m1") - F.col("m0")) / F.sqrt(s)), digits).alias("t"),
        F.round(F.when(s > 0, s * s / (F.col("s1") ** 2 / (F.col("n1") - 1) + F.col("s0") ** 2 / (F.col("n0") - 1))), digits).alias("df"))


# Lanczos' approximation of the gamma function with g = 7 and nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function, for x of at least 0.5."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, folded from its far end; its terms settle after some square root of a and b."""
    depth = (F.lit(200) + F.ceil(F.lit(8) * F.sqrt(F.greatest(a, b)))).cast("int")
    at = F.struct(a.alias("a"), b.alias("b"), x.alias("x"))

    def folded(p: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]

        def term(j: Column) -> Column:
            m = F.floor(j / 2)
            return F.when(j % 2 == 0, m * (b - m) * x / ((a + j - 1) * (a + j))).otherwise(-(a + m) * (a + b + m) * x / ((a + j - 1) * (a + j)))

        return F.aggregate(F.sequence(depth, F.lit(1)), F.lit(1.0), lambda rest, j: F.lit(1.0) + term(j) / rest)

    return F.lit(1.0) / F.get(F.transform(F.array(at), folded), 0)


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, the regularised incomplete beta function at df / (df + t^2), by expressions alone; null for null and for df that is not positive."""
    t, df = t.cast("double"), F.when(df > 0, df.cast("double"))
    a, b = df / 2, F.lit(0.5)
    x = F.least(F.greatest(df / (df + t * t), F.lit(1e-300)), F.lit(1 - 1e-16))
    y = F.least(F.greatest(t * t / (df + t * t), F.lit(1e-300)), F.lit(1 - 1e-16))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - F.lit(0.5 * math.log(math.pi)) + a * F.log(x) + b * F.log(y))
    # Each side's fraction converges fast on its own half; x and y = 1 - x are computed apart, so neither loses digits.
    p = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(F.lit(1.0) - front * _beta_fraction(b, a, y) / b)
    return F.when(t.isNotNull() & df.isNotNull(), p)


def pearson_t(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
