"""Price models: expanding-window folds, linear and boosted regressors, metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

# Fixed grids of the linear estimators: (alpha, share of the L1 part).
LASSO_GRID = tuple((a, 1.0) for a in (0.0001, 0.001, 0.01, 0.1, 1.0))
RIDGE_GRID = tuple((a, 0.0) for a in (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0))
ELASTIC_GRID = tuple((a, l1) for a in (0.0001, 0.001, 0.01, 0.1, 1.0) for l1 in (0.2, 0.5, 0.8))


def split_by_date(df: DataFrame, last_train: str, first_test: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("date") <= F.lit(last_train).cast("date")), df.filter(F.col("date") >= F.lit(first_test).cast("date"))


def expanding_folds(df: DataFrame, k: int = 5, order: str = "date") -> Iterator[tuple[DataFrame, DataFrame]]:
    """k (train, test) pairs: the last k blocks of n // (k + 1) rows, each after all that precedes it."""
    n = df.count()
    size = n // (k + 1)
    placed = numbered(df, [order], name="_place").withColumn("_place", F.col("_place") - 1)
    for i in range(k):
        start = n - (k - i) * size
        yield placed.filter(F.col("_place") < start).drop("_place"), placed.filter(F.col("_place").between(start, start + size - 1)).drop("_place")


def linear(alpha: float, l1: float, train: DataFrame, label: str, penalised: bool = True) -> LinearRegression:
    """Lasso (l1 = 1), ridge (l1 = 0, alpha times the squared norm against the summed errors) or elastic net in terms of the usual objective.

    Spark divides the whole penalty by the label's deviation, which is right for its L1 part only.
    """
    n, sd = train.agg(F.count("*"), F.stddev_samp(label)).first()
    sd = sd or 1.0
    if not l1:
        reg, share = alpha * sd / max(n, 1), 0.0
    else:
        reg = alpha * (l1 + (1 - l1) * sd)
        share = alpha * l1 / reg if reg else 0.0
    return LinearRegression(featuresCol="scaled", labelCol=label, regParam=reg, elasticNetParam=share, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-9)


def scaled(features: Sequence[str], n: int) -> list:
    """Stages that standardise by the deviation of the n training rows as a population; Spark's scaler takes a sample's."""
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    return [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="standard", withMean=True),
            ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(features)), inputCol="standard", outputCol="scaled")]


def fit_linear(train: DataFrame, features: Sequence[str], label: str, alpha: float, l1: float) -> PipelineModel:
    return Pipeline(stages=[*scaled(features, train.count()), linear(alpha, l1, train, label)]).fit(train)


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 3, rate: float = 0.1) -> PipelineModel:
    return Pipeline(stages=[*scaled(features, train.count()), GBTRegressor(featuresCol="scaled", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=42)]).fit(train)


@dataclass(frozen=True)
class Gram:
    """Sums from which every linear model of some rows follows: n, means, and centred products of the features and, last, the label."""

    n: int
    means: np.ndarray
    products: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        gap = other.means - self.means
        return Gram(n, self.means + gap * other.n / max(n, 1), self.products + other.products + np.outer(gap, gap) * self.n * other.n / max(n, 1))


def grams(df: DataFrame, features: Sequence[str], label: str, by: str) -> dict[int, Gram]:
    """A Gram a value of `by`, in two passes over the rows: the means of all, then products around them, which are shifted."""
    names = [*features, label]
    center = df.agg(*(F.avg(c).cast("double").alias(c) for c in names)).first()
    centred = df.select(F.col(by).alias("_by"), *((F.col(c).cast("double") - F.lit(center[c] or 0.0)).alias(f"_{i}") for i, c in enumerate(names)))
    d = range(len(names))
    rows = centred.groupBy("_by").agg(
        F.count("*").alias("n"), F.array(*(F.sum(f"_{i}") for i in d)).alias("s"), F.array(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in d for j in d)).alias("p")).collect()
    base = np.array([center[c] or 0.0 for c in names])
    out = {}
    for r in rows:
        m = np.array(r.s) / r.n
        out[r["_by"]] = Gram(r.n, base + m, np.array(r.p).reshape(len(names), -1) - r.n * np.outer(m, m))
    return out


def solved(g: Gram, alpha: float, l1: float, rounds: int = 10_000, tol: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, coefficients of the features as they are, coefficients of the standardised ones).

    l1 = 0 is ridge, |y - Xw|^2 + alpha |w|^2; else |y - Xw|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) / 2 |w|^2) by coordinate descent, on features standardised by the population's deviation.
    """
    sd = np.sqrt(np.diag(g.products)[:-1] / g.n)
    sd[sd == 0] = 1.0
    a, c = g.products[:-1, :-1] / np.outer(sd, sd), g.products[:-1, -1] / sd
    if not l1:
        w = np.linalg.solve(a + max(alpha, 1e-12) * np.eye(len(sd)), c)
    else:
        a, c = a / g.n, c / g.n
        w = np.zeros(len(sd))
        for _ in range(rounds):
            moved = 0.0
            for k in range(len(w)):
                rest = c[k] - a[k] @ w + a[k, k] * w[k]
                new = np.sign(rest) * max(abs(rest) - alpha * l1, 0.0) / (a[k, k] + alpha * (1 - l1) or 1.0)
                moved, w[k] = max(moved, abs(new - w[k])), new
            if moved <= tol * max(1.0, np.abs(w).max()):
                break
    plain = w / sd
    return float(g.means[-1] - g.means[:-1] @ plain), plain, w


def predicted(features: Sequence[str], intercept: float, coefficients: np.ndarray) -> Column:
    out = F.lit(float(intercept))
    for f, w in zip(features, coefficients):
        out = out + F.col(f).cast("double") * F.lit(float(w))
    return out


def grid_search(train: DataFrame, features: Sequence[str], label: str, grid: Sequence[tuple[float, float]], k: int = 5, order: str = "date") -> tuple[float, float]:
    """The (alpha, l1) of least mean absolute error over expanding folds.

    Rows are numbered across range partitions. All folds and grid points share two passes over them for their sums and one for their errors: no model is fitted by a job of its own.
    """
    numbers = numbered(train.select(order, label, *features), [order], name="_place")
    n = numbers.count()
    size = n // (k + 1)
    # Block 0 precedes all tests; blocks 1 .. k are the tests in turn.
    block = F.greatest(F.floor((F.col("_place") - 1 - (n - k * size)) / size) + 1, F.lit(0)).cast("int")
    placed = numbers.select(block.alias("_block"), label, *features)
    sums = grams(placed, features, label, "_block")
    errors, so_far = [], sums[0]
    for fold in range(1, k + 1):
        for i, g in enumerate(grid):
            b0, b, _ = solved(so_far, *g)
            errors.append(F.avg(F.when(F.col("_block") == fold, F.abs(F.col(label) - predicted(features, b0, b)))).alias(f"e{i}_{fold}"))
        so_far = so_far + sums[fold]
    found = placed.agg(*errors).first()
    score = [sum(found[f"e{i}_{fold}"] for fold in range(1, k + 1)) / k for i in range(len(grid))]
    return min(zip(score, grid))[1]


def fit_gram(train: DataFrame, features: Sequence[str], label: str, alpha: float, l1: float) -> tuple[float, np.ndarray, np.ndarray]:
    return solved(grams(train.withColumn("_all", F.lit(0)), features, label, "_all")[0], alpha, l1)


def metrics(df: DataFrame, label: str = "y", prediction: str = "prediction", order: str = "date", keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """n, mae, mse, rmse, r2 and directional accuracy, the share of rows after the first that move as predicted."""
    w = Window.partitionBy(*keys).orderBy(order)
    y, p = F.col(label), F.col(prediction)
    before = F.lag(label).over(w)
    rows = df.withColumn("_hit", F.when(before.isNotNull(), (F.signum(y - before) == F.signum(p - before)).cast("int")))
    e = y - p
    mse = F.avg(e * e)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), digits).alias("mae"), F.round(mse, digits).alias("mse"), F.round(F.sqrt(mse), digits).alias("rmse"),
        F.round(1 - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count("*"), F.lit(0.0)), digits).alias("r2"), F.round(F.avg("_hit"), digits).alias("da"))


def permutation_importance(predict: Callable[[DataFrame], DataFrame], test: DataFrame, features: Sequence[str], label: str, order: str = "date", repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance: mean rise of the mean absolute error when a feature's values are dealt anew among the rows, `repeats` times.

    Every (feature, repeat) is a copy of the test rows in one plan. Rows are numbered by order, copies by a seeded hash, both across range partitions: only place and value of a copy's rows are dealt anew.
    """
    copies = test.sparkSession.range(len(features) * repeats).select((F.col("id") % len(features)).cast("int").alias("_f"), F.floor(F.col("id") / len(features)).cast("int").alias("_r"))
    placed = numbered(test, [order], name="_k")
    # Bounded by the arguments.
    rows = placed.crossJoin(F.broadcast(copies))
    chosen = F.get(F.array(*(F.col(f).cast("double") for f in features)), F.col("_f"))
    deal = F.xxhash64(F.lit(seed), "_f", "_r", order)
    values = numbered(rows.select("_f", "_r", F.col("_k").alias("_own"), deal.alias("_deal"), chosen.alias("_v")), ["_deal", "_own"], ["_f", "_r"], "_k").select("_f", "_r", "_k", "_v")
    mixed = rows.join(values, ["_f", "_r", "_k"]).withColumns({f: F.when(F.col("_f") == i, F.col("_v")).otherwise(F.col(f).cast("double")) for i, f in enumerate(features)})
    error = F.avg(F.abs(F.col(label) - F.col("prediction")))
    base = predict(test).agg(error.alias("base"))
    names = F.array(*(F.lit(f) for f in features))
    return predict(mixed).groupBy("_f").agg(error.alias("mae")).crossJoin(F.broadcast(base)).select(F.get(names, F.col("_f")).alias("feature"), (F.col("mae") - F.col("base")).alias("importance"))


def reconstructed(df: DataFrame, current: str, moved: str, relative: bool = False) -> DataFrame:
    """df with price: the current one moved by a predicted difference, or by a predicted return."""
    return df.withColumn("price", F.col(current) * (1 + F.col(moved)) if relative else F.col(current) + F.col(moved))
