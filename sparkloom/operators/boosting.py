"""Second-order boosted trees on binned features, for grids of settings: Spark's own booster has neither.

A grid is fitted in parallel, a task a (setting, fold): each gets the rows of one price series, which has some
thousand days, so a task's data is bounded by the series and not by the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """Trees grow level by level to max_depth, or leaf by leaf, best gain first, to num_leaves (max_depth -1: any)."""

    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    subsample: float = 1.0
    num_leaves: int = 0
    penalty: float = 1.0
    least: int = 1


# Fixed grids, 36 settings each.
BY_LEVEL = tuple(Setting(n, depth, rate, sub) for n, depth, rate, sub in product((100, 200), (3, 5, 7), (0.01, 0.05, 0.1), (0.8, 1.0)))
BY_LEAF = tuple(Setting(n, depth, rate, 1.0, leaves, 0.0, 20) for n, depth, rate, leaves in product((100, 200), (3, 5, -1), (0.01, 0.05, 0.1), (31, 50)))


class Boosted:
    """Squared loss: a leaf is the sum of residuals over its rows plus the penalty, shrunk by the learning rate."""

    def __init__(self, setting: Setting, bins: int = 255, seed: int = 42):
        self.setting, self.bins, self.seed = setting, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        s, rng = self.setting, np.random.default_rng(self.seed)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        codes = self._codes(x)
        self.base, self.trees = float(y.mean()), []
        #: Gain and number of the splits of each feature.
        self.gain, self.splits = np.zeros(x.shape[1]), np.zeros(x.shape[1], np.int64)
        score = np.full(len(y), self.base)
        for _ in range(s.n_estimators):
            rows = np.arange(len(y)) if s.subsample >= 1 else np.flatnonzero(rng.random(len(y)) < s.subsample)
            tree = self._tree(codes[rows], (y - score)[rows])
            self.trees.append(tree)
            score += self._leaves(tree, codes)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.base + sum((self._leaves(t, codes) for t in self.trees), np.zeros(len(x)))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value: the number of edges below it."""
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def _best(self, codes: np.ndarray, residuals: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin of the left side) of the best split of some rows."""
        s, d = self.setting, codes.shape[1]
        flat = (codes + np.arange(d) * self.bins).ravel()
        g = np.bincount(flat, np.repeat(residuals, d), d * self.bins).reshape(d, -1).cumsum(1)
        n = np.bincount(flat, minlength=d * self.bins).reshape(d, -1).cumsum(1)
        total, count = residuals.sum(), len(residuals)
        fits = (n >= s.least) & (count - n >= s.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / (n + s.penalty) + (total - g) ** 2 / (count - n + s.penalty) - total**2 / (count + s.penalty)
        gain = np.where(fits, gain, -1.0)
        at = int(gain.argmax())
        return float(gain.flat[at]), at // self.bins, at % self.bins

    def _tree(self, codes: np.ndarray, residuals: np.ndarray) -> list[list]:
        """Nodes [feature, bin, left, right, value], the root first."""
        s = self.setting
        value = lambda r: s.learning_rate * r.sum() / (len(r) + s.penalty) if len(r) else 0.0
        nodes: list[list] = [[-1, 0, 0, 0, value(residuals)]]
        # (gain, feature, bin, node, depth, rows) of the leaves that can be split.
        open_leaves: list[tuple] = []

        def consider(node: int, depth: int, rows: np.ndarray) -> None:
            if (s.max_depth < 0 or depth < s.max_depth) and len(rows) >= 2 * s.least:
                gain, feature, at = self._best(codes[rows], residuals[rows])
                if gain > 1e-12:
                    open_leaves.append((gain, feature, at, node, depth, rows))

        consider(0, 0, np.arange(len(residuals)))
        leaves = 1
        while open_leaves and (not s.num_leaves or leaves < s.num_leaves):
            gain, feature, at, node, depth, rows = open_leaves.pop(max(range(len(open_leaves)), key=lambda k: open_leaves[k][0]) if s.num_leaves else 0)
            self.gain[feature] += gain
            self.splits[feature] += 1
            left = codes[rows, feature] <= at
            nodes[node][:4] = [feature, at, len(nodes), len(nodes) + 1]
            for own in (rows[left], rows[~left]):
                nodes.append([-1, 0, 0, 0, value(residuals[own])])
                consider(len(nodes) - 1, depth + 1, own)
            leaves += 1
        return nodes

    @staticmethod
    def _leaves(nodes: list[list], codes: np.ndarray) -> np.ndarray:
        feature, at, left, right = (np.array([n[k] for n in nodes]) for k in range(4))
        node = np.zeros(len(codes), np.int64)
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            own = node[inner]
            node[inner] = np.where(codes[inner, feature[own]] <= at[own], left[own], right[own])
        return np.array([n[4] for n in nodes])[node]

    def importances(self) -> np.ndarray:
        """Share of the mean gain of a feature's splits, or their number if trees grow by leaves."""
        if self.setting.num_leaves:
            return self.splits.astype(float)
        mean = self.gain / np.maximum(self.splits, 1)
        return mean / (mean.sum() or 1.0)


def grid_errors(train: DataFrame, features: Sequence[str], label: str, grid: Sequence[Setting], k: int = 5, order: str = "date") -> DataFrame:
    """setting (place in the grid), mae: the mean over k expanding folds of the mean absolute error, a task a (setting, fold)."""
    n = train.count()
    size = n // (k + 1)
    rows = train.select(*(F.col(c).cast("double").alias(c) for c in (*features, label)), (F.row_number().over(Window.partitionBy().orderBy(order)) - 1).alias("_place"))
    # Bounded by the arguments: settings times folds.
    points = train.sparkSession.range(len(grid) * k).select((F.col("id") % len(grid)).cast("int").alias("setting"), F.floor(F.col("id") / len(grid)).cast("int").alias("fold"))
    names, settings = list(features), list(grid)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        setting, fold = int(pdf.setting.iloc[0]), int(pdf.fold.iloc[0])
        start = n - (k - fold) * size
        x, y = pdf[names].to_numpy(), pdf[label].to_numpy()
        model = Boosted(settings[setting]).fit(x[:start], y[:start])
        return pd.DataFrame({"setting": [setting], "fold": [fold], "mae": [float(np.abs(model.predict(x[start : start + size]) - y[start : start + size]).mean())]})

    tasks = rows.crossJoin(F.broadcast(points)).repartition(len(grid) * k, "setting", "fold")
    each = tasks.groupBy("setting", "fold").applyInPandas(run, "setting int, fold int, mae double")
    return each.groupBy("setting").agg(F.avg("mae").alias("mae"))


def best_setting(train: DataFrame, features: Sequence[str], label: str, grid: Sequence[Setting], k: int = 5, order: str = "date") -> Setting:
    best = grid_errors(train, features, label, grid, k, order).orderBy("mae", "setting").first()
    return grid[best.setting]


def fit(train: DataFrame, features: Sequence[str], label: str, setting: Setting, order: str = "date") -> Boosted:
    """A model of one series, whose rows go to the driver: some thousand days."""
    pdf = train.select(order, *(F.col(c).cast("double").alias(c) for c in (*features, label))).orderBy(order).toPandas()
    return Boosted(setting).fit(pdf[list(features)].to_numpy(), pdf[label].to_numpy())


def predict(df: DataFrame, features: Sequence[str], model: Boosted) -> DataFrame:
    """df with prediction, in Arrow batches."""
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

    return df.withColumn("prediction", run(*(F.col(f).cast("double") for f in features)))
