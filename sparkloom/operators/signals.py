"""Daily features to 0/1 signals, and binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .quantiles import exact_quantiles


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: str, digits: int = 6) -> DataFrame:
    """df with exact linear quantiles of each series joined on: name -> (column, share)."""
    cut = [F.round(F.percentile(c, p), digits).alias(n) for n, (c, p) in wanted.items()]
    return df.join(df.groupBy(by).agg(*cut), by)


def _set(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Null conditions are false."""
    return df.withColumns({n: F.coalesce(c, F.lit(False)).cast("int") for n, c in signals.items()})


def _shared(df: DataFrame, cv: str, up: str, down: str, score: str, strict: bool) -> DataFrame:
    c = F.col
    df = quantiles(df, {"_hi": (cv, 0.75), "_lo": (cv, 0.25), "_e": ("dir_entropy_d", 0.75), "_n": ("n_articles_d", 0.5)}, "target")
    out = _set(df, {
        "SIG_HIGH_DISAGR": c(cv) > c("_hi"), "SIG_LOW_DISAGR": c(cv) < c("_lo") if strict else c(cv) <= c("_lo"),
        "SIG_MAJORITY_UP": c(up) > 0.5, "SIG_MAJORITY_DOWN": c(down) > 0.5, "SIG_SPLIT": (c(up) > 0.25) & (c(down) > 0.25),
        "SIG_BULLISH": c(score) > 0.15, "SIG_BEARISH": c(score) < -0.15, "SIG_NEUTRAL": c(score).between(-0.15, 0.15),
        "SIG_HIGH_ENTROPY": c("dir_entropy_d") > c("_e"), "SIG_MANY_SOURCES": c("n_sources_d") >= 3, "SIG_MANY_ARTICLES": c("n_articles_d") >= c("_n"),
        "SIG_CONFIDENT_DISAGR": (c(cv) > c("_hi")) & (c("n_sources_d") >= 3)})
    return out.drop("_hi", "_lo", "_e", "_n")


def stat_signals(daily: DataFrame) -> DataFrame:
    """Twelve signals; low disagreement is strictly below the quartile."""
    return _shared(daily, "price_cv_d", "title_tang_pct_d", "title_giam_pct_d", "dir_score_d", True)


def text_signals(daily: DataFrame) -> DataFrame:
    """Twelve signals; low disagreement includes the quartile."""
    return _shared(daily, "price_cv_ts_d", "pct_tang_d", "pct_giam_d", "dir_score_ts_d", False)


def mention_signals(daily: DataFrame) -> DataFrame:
    """Ten signals of fixed thresholds."""
    c = F.col
    return _set(daily, {
        "SIG_MAJORITY_UP": c("pct_up") > 0.5, "SIG_MAJORITY_DOWN": c("pct_down") > 0.5, "SIG_SPLIT": (c("pct_up") > 0.3) & (c("pct_down") > 0.3),
        "SIG_BULLISH": (c("dir_score") > 0.2) & (c("n_coffee") >= 2), "SIG_BEARISH": (c("dir_score") < -0.2) & (c("n_coffee") >= 2),
        "SIG_NEUTRAL": F.abs(c("dir_score")) <= 0.1, "SIG_HIGH_ENTROPY": c("dir_entropy") > 1.0, "SIG_MANY_SOURCES": c("n_sources") >= 5,
        "SIG_MANY_ARTICLES": c("n_articles") >= 8, "SIG_HIGH_CERT": c("pct_high_cert") > 0.7})


DISAGREEMENT_SIGNALS = (
    "HIGH_DISAGR", "LOW_DISAGR", "MAJORITY_UP", "MAJORITY_DOWN", "SPLIT_SIGNAL", "STRONG_UP", "STRONG_DOWN", "HIGH_CERTAINTY", "LOW_CERTAINTY",
    "MIXED_CERTAINTY", "MANY_SOURCES", "MANY_ARTICLES", "HIGH_COVERAGE")


def disagreement_signals(daily: DataFrame) -> DataFrame:
    """Thirteen signals; quantiles are over all targets together. daily is stored, as it is read for each step of the quantiles."""
    c = F.col
    daily = stored(daily, "daily")
    cut = exact_quantiles(daily, {"_hi": ("disagr_score", 0.75), "_lo": ("disagr_score", 0.25), "_c": ("cert_entropy", 0.5), "_n": ("n_articles", 0.5)})
    df = daily.withColumns({n: F.round(F.lit(v).cast("double"), 6) for n, v in cut.items()})
    conditions = (
        c("disagr_score") > c("_hi"), c("disagr_score") < c("_lo"), c("pct_up") > 0.5, c("pct_down") > 0.5, (c("pct_up") > 0.3) & (c("pct_down") > 0.3),
        c("pct_up") > 0.75, c("pct_down") > 0.75, c("avg_certainty") <= 2.0, c("avg_certainty") >= 3.5, c("cert_entropy") > c("_c"),
        c("n_sources") >= 3, c("n_articles") >= c("_n"), c("pct_has_price") > 0.7)
    return _set(df, dict(zip(DISAGREEMENT_SIGNALS, conditions))).drop("_hi", "_lo", "_c", "_n")


def fixed_bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin (edge, next edge]; null outside, the lowest edge included."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def quantile_bins(df: DataFrame, column: str, n: int = 5, digits: int = 6) -> DataFrame:
    """df with lo, hi: the right-closed quantile bin of column, equal edges merged; the least value belongs to the first bin."""
    df = stored(df, "binned")
    cut = exact_quantiles(df, {str(k): (column, k / n) for k in range(n + 1)})
    edges = F.array_distinct(F.array(*(F.round(F.lit(v).cast("double"), digits) for v in cut.values())))
    df = df.filter(F.col(column).isNotNull()).withColumn("_edges", edges)
    x = F.round(F.col(column), digits)
    at = F.greatest(F.size(F.filter("_edges", lambda e: e < x)), F.lit(1))
    return df.withColumns({"lo": F.get("_edges", at - 1), "hi": F.get("_edges", at)}).drop("_edges")
