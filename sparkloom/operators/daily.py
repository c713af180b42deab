"""Article facts to daily features: four variants that differ on purpose.

Each is one grouped aggregation. Shares and scores are rounded to `digits` places, so that thresholds
compare what is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy
from .windows import spine


def _r(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def variation(c: Column) -> Column:
    """Sample standard deviation over the mean; 0 for fewer than two values or a mean that is not positive."""
    return F.coalesce(F.when((F.count(c) >= 2) & (F.avg(c) > 0), F.stddev_samp(c) / F.avg(c)), F.lit(0.0))


def _share(c: Column) -> Column:
    return F.avg(c.cast("int"))


def stat_daily(articles: DataFrame, digits: int = 6) -> DataFrame:
    """Per (target, date), from body statistics and titles.

    Prices are those of titles if two or more titles have one, else the articles' medians; the day's `price_median_d` is the mean of these. The
    entropy is over the title shares up, down and what they leave.
    """
    title = F.count("title_price") >= 2
    pick = lambda f: F.when(title, f(F.col("title_price"))).otherwise(f(F.col("price")))
    d = articles.filter("target is not null and date is not null").groupBy("target", "date").agg(
        F.count("*").alias("n_articles_d"), F.count_distinct("domain").alias("n_sources_d"),
        _r(_share(F.col("has_price")), digits).alias("pct_has_price_d"), _r(_share(F.col("has_noise")), digits).alias("pct_noise_d"),
        _r(pick(F.avg), digits).alias("price_median_d"), _r(pick(variation), digits).alias("price_cv_d"),
        pick(lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c)).otherwise(0.0)).alias("price_range_d"),
        _r(F.avg("change_mean"), digits).alias("avg_change_d"),
        _share(F.col("title_up")).alias("u"), _share(F.col("title_down")).alias("v"), F.avg("dir_score").alias("s"),
        F.sum("n_up").alias("kw_tang_d"), F.sum("n_down").alias("kw_giam_d"), F.sum(F.col("n_stable") + F.col("n_flat")).alias("kw_stable_d"),
    )
    u, v = F.col("u"), F.col("v")
    return d.withColumns({
        "dir_score_d": _r(0.6 * (u - v) + 0.4 * F.col("s"), digits), "title_tang_pct_d": _r(u, digits), "title_giam_pct_d": _r(v, digits),
        "dir_entropy_d": _r(entropy(u, v, F.greatest(F.lit(0.0), 1 - u - v)), digits),
    }).drop("u", "v", "s")


def text_daily(articles: DataFrame, digits: int = 6) -> DataFrame:
    """Per (target, date), from titles with snippets: the entropy is over three overlapping rates as they are."""
    d = articles.filter("target is not null and date is not null").groupBy("target", "date").agg(
        F.count("*").alias("n_articles_d"), F.count_distinct("domain").alias("n_sources_d"),
        _share(F.col("ts_up")).alias("u"), _share(F.col("ts_down")).alias("v"), _share(F.col("ts_stable")).alias("w"),
        _r(F.avg("body_dir_score"), digits).alias("dir_score_body_d"), F.median("price").alias("price_median_ts_d"),
        _r(variation(F.col("price")), digits).alias("price_cv_ts_d"), _r(_share(F.col("price").isNotNull()), digits).alias("pct_has_price_d"),
    )
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    return d.withColumns({
        "pct_tang_d": _r(u, digits), "pct_giam_d": _r(v, digits), "pct_on_dinh_d": _r(w, digits),
        "dir_score_ts_d": _r(u - v, digits), "dir_entropy_d": _r(entropy(u, v, w), digits)}).drop("u", "v", "w")


def mention_daily(facts: DataFrame, first: str | None = None, last: str | None = None, by_target: bool = True, digits: int = 6) -> DataFrame:
    """Every day of a calendar, by default from the first to the last day of the facts, from extracted facts: direction, price, price_change, certainty, relevant.

    Shares are among the relevant rows, articles and sources among all; a day without relevant rows has shares of 0 and
    null prices, changes and certainties. Not by_target pools all rows, those without a target included.
    """
    ends = facts.agg(F.coalesce(F.to_date(F.lit(first)), F.min("date")).alias("_first"), F.coalesce(F.to_date(F.lit(last)), F.max("date")).alias("_last"))  # one row
    if first is not None:
        facts = facts.filter(F.col("date") >= F.to_date(F.lit(first)))
    if last is not None:
        facts = facts.filter(F.col("date") <= F.to_date(F.lit(last)))
    facts = facts.filter("date is not null")
    if by_target:
        facts = facts.filter("target is not null")
        keys, days = ["target", "date"], spine(facts.select("target").distinct(), ends)
    else:
        keys, days = ["date"], spine(facts.sparkSession.range(1).select(), ends)
    rel = lambda c: F.when(F.col("relevant"), c)
    count = lambda c: F.count_if(F.col("relevant") & c)
    price = rel(F.col("price"))
    d = facts.groupBy(*keys).agg(
        F.count("*").alias("n_articles"), count(F.lit(True)).alias("n_coffee"), F.count_distinct("domain").alias("n_sources"),
        *(count(F.col("direction") == x).alias(f"n_{x}") for x in ("UP", "DOWN", "STABLE", "MIXED")),
        F.median(price).alias("price_median"), _r(F.avg(price), digits).alias("price_mean"), _r(variation(price), digits).alias("price_cv"),
        F.count(price).alias("n_price"), F.median(rel(F.col("price_change"))).alias("price_change_median"),
        _r(F.avg(rel(F.col("certainty"))), digits).alias("certainty_mean"), _r(F.avg(rel((F.col("certainty") <= 2).cast("int"))), digits).alias("pct_high_cert"),
    )
    d = days.join(d, keys, "left")
    part = lambda c: F.when(F.col("n_coffee") > 0, F.col(c) / F.col("n_coffee")).otherwise(0.0)
    named = [part(f"n_{x}") for x in ("UP", "DOWN", "STABLE", "MIXED")]
    other = F.when(F.col("n_coffee") > 0, (F.col("n_coffee") - F.col("n_UP") - F.col("n_DOWN") - F.col("n_STABLE") - F.col("n_MIXED")) / F.col("n_coffee")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select(
        *keys, whole("n_articles").alias("n_articles"), whole("n_coffee").alias("n_coffee"), whole("n_sources").alias("n_sources"),
        *(_r(c, digits).alias(n) for c, n in zip(named, ("pct_up", "pct_down", "pct_stable", "pct_mixed"))),
        _r(named[0] - named[1], digits).alias("dir_score"), _r(entropy(*named, other), digits).alias("dir_entropy"),
        "price_median", "price_mean", zero(F.col("price_cv")).alias("price_cv"), _r(part("n_price"), digits).alias("pct_has_price"),
        "price_change_median", "certainty_mean", zero(F.col("pct_high_cert")).alias("pct_high_cert"))


def disagreement_daily(facts: DataFrame, digits: int = 6) -> DataFrame:
    """Per (target, date): price disagreement and the entropies of directions and certainties.

    Direction shares are among rows with a direction; the entropy leaves out NONE, so its shares need not sum to 1. Average certainty
    is null on days without a price.
    """
    facts = facts.filter("target is not null and date is not null")
    stated = F.count("direction")
    share = lambda x: F.coalesce(F.count_if(F.col("direction") == x) / F.nullif(stated, F.lit(0)), F.lit(0.0))
    grade = lambda k: F.coalesce(F.count_if(F.col("certainty") == k) / F.nullif(F.count("certainty"), F.lit(0)), F.lit(0.0))
    n = F.count("price")
    d = facts.groupBy("target", "date").agg(
        F.count("*").alias("n_articles"), F.count_distinct("domain").alias("n_sources"), n.alias("n_with_price"),
        _r(variation(F.col("price")), digits).alias("disagr_score"), F.when(n >= 2, F.max("price") - F.min("price")).otherwise(0).cast("long").alias("price_range"),
        F.median("price").alias("median_price"), share("UP").alias("u"), share("DOWN").alias("v"), share("STABLE").alias("w"),
        F.when(n > 0, _r(F.avg("certainty"), digits)).alias("avg_certainty"), *(grade(k).alias(f"c{k}") for k in range(1, 6)),
        _r(n / F.count("*"), digits).alias("pct_has_price"))
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    return d.withColumns({
        "pct_up": _r(u, digits), "pct_down": _r(v, digits), "pct_stable": _r(w, digits), "dir_entropy": _r(entropy(u, v, w), digits),
        "cert_entropy": _r(entropy(*(F.col(f"c{k}") for k in range(1, 6))), digits)}).drop("u", "v", "w", *(f"c{k}" for k in range(1, 6)))


STAT_LAGS = ("dir_score_d", "title_tang_pct_d", "title_giam_pct_d", "price_cv_d", "price_range_d", "dir_entropy_d", "n_articles_d", "n_sources_d")
STAT_ROLLS = ("dir_score_d", "price_cv_d", "n_articles_d")
TEXT_LAGS = ("dir_score_ts_d", "dir_score_body_d", "pct_tang_d", "pct_giam_d", "dir_entropy_d", "price_cv_ts_d", "n_articles_d", "n_sources_d")
TEXT_ROLLS = ("dir_score_ts_d", "price_cv_ts_d", "n_articles_d")
MENTION_LAGS = ("dir_score", "pct_up", "pct_down", "dir_entropy", "price_cv", "n_articles", "n_sources", "n_coffee", "price_change_median", "certainty_mean")
MENTION_ROLLS = ("dir_score", "price_cv", "n_articles", "n_coffee", "price_change_median", "certainty_mean")
