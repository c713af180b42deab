"""Price series, statistics, itemsets and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import boosting as B
from ..operators import models as M
from ..operators import relational as R
from ..operators import rules as U
from ..operators import signals as S
from ..operators import stats as T
from ..operators import windows as W
from ..operators.numbering import numbered
from ..operators.quantiles import exact_quantiles
from ..sources.readers import table
from ..sources.scratch import scratch_path
from . import adapters as A
from .daily_queries import MENTION, POOLED, SQL as DAILY_SQL, mention_daily, mention_daily_pooled, notebook_daily



def series() -> WindowSpec:
    """The one price series of the driver's tables, by date: some thousand days."""
    return W.per_series()

FEATURES = ("dir_score", "dir_entropy", "pct_up", "pct_down", "price_cv", "n_articles")


def price_returns(s: SparkSession, d: str) -> DataFrame:
    return A.prices(s, d).select(
        "date", "price", F.round(W.next_return("price", series()), 6).alias("next_day_ret"), W.next_direction("price", series()).alias("next_day_dir"),
        W.next_label("price", series()).alias("label"), F.round(W.absolute_return("price", series()), 6).alias("abs_ret"))


def price_sma(s: SparkSession, d: str) -> DataFrame:
    return A.prices(s, d).select(
        "date", *(F.round(W.moving_average("price", series(), n), 6).alias(f"sma_{n}") for n in (7, 14, 30)),
        *(F.round(W.moving_average("price", series(), n, full=False), 6).alias(f"smooth_{n}") for n in (7, 14)))


def ohlc_spread(s: SparkSession, d: str) -> DataFrame:
    """Ranges, colours, mean volume, and the spread from the price series in another unit."""
    b = A.bars(s, d).withColumn("open", F.lag("close").over(series()))
    p = A.prices(s, d).select("date", C.rescaled(F.col("price"), 0.25).alias("other"))
    j = b.withColumns({"day_range": F.round(F.col("high") - F.col("low"), 6), "rises": F.when(F.col("close") >= F.col("open"), 1).otherwise(0),
                       "volume_30": F.round(W.moving_average("volume", series(), 30), 6)}).join(p, "date")
    spread = j.withColumn("spread", F.round(F.col("close") - F.col("other"), 6))
    mean = spread.agg(F.round(F.avg("spread"), 4).alias("spread_mean"))
    return spread.crossJoin(F.broadcast(mean)).select("date", "day_range", "rises", "volume_30", "spread", "spread_mean")


def top_moves(s: SparkSession, d: str) -> DataFrame:
    r = price_returns(s, d).filter("abs_ret is not null")
    return r.orderBy(F.desc("abs_ret"), "date").limit(10).select("date", "abs_ret")


def market_clean(s: SparkSession, d: str) -> DataFrame:
    """Printed volumes, percentages and grouped numbers back to doubles."""
    b = A.bars(s, d).select("date", "volume", F.floor("close").alias("close"))
    i = F.dayofyear("date")
    raw = b.select(
        "date", F.when(i % 7 == 0, "-").when(i % 2 == 0, F.concat((F.floor("volume") / 4).cast("string"), F.lit("K"))).otherwise(F.concat(F.floor("volume").cast("string"), F.lit("M"))).alias("vol"),
        F.concat((i / 4).cast("string"), F.lit("%")).alias("chg"), F.concat(F.floor(F.col("close") / 1000).cast("string"), F.lit(","), F.lpad((F.col("close") % 1000).cast("string"), 3, "0")).alias("px"))
    return raw.select("date", C.volume(F.col("vol")).alias("volume"), C.percentage(F.col("chg")).alias("change"), C.grouped_number(F.col("px")).alias("price"))


def _joined(s: SparkSession, d: str) -> DataFrame:
    """Daily features of each target with the price and the next day's return."""
    p = A.mention_prices(s, d).select("date", "price", F.round(W.next_return("price", series()), 6).alias("next_day_ret"))
    return mention_daily(s, d).join(p, "date")


def feature_price_join(s: SparkSession, d: str) -> DataFrame:
    """Trading days drive: features are left-joined to the prices, missing ones filled by medians: the middle of two means of 6 places has 7."""
    f = mention_daily_pooled(s, d).select("date", "dir_score", "certainty_mean")
    out = R.fill_medians(A.mention_prices(s, d).join(f, "date", "left"), ("dir_score", "certainty_mean"))
    return out.select("date", "price", *(F.round(c, 7).alias(c) for c in ("dir_score", "certainty_mean")))


def corr_rank(s: SparkSession, d: str) -> DataFrame:
    r = T.correlations(_joined(s, d), FEATURES, "next_day_ret", keys=("target",))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.abs("r")), "feature")))


def corr_p(s: SparkSession, d: str) -> DataFrame:
    """Correlations with p-values."""
    r = T.correlations(_joined(s, d), FEATURES, "next_day_ret", keys=("target",))
    p = T.p_value(T.pearson_t(F.col("r"), F.col("n")), (F.col("n") - 2).cast("double"))
    return r.withColumn("p", F.round(p, 6)).withColumn("stars", T.stars(F.col("p")))


def lead_lag(s: SparkSession, d: str) -> DataFrame:
    """Feature by lag: correlations with the return, as a table."""
    df = W.add_lags(_joined(s, d), FEATURES, W.per_series("target"))
    lagged = [f"{f}_lag{k}" for f in FEATURES for k in (1, 2, 3)]
    r = T.correlations(df, lagged, "next_day_ret", keys=("target",)).filter("n > 10")
    r = r.select("target", F.regexp_replace("feature", "_lag\\d$", "").alias("feature"), F.right("feature", F.lit(1)).cast("int").alias("lag"), "r")
    return r.groupBy("target", "feature").pivot("lag", [1, 2, 3]).agg(F.first("r")).toDF("target", "feature", "lag1", "lag2", "lag3")


def best_feature(s: SparkSession, d: str) -> DataFrame:
    r = T.correlations(_joined(s, d), FEATURES, "next_day_ret", keys=("target",)).filter("r is not null")
    return r.groupBy("target").agg(F.max_by("feature", F.struct(F.abs("r"), "feature")).alias("feature"), F.max(F.abs("r")).alias("r"))


def ols_line(s: SparkSession, d: str) -> DataFrame:
    return T.line(A.bars(s, d).join(A.prices(s, d), "date"), "price", "close", digits=5)


def spearman(s: SparkSession, d: str) -> DataFrame:
    return T.spearman(A.bars(s, d).join(A.prices(s, d).select("date", F.round("price", -4).alias("price")), "date"), "volume", "price")


SIGNALS = ("SIG_MAJORITY_UP", "SIG_MAJORITY_DOWN", "SIG_SPLIT", "SIG_NEUTRAL", "SIG_HIGH_ENTROPY", "SIG_MANY_SOURCES")


def welch(s: SparkSession, d: str) -> DataFrame:
    return T.welch(S.mention_signals(_joined(s, d)), SIGNALS, "next_day_ret", least=5)


def welch_p(s: SparkSession, d: str) -> DataFrame:
    w = welch(s, d)
    return w.withColumn("p", F.round(T.p_value(F.col("t"), F.col("df")), 6)).withColumn("stars", T.stars(F.col("p")))


def signal_rates(s: SparkSession, d: str) -> DataFrame:
    """How often a signal is on, and the mean return when it is."""
    long = T.unpivoted(S.mention_signals(_joined(s, d)).select("next_day_ret", *SIGNALS), SIGNALS, ["next_day_ret"], "signal")
    return long.groupBy("signal").agg(F.round(F.avg("value"), 6).alias("rate"), F.round(F.avg(F.when(F.col("value") == 1, F.col("next_day_ret"))), 6).alias("mean_ret"))


def bin_quantile(s: SparkSession, d: str) -> DataFrame:
    b = S.quantile_bins(A.bars(s, d), "volume")
    return b.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.round(F.avg("volume"), 6).alias("mean"), F.round(F.avg("close"), 6).alias("close")).withColumn("mid", F.round((F.col("lo") + F.col("hi")) / 2, 6))


def coverage_gaps(s: SparkSession, d: str) -> DataFrame:
    """Days of the order calendar without an order."""
    days = A.prices(s, d).select("date")
    ends = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return every.join(days, "date", "left_anti")


def coverage_stats(s: SparkSession, d: str) -> DataFrame:
    m = mention_daily(s, d).filter("n_articles > 0")
    return m.groupBy("target").agg(
        F.count("*").alias("active_days"), F.round(F.sum("n_coffee") / F.sum("n_articles"), 6).alias("detection_rate"), F.round(F.avg("n_articles"), 6).alias("mean_articles"),
        F.round(F.stddev_samp("n_articles"), 6).alias("std_articles"), F.round(F.avg("n_articles") + F.stddev_samp("n_articles"), 6).alias("high"))


LABELS = ("PRICE_UP", "PRICE_DOWN")


def _transactions(s: SparkSession, d: str) -> DataFrame:
    """Signals of each (target, day) with the next day's label of a price drawn from the date."""
    df = S.disagreement_signals(notebook_daily(s, d))
    return df.withColumns({"PRICE_UP": (F.datediff("date", F.lit("2023-03-11")) * 7 % 5 < 2).cast("int"), "PRICE_DOWN": (F.datediff("date", F.lit("2023-03-11")) * 7 % 5 >= 2).cast("int")})


ITEMS = (*S.DISAGREEMENT_SIGNALS, *LABELS)


def itemsets(s: SparkSession, d: str) -> DataFrame:
    return U.itemsets(_transactions(s, d), ITEMS).select(F.array_join("items", ",").alias("items"), "n", F.round("support", 6).alias("support"))


def _rules(s: SparkSession, d: str) -> DataFrame:
    return U.rules(U.itemsets(_transactions(s, d), ITEMS))


def rules(s: SparkSession, d: str) -> DataFrame:
    return _rules(s, d).withColumns({c: F.array_join(c, ",") for c in ("antecedents", "consequents")})


def top_price_rules(s: SparkSession, d: str) -> DataFrame:
    top = U.top_rules(U.predicting(_rules(s, d), LABELS), 10)
    return top.withColumns({c: F.array_join(c, ",") for c in ("antecedents", "consequents")})


def rule_features(s: SparkSession, d: str) -> DataFrame:
    """Fixed patterns as 0/1 features."""
    t = _transactions(s, d)
    return t.select("target", "date", U.pattern(["MAJORITY_UP", "HIGH_COVERAGE"]).alias("pat_0_UP"), U.pattern(["MANY_SOURCES"]).alias("pat_1_DOWN"))


def _forecast(s: SparkSession, d: str) -> DataFrame:
    """The series with the naive prediction: the last value, moved by half of its last change."""
    p = A.prices(s, d)
    last, before = F.lag("price").over(series()), F.lag("price", 2).over(series())
    return p.select("date", F.col("price").alias("y"), F.round(last + (last - before) / 2, 6).alias("prediction")).filter("prediction is not null")


def model_metrics(s: SparkSession, d: str) -> DataFrame:
    """Errors of two naive models, best first."""
    f = _forecast(s, d)
    flat = f.select("date", "y", F.lag("y").over(series()).alias("prediction")).filter("prediction is not null")
    both = f.withColumn("model", F.lit("drift")).unionByName(flat.withColumn("model", F.lit("last")))
    return M.metrics(both, keys=("model",), digits=1).orderBy("rmse")


def directional_accuracy(s: SparkSession, d: str) -> DataFrame:
    m = M.metrics(_forecast(s, d).withColumn("year", F.year("date")), keys=("year",))
    return m.select("year", "n", "da")


def _model_input(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    df = W.add_rolling(W.add_lags(A.prices(s, d), ("price",), series()), ("price",), series(), n=7)
    df = df.withColumn("target_price", F.lead("price").over(series())).na.drop()
    return df, ["price", "price_lag1", "price_lag2", "price_lag3", "price_roll7"]


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    df, features = _model_input(s, d)
    return *M.split_by_date(df, "1999-12-31", "2000-01-01"), features


LINEAR = {"lasso": M.LASSO_GRID, "ridge": M.RIDGE_GRID, "elastic_net": M.ELASTIC_GRID}


def model_linear(s: SparkSession, d: str) -> DataFrame:
    """Errors of each linear estimator at its best grid point."""
    train, test, features = _split(s, d)
    scored = None
    for name, grid in LINEAR.items():
        alpha, l1 = M.grid_search(train, features, "target_price", grid)
        b0, b, _ = M.fit_gram(train, features, "target_price", alpha, l1)
        one = test.select("date", "target_price", M.predicted(features, b0, b).alias("prediction"), F.lit(name).alias("model"), F.lit(alpha).alias("alpha"), F.lit(l1).alias("l1_ratio"))
        scored = one if scored is None else scored.unionByName(one)
    return M.metrics(scored, "target_price", keys=("model", "alpha", "l1_ratio")).orderBy("rmse")


def _boosted(s: SparkSession, d: str, name: str, grid: tuple) -> DataFrame:
    train, test, features = _split(s, d)
    best = B.best_setting(train, features, "target_price", grid)
    scored = B.predict(test, features, B.fit(train, features, "target_price", best))
    m = M.metrics(scored, "target_price").withColumn("model", F.lit(name))
    return m.withColumns({n: F.lit(getattr(best, n)) for n in ("n_estimators", "max_depth", "learning_rate", "subsample", "num_leaves")})


def model_boosted(s: SparkSession, d: str) -> DataFrame:
    """Errors of trees grown by level at the best of 36 settings."""
    return _boosted(s, d, "by_level", B.BY_LEVEL)


def model_boosted_leaves(s: SparkSession, d: str) -> DataFrame:
    """Errors of trees grown by leaf at the best of 36 settings."""
    return _boosted(s, d, "by_leaf", B.BY_LEAF)


def model_importances(s: SparkSession, d: str) -> DataFrame:
    """Features by the trees' gain and splits, by the size of standardised coefficients, and by permutation."""
    train, test, features = _split(s, d)
    kinds = {"gain": B.fit(train, features, "target_price", B.BY_LEVEL[0]).importances(), "splits": B.fit(train, features, "target_price", B.BY_LEAF[0]).importances()}
    b0, b, standard = M.fit_gram(train, features, "target_price", 1.0, 0.0)
    kinds["coefficient"] = abs(standard)
    rows = [(k, f, float(v)) for k, values in kinds.items() for f, v in zip(features, values)]
    permuted = M.permutation_importance(lambda df: df.withColumn("prediction", M.predicted(features, b0, b)), test, features, "target_price")
    out = s.createDataFrame(rows, "kind string, feature string, importance double").unionByName(permuted.select(F.lit("permutation").alias("kind"), "feature", "importance"))
    return out.select("kind", "feature", F.round("importance", 6).alias("importance")).orderBy("kind", F.desc("importance"))


def model_saved(s: SparkSession, d: str) -> DataFrame:
    """Errors of a fitted pipeline that was stored and loaded again."""
    train, test, features = _split(s, d)
    path = scratch_path(s, "model")
    M.fit_linear(train, features, "target_price", 1.0, 0.0).write().overwrite().save(path)
    return M.metrics(PipelineModel.load(path).transform(test), "target_price", digits=3)


def price_reconstruction(s: SparkSession, d: str) -> DataFrame:
    """Prices from the current one and a predicted difference, or a predicted return: half of the last change."""
    p = A.prices(s, d).select("date", "price", F.lag("price").over(series()).alias("before")).filter("before is not null").withColumnRenamed("price", "current")
    moved = p.withColumns({"delta": (F.col("current") - F.col("before")) / 2, "ret": F.when(F.col("before") != 0, (F.col("current") / F.col("before") - 1) / 2)})
    by_ret = M.reconstructed(moved, "current", "ret", relative=True).select("date", F.round("price", 6).alias("by_return"))
    return M.reconstructed(moved, "current", "delta").select("date", "current", F.round("price", 6).alias("by_difference")).join(by_ret, "date")


def pattern_rules(s: SparkSession, d: str) -> DataFrame:
    """Mined rules as 0/1 features: a row a day and pattern."""
    rows = U.pattern_features(_transactions(s, d), ITEMS, U.predicting(_rules(s, d), LABELS), "PRICE_UP")
    return rows.select("target", "date", "pattern", "hit")


def positive_variation(s: SparkSession, d: str) -> DataFrame:
    """Correlation of the price variation with the return over the days that have one."""
    rows = _joined(s, d).filter("price_cv > 0 and next_day_ret is not null")
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("price_cv"), 6).alias("cv_mean"), F.round(F.corr("price_cv", "next_day_ret"), 6).alias("r"))


def joinable_days(s: SparkSession, d: str) -> DataFrame:
    """Days with features, days with a price beside them, and the articles a day: mean and deviation."""
    m = mention_daily(s, d).filter("n_articles > 0")
    p = A.mention_prices(s, d).select("date", F.lit(1).alias("priced"))
    return m.join(p, "date", "left").groupBy("target").agg(
        F.count("*").alias("days"), F.count("priced").alias("joinable"), F.round(F.avg("n_articles"), 1).alias("mean"), F.round(F.stddev_samp("n_articles"), 1).alias("std"))


def spearman_p(s: SparkSession, d: str) -> DataFrame:
    """A rank correlation with its p-value."""
    r = spearman(s, d)
    return r.withColumn("p", F.round(T.p_value(T.pearson_t(F.col("rho"), F.col("n")), (F.col("n") - 2).cast("double")), 6))


def model_ridge(s: SparkSession, d: str) -> DataFrame:
    """Errors of ridge regression at the grid point that expanding folds choose."""
    train, test, features = _split(s, d)
    alpha, l1 = M.grid_search(train, features, "target_price", M.RIDGE_GRID)
    b0, b, _ = M.fit_gram(train, features, "target_price", alpha, l1)
    scored = test.select("date", "target_price", M.predicted(features, b0, b).alias("prediction"), F.lit(alpha).alias("alpha"))
    return M.metrics(scored, "target_price", keys=("alpha",), digits=1)


def model_rows(s: SparkSession, d: str) -> DataFrame:
    """The rows of the models without a null, and the part that each belongs to."""
    train, test, features = _split(s, d)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("date", "part", "target_price", *(F.round(c, 6).alias(c) for c in features))


def model_folds(s: SparkSession, d: str) -> DataFrame:
    """Rows and ends of the training and the test part of each expanding fold."""
    out = None
    for k, parts in enumerate(M.expanding_folds(A.prices(s, d))):
        for name, rows in zip(("train", "test"), parts):
            one = rows.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.avg("price"), 4).alias("mean")).select(F.lit(k).alias("fold"), F.lit(name).alias("part"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def numbered_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders in order of price: their place among all and among those of their status."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return numbered(numbered(o, order, name="place"), order, ["o_orderstatus"], "place_in_status").select("o_orderkey", "place", "place_in_status")


def aligned_series(s: SparkSession, d: str) -> DataFrame:
    """Two series side by side by position, whatever their dates."""
    bars = numbered(A.bars(s, d).select("date", "close"), ["date"], name="place")
    prices = numbered(A.prices(s, d).select(F.col("date").alias("price_date"), "price"), ["price_date"], name="place")
    return bars.join(prices, "place")


def order_ranks(s: SparkSession, d: str) -> DataFrame:
    """Quantities with the mean rank of ties, among all lines and among those of their status."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_quantity")
    return W.average_ranks(W.average_ranks(rows, "l_quantity", "rank"), "l_quantity", "rank_in_status", ["l_linestatus"]).drop("l_quantity", "l_linestatus")


def long_series(s: SparkSession, d: str) -> DataFrame:
    """Lags, rolling means and returns along all orders, one series of any length."""
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice")

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = W.add_rolling(W.add_lags(df, ("o_totalprice",), w), ("o_totalprice",), w, n=7)
        return df.withColumns({"next_ret": W.next_return("o_totalprice", w), "full_14": W.moving_average("o_totalprice", w, 14), "label": W.next_label("o_totalprice", w)})

    out = W.in_blocks(rows, ["o_orderkey"], compute, back=13, ahead=1, block=4096)
    return out.withColumns({c: F.round(c, 6) for c in ("o_totalprice_roll7", "next_ret", "full_14")})


def price_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all lines' prices."""
    rows = table(s, d, "lineitem").select("l_extendedprice")
    cut = exact_quantiles(rows, {str(p): ("l_extendedprice", p) for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)}, held=1000)
    each = F.array(*(F.struct(F.lit(float(p)).alias("share"), F.lit(v).cast("double").alias("price")) for p, v in cut.items()))
    return s.range(1).select(F.explode(each).alias("c")).select("c.share", F.round("c.price", 6).alias("price"))


QUERIES = {f.__name__: f for f in (
    price_returns, price_sma, ohlc_spread, top_moves, market_clean, feature_price_join, corr_rank, corr_p, lead_lag, best_feature, ols_line, spearman, welch, welch_p, signal_rates,
    bin_quantile, coverage_gaps, coverage_stats, itemsets, rules, top_price_rules, rule_features, model_metrics, directional_accuracy, model_linear, model_boosted,
    model_boosted_leaves, model_importances, model_saved, price_reconstruction, pattern_rules, positive_variation, joinable_days, spearman_p,
    model_ridge, model_rows, model_folds, numbered_orders, aligned_series, order_ranks, price_quantiles, long_series)}

_J = f"""jo AS (SELECT m.*, p.price, p.next_day_ret FROM md m JOIN (SELECT date, price, round(CASE WHEN price <> 0 THEN (lead(price) OVER (ORDER BY date) / price - 1) * 100 END, 6) AS next_day_ret FROM mpx) p USING (date))"""
_JOINED = f"WITH {MENTION}, {A.MENTION_PRICES}, {_J}"
_LONG = "lg AS (UNPIVOT (SELECT target, next_day_ret, {} FROM {}) ON {} INTO NAME feature VALUE value)"


def _doubles(names) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


_CORR = _JOINED + ", " + _LONG.format(_doubles(FEATURES), "jo", ", ".join(FEATURES)) + """,
cr AS (SELECT target, feature, count(*) FILTER (next_day_ret IS NOT NULL) AS n, CASE WHEN stddev_pop(value) FILTER (next_day_ret IS NOT NULL) > 0 THEN round(corr(value, next_day_ret), 6) END AS r FROM lg GROUP BY target, feature)"""
_LAGGED = [f"{f}_lag{k}" for f in FEATURES for k in (1, 2, 3)]
_SIG = DAILY_SQL["mention_signals"].split(" FROM md")[0].rsplit("SELECT target, date, ", 1)[1]
_SIGGED = _JOINED + f", sg AS (SELECT next_day_ret, target, date, {_SIG} FROM jo), ls AS (UNPIVOT (SELECT next_day_ret, {', '.join(SIGNALS)} FROM sg) ON {', '.join(SIGNALS)} INTO NAME signal VALUE value)"
_BASE_NB = DAILY_SQL["notebook_signals"]
_TX = f"""WITH sn AS ({_BASE_NB}), tx AS MATERIALIZED (SELECT *, CAST(((date - DATE '2023-03-11') * 7) % 5 < 2 AS INTEGER) AS PRICE_UP, CAST(((date - DATE '2023-03-11') * 7) % 5 >= 2 AS INTEGER) AS PRICE_DOWN FROM sn),
it AS (SELECT r, list(item ORDER BY item) AS a FROM (UNPIVOT (SELECT row_number() OVER () AS r, * EXCLUDE (target, date) FROM tx) ON COLUMNS(* EXCLUDE r) INTO NAME item VALUE v) WHERE v = 1 GROUP BY r),
p1 AS (SELECT a, i, [a[i]] AS items FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM it)),
p2 AS (SELECT a, j AS i, list_append(items, a[j]) AS items FROM (SELECT a, items, unnest(range(i + 1, len(a) + 1)) AS j FROM p1)),
p3 AS (SELECT list_append(items, a[j]) AS items FROM (SELECT a, items, unnest(range(i + 1, len(a) + 1)) AS j FROM p2)),
fs AS (SELECT items, count(*) AS n FROM (SELECT items FROM p1 UNION ALL SELECT items FROM p2 UNION ALL SELECT items FROM p3) GROUP BY items),
fq AS MATERIALIZED (SELECT items, n, n / CAST((SELECT count(*) FROM tx) AS DOUBLE) AS support FROM fs WHERE n / CAST((SELECT count(*) FROM tx) AS DOUBLE) >= 0.05)"""
_RU = _TX + """, sp AS (SELECT u.a AS antecedents, u.c AS consequents, support FROM (
    SELECT support, unnest(CASE len(items) WHEN 2 THEN [{'a': [items[1]], 'c': [items[2]]}, {'a': [items[2]], 'c': [items[1]]}]
      WHEN 3 THEN [{'a': [items[1]], 'c': items[2:3]}, {'a': [items[2]], 'c': [items[1], items[3]]}, {'a': [items[3]], 'c': items[1:2]},
        {'a': items[1:2], 'c': [items[3]]}, {'a': [items[1], items[3]], 'c': [items[2]]}, {'a': items[2:3], 'c': [items[1]]}] END) AS u FROM fq WHERE len(items) > 1)),
ru AS MATERIALIZED (SELECT antecedents, consequents, round(sp.support, 6) AS support, round(sp.support / a.support, 6) AS confidence, round(sp.support / a.support / c.support, 6) AS lift
  FROM sp JOIN fq a ON a.items = sp.antecedents JOIN fq c ON c.items = sp.consequents WHERE round(sp.support / a.support, 6) >= 0.55)"""
_TOP = """WHERE list_has_any(consequents, ['PRICE_UP', 'PRICE_DOWN']) AND NOT list_has_any(antecedents, ['PRICE_UP', 'PRICE_DOWN'])
      ORDER BY lift DESC, confidence DESC, support DESC, array_to_string(ru.antecedents, ','), array_to_string(ru.consequents, ',')"""
_FC = f"WITH {A.PRICES}, fc AS (SELECT date, price AS y, round(l1 + (l1 - l2) / 2, 6) AS prediction FROM (SELECT *, lag(price) OVER (ORDER BY date) AS l1, lag(price, 2) OVER (ORDER BY date) AS l2 FROM px) WHERE l2 IS NOT NULL)"

SQL = {
    "price_returns": f"""WITH {A.PRICES}, x AS (SELECT *, lead(price) OVER w AS nx, lag(price) OVER w AS pv FROM px WINDOW w AS (ORDER BY date))
      SELECT date, price, round(CASE WHEN price <> 0 THEN (nx / price - 1) * 100 END, 6) AS next_day_ret, CASE WHEN price <> 0 AND (nx / price - 1) * 100 > 0 THEN 1 ELSE 0 END AS next_day_dir,
      CASE WHEN nx > price THEN 'UP' ELSE 'DOWN' END AS label, round(CASE WHEN pv <> 0 THEN abs(price / pv - 1) * 100 END, 6) AS abs_ret FROM x""",
    "price_sma": f"""WITH {A.PRICES} SELECT date, {', '.join(f"round(CASE WHEN count(price) OVER w{n} >= {n} THEN avg(price) OVER w{n} END, 6) AS sma_{n}" for n in (7, 14, 30))},
      {', '.join(f"round(avg(price) OVER w{n}, 6) AS smooth_{n}" for n in (7, 14))} FROM px WINDOW {', '.join(f"w{n} AS (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 14, 30))}""",
    "ohlc_spread": f"""WITH {A.BARS}, {A.PRICES}, b AS (SELECT *, lag(close) OVER (ORDER BY date) AS op, CASE WHEN count(volume) OVER w >= 30 THEN avg(volume) OVER w END AS v30 FROM bars
      WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), j AS (SELECT date, round(high - low, 6) AS day_range, CASE WHEN close >= op THEN 1 ELSE 0 END AS rises, round(v30, 6) AS volume_30,
      round(close - price * 0.25::DOUBLE, 6) AS spread FROM b JOIN px USING (date)) SELECT *, (SELECT round(avg(spread), 4) FROM j) AS spread_mean FROM j""",
    "top_moves": f"""WITH {A.PRICES}, x AS (SELECT date, round(abs(price / lag(price) OVER (ORDER BY date) - 1) * 100, 6) AS abs_ret FROM px) SELECT * FROM x WHERE abs_ret IS NOT NULL ORDER BY abs_ret DESC, date LIMIT 10""",
    "market_clean": f"""WITH {A.BARS} SELECT date, CASE WHEN dayofyear(date) % 7 = 0 THEN 0 WHEN dayofyear(date) % 2 = 0 THEN floor(volume) / 4 * 1000 ELSE floor(volume) * 1000000 END AS volume,
      dayofyear(date) / 4.0::DOUBLE AS change, CAST(floor(close) AS DOUBLE) AS price FROM bars""",
    "feature_price_join": f"""WITH {POOLED}, {A.MENTION_PRICES}, j AS (SELECT x.date, x.price, f.dir_score, f.certainty_mean FROM mpx x LEFT JOIN md f USING (date))
      SELECT date, price, round(coalesce(dir_score, (SELECT median(dir_score) FROM j)), 7) AS dir_score, round(coalesce(certainty_mean, (SELECT median(certainty_mean) FROM j)), 7) AS certainty_mean FROM j""",
    "corr_rank": f"{_CORR} SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC NULLS LAST, feature) AS place FROM cr",
    "lead_lag": f"""{_JOINED}, la AS (SELECT target, next_day_ret, {', '.join(f"CAST(lag({f}, {k}) OVER w AS DOUBLE) AS {f}_lag{k}" for f in FEATURES for k in (1, 2, 3))} FROM jo WINDOW w AS (PARTITION BY target ORDER BY date)),
      {_LONG.format(', '.join(_LAGGED), 'la', ', '.join(_LAGGED))}, cr AS (SELECT target, feature, round(corr(value, next_day_ret), 6) AS r FROM lg GROUP BY 1, 2 HAVING count(*) FILTER (next_day_ret IS NOT NULL) > 10)
      SELECT target, regexp_replace(feature, '_lag[0-9]$', '') AS feature, max(r) FILTER (feature LIKE '%lag1') AS lag1, max(r) FILTER (feature LIKE '%lag2') AS lag2, max(r) FILTER (feature LIKE '%lag3') AS lag3 FROM cr GROUP BY 1, 2""",
    "best_feature": f"{_CORR} SELECT target, feature, abs(r) AS r FROM cr WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, feature DESC) = 1",
    "ols_line": f"WITH {A.BARS}, {A.PRICES} SELECT count(*) AS n, round(regr_slope(price, close), 5) AS slope, round(regr_intercept(price, close), 5) AS intercept, round(corr(price, close), 5) AS r FROM bars JOIN px USING (date)",
    "spearman": f"""WITH {A.BARS}, {A.PRICES}, j AS (SELECT volume, round(price, -4) AS price FROM bars JOIN px USING (date)),
      r AS (SELECT rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS y FROM j)
      SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""",
    "welch": f"""{_SIGGED}, g AS (SELECT signal, count(*) FILTER (value = 1) AS n1, count(*) FILTER (value = 0) AS n0, avg(next_day_ret) FILTER (value = 1) AS m1, avg(next_day_ret) FILTER (value = 0) AS m0,
      var_samp(next_day_ret) FILTER (value = 1) / count(*) FILTER (value = 1) AS s1, var_samp(next_day_ret) FILTER (value = 0) / count(*) FILTER (value = 0) AS s0 FROM ls WHERE next_day_ret IS NOT NULL GROUP BY signal)
      SELECT signal, n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round(m1 - m0, 6) AS diff, round(CASE WHEN s1 + s0 > 0 THEN (m1 - m0) / sqrt(s1 + s0) END, 6) AS t,
      round(CASE WHEN s1 + s0 > 0 THEN (s1 + s0) * (s1 + s0) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)) END, 6) AS df FROM g WHERE n1 > 5 AND n0 > 5""",
    "signal_rates": f"{_SIGGED} SELECT signal, round(avg(value), 6) AS rate, round(avg(next_day_ret) FILTER (value = 1), 6) AS mean_ret FROM ls GROUP BY signal",
    "bin_quantile": f"""WITH {A.BARS}, e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(volume, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 6)))) AS ed FROM bars),
      b AS (SELECT volume, close, ed[k] AS lo, ed[k + 1] AS hi FROM (SELECT *, greatest(len(list_filter(ed, lambda x: x < round(volume, 6))), 1) AS k FROM bars, e))
      SELECT lo, hi, count(*) AS n, round(avg(volume), 6) AS mean, round(avg(close), 6) AS close, round((lo + hi) / 2, 6) AS mid FROM b GROUP BY lo, hi""",
    "coverage_gaps": f"WITH {A.PRICES} SELECT CAST(day AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM px), (SELECT max(date) FROM px), INTERVAL 1 DAY)) AS day) WHERE CAST(day AS DATE) NOT IN (SELECT date FROM px)",
    "coverage_stats": f"""WITH {MENTION} SELECT target, count(*) AS active_days, round(sum(n_coffee) / CAST(sum(n_articles) AS DOUBLE), 6) AS detection_rate, round(avg(n_articles), 6) AS mean_articles,
      round(stddev_samp(n_articles), 6) AS std_articles, round(avg(n_articles) + stddev_samp(n_articles), 6) AS high FROM md WHERE n_articles > 0 GROUP BY target""",
    "itemsets": f"{_TX} SELECT array_to_string(items, ',') AS items, n, round(support, 6) AS support FROM fq",
    "rules": f"{_RU} SELECT * REPLACE (array_to_string(antecedents, ',') AS antecedents, array_to_string(consequents, ',') AS consequents) FROM ru",
    "top_price_rules": f"""{_RU} SELECT * REPLACE (array_to_string(antecedents, ',') AS antecedents, array_to_string(consequents, ',') AS consequents) FROM ru
      WHERE list_has_any(consequents, ['PRICE_UP', 'PRICE_DOWN']) AND NOT list_has_any(antecedents, ['PRICE_UP', 'PRICE_DOWN'])
      ORDER BY lift DESC, confidence DESC, support DESC, array_to_string(ru.antecedents, ','), array_to_string(ru.consequents, ',') LIMIT 10""",
    "rule_features": f"{_TX} SELECT target, date, CAST(MAJORITY_UP = 1 AND HIGH_COVERAGE = 1 AS INTEGER) AS \"pat_0_UP\", MANY_SOURCES AS \"pat_1_DOWN\" FROM tx",
    "model_metrics": f"""{_FC}, bt AS (SELECT 'drift' AS model, * FROM fc UNION ALL SELECT 'last', date, y, p FROM (SELECT date, y, lag(y) OVER (ORDER BY date) AS p FROM fc) WHERE p IS NOT NULL),
      h AS (SELECT *, lag(y) OVER (PARTITION BY model ORDER BY date) AS b FROM bt)
      SELECT model, count(*) AS n, round(avg(abs(y - prediction)), 1) AS mae, round(avg((y - prediction) ** 2), 1) AS mse, round(sqrt(avg((y - prediction) ** 2)), 1) AS rmse,
      round(1 - sum((y - prediction) ** 2) / (var_pop(y) * count(*)), 1) AS r2, round(avg(CASE WHEN b IS NOT NULL THEN CAST(sign(y - b) = sign(prediction - b) AS INTEGER) END), 1) AS da FROM h GROUP BY model""",
    "directional_accuracy": f"""{_FC}, h AS (SELECT *, year(date) AS year, lag(y) OVER (PARTITION BY year(date) ORDER BY date) AS b FROM fc)
      SELECT year, count(*) AS n, round(avg(CASE WHEN b IS NOT NULL THEN CAST(sign(y - b) = sign(prediction - b) AS INTEGER) END), 6) AS da FROM h GROUP BY year""",
    "price_reconstruction": f"""WITH {A.PRICES}, x AS (SELECT date, price AS current, lag(price) OVER (ORDER BY date) AS before FROM px)
      SELECT date, current, round(current + (current - before) / 2, 6) AS by_difference, round(CASE WHEN before <> 0 THEN current * (1 + (current / before - 1) / 2) END, 6) AS by_return FROM x WHERE before IS NOT NULL""",
    "pattern_rules": f"""{_RU}, tp AS (SELECT *, row_number() OVER () - 1 AS k FROM (SELECT * FROM ru {_TOP} LIMIT 10)),
      na AS (SELECT printf('pat_%02d_%s_c%dp', k, CASE WHEN list_contains(consequents, 'PRICE_UP') THEN 'up' ELSE 'down' END, CAST(round(confidence * 100) AS INTEGER)) AS pattern, antecedents FROM tp),
      hd AS (SELECT target, date, list_filter([{", ".join(f"CASE WHEN {x} = 1 THEN '{x}' END" for x in ITEMS)}], lambda x: x IS NOT NULL) AS held FROM tx)
      SELECT target, date, pattern, CAST(list_has_all(held, antecedents) AS INTEGER) AS hit FROM hd, na""",
    "positive_variation": f"{_JOINED} SELECT target, count(*) AS n, round(avg(price_cv), 6) AS cv_mean, round(corr(price_cv, next_day_ret), 6) AS r FROM jo WHERE price_cv > 0 AND next_day_ret IS NOT NULL GROUP BY target",
    "joinable_days": f"""WITH {MENTION}, {A.MENTION_PRICES} SELECT target, count(*) AS days, count(p.date) AS joinable, round(avg(n_articles), 1) AS mean, round(stddev_samp(n_articles), 1) AS std
      FROM md LEFT JOIN mpx p USING (date) WHERE n_articles > 0 GROUP BY target""",
}


def _p(t: str, df: str) -> str:
    """Two-sided p-value by Simpson's rule: one minus the density of t = sqrt(df) tan(u) between its ends."""
    steps, end = 4000, f"atan(abs({t}) / sqrt({df}))"
    weights = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weights}) * CAST(pow(cos({end} * i / {steps}), {df} - 1) AS DOUBLE))) * {end} / {steps} / 3"
    return f"round(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {area}, 6)"


def _with_p(rows: str, t: str, df: str, stars: bool = True) -> str:
    """rows with p, and its stars."""
    graded = "CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars"
    return f"SELECT * EXCLUDE (tt, ff){', ' + graded if stars else ''} FROM (SELECT *, {_p('tt', 'ff')} AS p FROM (SELECT *, {t} AS tt, {df} AS ff FROM ({rows})))"


_PEARSON = "CASE WHEN n > 2 AND abs({0}) < 1 THEN {0} * sqrt((n - 2) / (1 - {0} * {0})) END"
SQL["corr_p"] = _with_p(f"{_CORR} SELECT * FROM cr", _PEARSON.format("r"), "CASE WHEN n > 2 THEN CAST(n - 2 AS DOUBLE) END")
SQL["welch_p"] = _with_p(SQL["welch"], "t", "df")
SQL["spearman_p"] = _with_p(SQL["spearman"], _PEARSON.format("rho"), "CASE WHEN n > 2 THEN CAST(n - 2 AS DOUBLE) END", stars=False)

_MODEL = f"""WITH {A.PRICES}, x AS (SELECT date, price, lag(price, 1) OVER w AS price_lag1, lag(price, 2) OVER w AS price_lag2, lag(price, 3) OVER w AS price_lag3, lead(price) OVER w AS target_price,
  avg(price) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS price_roll7 FROM px WINDOW w AS (ORDER BY date)),
mi AS (SELECT * FROM x WHERE price_lag3 IS NOT NULL AND target_price IS NOT NULL)"""
SQL["model_rows"] = f"""{_MODEL} SELECT date, CASE WHEN date <= DATE '1999-12-31' THEN 'train' ELSE 'test' END AS part, target_price, round(price, 6) AS price, round(price_lag1, 6) AS price_lag1,
  round(price_lag2, 6) AS price_lag2, round(price_lag3, 6) AS price_lag3, round(price_roll7, 6) AS price_roll7 FROM mi"""
SQL["model_folds"] = f"""WITH {A.PRICES}, p AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, count(*) OVER () // 6 AS size FROM px),
  f AS (SELECT p.*, CAST(k AS INTEGER) AS fold, n - (5 - k) * size AS start FROM p, range(0, 5) t(k)),
  g AS (SELECT *, CASE WHEN i < start THEN 'train' ELSE 'test' END AS part FROM f WHERE i < start + size)
  SELECT fold, part, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(price), 4) AS mean FROM g GROUP BY fold, part"""
SQL["numbered_orders"] = """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place_in_status FROM orders"""
SQL["aligned_series"] = f"""WITH {A.BARS}, {A.PRICES} SELECT place, b.date, close, p.date AS price_date, price FROM (SELECT *, row_number() OVER (ORDER BY date) AS place FROM bars) b
  JOIN (SELECT *, row_number() OVER (ORDER BY date) AS place FROM px) p USING (place)"""
SQL["order_ranks"] = """SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank,
  rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0::DOUBLE AS rank_in_status FROM lineitem"""
SQL["price_quantiles"] = "SELECT CAST(share AS DOUBLE) AS share, round(price, 6) AS price FROM (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]) AS share, unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])) AS price FROM lineitem)"


def _ridge(alphas: tuple[float, ...], features: tuple[str, ...]) -> str:
    """Residuals z.r of ridge regression for each (fold, alpha); fold 5 is fitted on all training rows.

    By Gram-Schmidt on the standardised training rows and one row a feature that holds the root of alpha: each step takes a feature out of the later ones and out of the target.
    """
    k = range(1, len(features) + 1)
    xs = ", ".join(f"x{i}" for i in k)
    named = ", ".join(f"{f} AS x{i}" for i, f in enumerate(features, 1))
    mean = lambda c: f"avg({c}) FILTER (kind = 'train') OVER f"
    deviation = lambda c: f"coalesce(nullif(stddev_pop({c}) FILTER (kind = 'train') OVER f, 0), 1)"
    steps, before = [], "z0"
    for j in k:
        taken = lambda c: f"{c} - x{j} * (sum({c} * x{j}) FILTER (kind <> 'test') OVER w / sum(x{j} * x{j}) FILTER (kind <> 'test') OVER w) AS {c}"  # noqa: B023, E731
        later = "".join(f", {taken(f'x{i}')}" for i in k if i > j)
        steps.append(f"z{j} AS (SELECT fold, alpha, kind, date, y, {taken('r')}{''.join(f', x{i}' for i in k if i <= j)}{later} FROM {before} WINDOW w AS (PARTITION BY fold, alpha))")
        before = f"z{j}"
    return f"""tr AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM mi WHERE date <= DATE '1999-12-31'),
fo AS (SELECT CAST(k AS INTEGER) AS fold, CASE WHEN i < n - (5 - k) * (n // 6) THEN 'train' ELSE 'test' END AS kind, date, target_price AS y, {named} FROM tr, range(0, 5) t(k) WHERE i < n - (4 - k) * (n // 6)
  UNION ALL SELECT 5, CASE WHEN date <= DATE '1999-12-31' THEN 'train' ELSE 'test' END, date, target_price, {', '.join(features)} FROM mi),
st AS (SELECT fold, kind, date, y, y - {mean('y')} AS r, {', '.join(f'(x{i} - {mean(f"x{i}")}) / {deviation(f"x{i}")} AS x{i}' for i in k)} FROM fo WINDOW f AS (PARTITION BY fold)),
al AS (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in alphas)}]) AS alpha),
z0 AS (SELECT fold, alpha, kind, date, y, r, {xs} FROM st, al UNION ALL
  SELECT fold, alpha, 'size', NULL, NULL, 0, {', '.join(f"CASE WHEN j = {i} THEN sqrt(alpha) ELSE 0 END" for i in k)} FROM (SELECT DISTINCT fold FROM fo), al, range(1, {len(features) + 1}) t(j)),
{", ".join(steps)}, z AS MATERIALIZED (SELECT fold, alpha, date, y, r FROM {before} WHERE kind = 'test')"""


SQL["model_ridge"] = f"""{_MODEL}, {_ridge(tuple(a for a, _ in M.RIDGE_GRID), ("price", "price_lag1", "price_lag2", "price_lag3", "price_roll7"))},
be AS (SELECT arg_min(alpha, e) AS alpha FROM (SELECT alpha, avg(e) AS e FROM (SELECT alpha, fold, avg(abs(r)) AS e FROM z WHERE fold < 5 GROUP BY 1, 2) GROUP BY 1)),
h AS (SELECT alpha, y, r, lag(y) OVER (ORDER BY date) AS b FROM z JOIN be USING (alpha) WHERE fold = 5)
SELECT alpha, count(*) AS n, round(avg(abs(r)), 1) AS mae, round(avg(r * r), 1) AS mse, round(sqrt(avg(r * r)), 1) AS rmse, round(1 - sum(r * r) / (var_pop(y) * count(*)), 1) AS r2,
  round(avg(CASE WHEN b IS NOT NULL THEN CAST(sign(y - b) = sign(y - r - b) AS INTEGER) END), 1) AS da FROM h GROUP BY alpha"""
SQL["long_series"] = """SELECT o_orderkey, o_totalprice, lag(o_totalprice, 1) OVER w AS o_totalprice_lag1, lag(o_totalprice, 2) OVER w AS o_totalprice_lag2, lag(o_totalprice, 3) OVER w AS o_totalprice_lag3,
  round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS o_totalprice_roll7,
  round(CASE WHEN o_totalprice <> 0 THEN (lead(o_totalprice) OVER w / o_totalprice - 1) * 100 END, 6) AS next_ret,
  round(CASE WHEN count(o_totalprice) OVER f >= 14 THEN avg(o_totalprice) OVER f END, 6) AS full_14, CASE WHEN lead(o_totalprice) OVER w > o_totalprice THEN 'UP' ELSE 'DOWN' END AS label
  FROM orders WINDOW w AS (ORDER BY o_orderkey), f AS (ORDER BY o_orderkey ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""
