"""Articles and extracted facts to daily features, lags and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import signals as S
from ..operators.windows import add_lags, add_rolling, per_series
from . import adapters as A

def _rounded(df: DataFrame, *parts: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if any(p in c for p in parts)})


def text_daily(s: SparkSession, d: str) -> DataFrame:
    return D.text_daily(A.article_facts(s, d))


def stat_daily(s: SparkSession, d: str) -> DataFrame:
    return D.stat_daily(A.article_facts(s, d))


def notebook_daily(s: SparkSession, d: str) -> DataFrame:
    return D.disagreement_daily(A.disagreement_facts(s, d))


def mention_daily(s: SparkSession, d: str) -> DataFrame:
    return D.mention_daily(A.mentions(s, d))


def mention_daily_pooled(s: SparkSession, d: str) -> DataFrame:
    return D.mention_daily(A.mentions(s, d), by_target=False)


def text_lag_roll(s: SparkSession, d: str) -> DataFrame:
    w = per_series("target")
    df = add_rolling(add_lags(text_daily(s, d), D.TEXT_LAGS, w), D.TEXT_ROLLS, w)
    return _rounded(df, "_roll")


def stat_lag_roll(s: SparkSession, d: str) -> DataFrame:
    w = per_series("target")
    df = add_rolling(add_lags(stat_daily(s, d), D.STAT_LAGS, w), D.STAT_ROLLS, w)
    return _rounded(df, "_roll")


def mention_lag_roll(s: SparkSession, d: str) -> DataFrame:
    w = per_series("target")
    df = add_rolling(add_lags(mention_daily(s, d), D.MENTION_LAGS, w), D.MENTION_ROLLS, w, shifted=False)
    return _rounded(df, "_roll")


def text_signals(s: SparkSession, d: str) -> DataFrame:
    df = S.text_signals(text_daily(s, d))
    return df.select("target", "date", *(c for c in df.columns if c.startswith("SIG_")))


def stat_signals(s: SparkSession, d: str) -> DataFrame:
    df = S.stat_signals(stat_daily(s, d))
    return df.select("target", "date", *(c for c in df.columns if c.startswith("SIG_")))


def mention_signals(s: SparkSession, d: str) -> DataFrame:
    df = S.mention_signals(mention_daily(s, d))
    return df.select("target", "date", *(c for c in df.columns if c.startswith("SIG_")))


def notebook_signals(s: SparkSession, d: str) -> DataFrame:
    return S.disagreement_signals(notebook_daily(s, d)).select("target", "date", *S.DISAGREEMENT_SIGNALS)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Articles to daily text features with lags, rolling means and signals in one plan."""
    return S.text_signals(text_lag_roll(s, d))


QUERIES = {f.__name__: f for f in (
    text_daily, stat_daily, notebook_daily, mention_daily, mention_daily_pooled, text_lag_roll, stat_lag_roll, mention_lag_roll,
    text_signals, stat_signals, mention_signals, notebook_signals, flagship)}


def _h(*p: str) -> str:
    """Entropy over positive shares."""
    return "abs(-(" + " + ".join(f"CASE WHEN {x} > 0 THEN ({x}) * log2({x}) ELSE 0 END" for x in p) + "))"


def _cv(c: str) -> str:
    return f"CASE WHEN count({c}) >= 2 AND avg({c}) > 0 THEN stddev_samp({c}) / avg({c}) ELSE 0.0::DOUBLE END"


def _share(c: str) -> str:
    return f"avg(CAST({c} AS INTEGER))"


TEXT = A.FACTS + f""",
t0 AS (SELECT target, date, count(*) AS n_articles_d, count(DISTINCT domain) AS n_sources_d, {_share('ts_up')} AS u, {_share('ts_down')} AS v, {_share('ts_stable')} AS x,
  round(avg(body_dir_score), 6) AS dir_score_body_d, median(price) AS price_median_ts_d, round({_cv('price')}, 6) AS price_cv_ts_d,
  round({_share('price IS NOT NULL')}, 6) AS pct_has_price_d FROM facts WHERE target IS NOT NULL GROUP BY target, date),
td AS (SELECT * EXCLUDE (u, v, x), round(u, 6) AS pct_tang_d, round(v, 6) AS pct_giam_d, round(x, 6) AS pct_on_dinh_d, round(u - v, 6) AS dir_score_ts_d,
  round({_h('u', 'v', 'x')}, 6) AS dir_entropy_d FROM t0)"""

_REST = "greatest(0.0::DOUBLE, 1 - u - v)"
_PICK = lambda f: f"CASE WHEN count(title_price) >= 2 THEN {f('title_price')} ELSE {f('price')} END"
STAT = A.FACTS + f""",
s0 AS (SELECT target, date, count(*) AS n_articles_d, count(DISTINCT domain) AS n_sources_d, round({_share('has_price')}, 6) AS pct_has_price_d,
  round({_share('has_noise')}, 6) AS pct_noise_d, round({_PICK(lambda c: f'avg({c})')}, 6) AS price_median_d, round({_PICK(_cv)}, 6) AS price_cv_d,
  {_PICK(lambda c: f'CASE WHEN count({c}) >= 2 THEN max({c}) - min({c}) ELSE 0.0::DOUBLE END')} AS price_range_d, round(avg(change_mean), 6) AS avg_change_d,
  {_share('title_up')} AS u, {_share('title_down')} AS v, avg(dir_score) AS s, CAST(sum(n_up) AS BIGINT) AS kw_tang_d, CAST(sum(n_down) AS BIGINT) AS kw_giam_d,
  CAST(sum(n_stable + n_flat) AS BIGINT) AS kw_stable_d FROM facts WHERE target IS NOT NULL GROUP BY target, date),
sd AS (SELECT * EXCLUDE (u, v, s), round(0.6::DOUBLE * (u - v) + 0.4::DOUBLE * s, 6) AS dir_score_d, round(u, 6) AS title_tang_pct_d, round(v, 6) AS title_giam_pct_d,
  round({_h('u', 'v', _REST)}, 6) AS dir_entropy_d FROM s0)"""


def _mention(keys: str, where: str, days: str, on: str) -> str:
    part = lambda c: f"CASE WHEN n_coffee > 0 THEN {c}::DOUBLE / n_coffee ELSE 0.0::DOUBLE END"
    up, down, stable, mixed = (part(f"n_{x}") for x in ("UP", "DOWN", "STABLE", "MIXED"))
    other = part("(n_coffee - n_UP - n_DOWN - n_STABLE - n_MIXED)")
    return A.MENTIONS + f""",
m0 AS (SELECT {keys}, count(*) AS n_articles, count(*) FILTER (relevant) AS n_coffee, count(DISTINCT domain) AS n_sources,
  {', '.join(f"count(*) FILTER (relevant AND direction = '{x}') AS n_{x}" for x in ('UP', 'DOWN', 'STABLE', 'MIXED'))},
  median(price) FILTER (relevant) AS price_median, round(avg(price) FILTER (relevant), 6) AS price_mean, count(price) FILTER (relevant) AS n_price,
  round(CASE WHEN count(price) FILTER (relevant) >= 2 AND avg(price) FILTER (relevant) > 0 THEN stddev_samp(price) FILTER (relevant) / avg(price) FILTER (relevant) ELSE 0.0::DOUBLE END, 6) AS cv,
  median(price_change) FILTER (relevant) AS price_change_median, round(avg(certainty) FILTER (relevant), 6) AS certainty_mean,
  round(avg(CAST(certainty <= 2 AS INTEGER)) FILTER (relevant), 6) AS high FROM men WHERE date IS NOT NULL {where} GROUP BY {keys}),
days AS ({days}),
m1 AS (SELECT days.*, coalesce(n_articles, 0) AS n_articles, coalesce(n_coffee, 0) AS n_coffee, coalesce(n_sources, 0) AS n_sources, n_UP, n_DOWN, n_STABLE, n_MIXED, n_price,
  price_median, price_mean, cv, price_change_median, certainty_mean, high FROM days LEFT JOIN m0 USING ({on})),
md AS (SELECT {keys}, n_articles, n_coffee, n_sources, round({up}, 6) AS pct_up, round({down}, 6) AS pct_down, round({stable}, 6) AS pct_stable, round({mixed}, 6) AS pct_mixed,
  round({up} - {down}, 6) AS dir_score, round({_h(up, down, stable, mixed, other)}, 6) AS dir_entropy, price_median, price_mean, coalesce(cv, 0) AS price_cv,
  round({part('n_price')}, 6) AS pct_has_price, price_change_median, certainty_mean, coalesce(high, 0) AS pct_high_cert FROM m1)"""


_CALENDAR = "SELECT CAST(unnest(generate_series((SELECT min(date) FROM men), (SELECT max(date) FROM men), INTERVAL 1 DAY)) AS DATE) AS date"
MENTION = _mention("target, date", "AND target IS NOT NULL", f"SELECT target, date FROM (SELECT DISTINCT target FROM men WHERE date IS NOT NULL AND target IS NOT NULL), ({_CALENDAR})", "target, date")
POOLED = _mention("date", "", _CALENDAR, "date")

_SH = lambda x: f"coalesce(count(*) FILTER (direction = '{x}') / CAST(nullif(count(direction), 0) AS DOUBLE), 0)"
NOTEBOOK = A.DISAGREEMENT + f""",
n0 AS (SELECT target, date, count(*) AS n_articles, count(DISTINCT domain) AS n_sources, count(price) AS n_with_price, round({_cv('price')}, 6) AS disagr_score,
  CAST(CASE WHEN count(price) >= 2 THEN max(price) - min(price) ELSE 0 END AS BIGINT) AS price_range, median(price) AS median_price,
  {_SH('UP')} AS u, {_SH('DOWN')} AS v, {_SH('STABLE')} AS x, CASE WHEN count(price) > 0 THEN round(avg(certainty), 6) END AS avg_certainty,
  {', '.join(f"count(*) FILTER (certainty = {k}) / CAST(count(certainty) AS DOUBLE) AS c{k}" for k in range(1, 6))},
  round(count(price) / CAST(count(*) AS DOUBLE), 6) AS pct_has_price FROM ext WHERE target IS NOT NULL GROUP BY target, date),
nd AS (SELECT * EXCLUDE (u, v, x, c1, c2, c3, c4, c5), round(u, 6) AS pct_up, round(v, 6) AS pct_down, round(x, 6) AS pct_stable, round({_h('u', 'v', 'x')}, 6) AS dir_entropy,
  round({_h('c1', 'c2', 'c3', 'c4', 'c5')}, 6) AS cert_entropy FROM n0)"""


def _lag_roll(lags, rolls, frame: str) -> str:
    out = [f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in lags for k in (1, 2, 3)]
    out += [f"round(avg({c}) OVER (PARTITION BY target ORDER BY date ROWS BETWEEN {frame}), 6) AS {c}_roll3" for c in rolls]
    return "SELECT *, " + ", ".join(out) + " FROM {} WINDOW w AS (PARTITION BY target ORDER BY date)"


_SHIFTED, _SAME = "3 PRECEDING AND 1 PRECEDING", "2 PRECEDING AND CURRENT ROW"


def _i(c: str) -> str:
    return f"CAST(coalesce({c}, false) AS INTEGER)"


def _signals(source: str, cv: str, up: str, down: str, score: str, low: str) -> str:
    return f""",
q AS (SELECT target AS qt, round(quantile_cont({cv}, 0.75), 6) AS hi, round(quantile_cont({cv}, 0.25), 6) AS lo, round(quantile_cont(dir_entropy_d, 0.75), 6) AS qe,
  round(quantile_cont(n_articles_d, 0.5), 6) AS qn FROM {source} GROUP BY target),
sg AS (SELECT t.*, {_i(f'{cv} > hi')} AS SIG_HIGH_DISAGR, {_i(f'{cv} {low} lo')} AS SIG_LOW_DISAGR, {_i(f'{up} > 0.5')} AS SIG_MAJORITY_UP, {_i(f'{down} > 0.5')} AS SIG_MAJORITY_DOWN,
  {_i(f'{up} > 0.25 AND {down} > 0.25')} AS SIG_SPLIT, {_i(f'{score} > 0.15')} AS SIG_BULLISH, {_i(f'{score} < -0.15')} AS SIG_BEARISH,
  {_i(f'{score} BETWEEN -0.15 AND 0.15')} AS SIG_NEUTRAL, {_i('dir_entropy_d > qe')} AS SIG_HIGH_ENTROPY, {_i('n_sources_d >= 3')} AS SIG_MANY_SOURCES,
  {_i('n_articles_d >= qn')} AS SIG_MANY_ARTICLES, {_i(f'{cv} > hi AND n_sources_d >= 3')} AS SIG_CONFIDENT_DISAGR FROM {source} t JOIN q ON t.target = q.qt)"""


_TEXT_SIG = ("price_cv_ts_d", "pct_tang_d", "pct_giam_d", "dir_score_ts_d", "<=")
_SIGS = "target, date, COLUMNS('^SIG_')"
SQL = {
    "text_daily": f"WITH {TEXT} SELECT * FROM td",
    "stat_daily": f"WITH {STAT} SELECT * FROM sd",
    "notebook_daily": f"WITH {NOTEBOOK} SELECT * FROM nd",
    "mention_daily": f"WITH {MENTION} SELECT * FROM md",
    "mention_daily_pooled": f"WITH {POOLED} SELECT * FROM md",
    "text_lag_roll": f"WITH {TEXT} " + _lag_roll(D.TEXT_LAGS, D.TEXT_ROLLS, _SHIFTED).format("td"),
    "stat_lag_roll": f"WITH {STAT} " + _lag_roll(D.STAT_LAGS, D.STAT_ROLLS, _SHIFTED).format("sd"),
    "mention_lag_roll": f"WITH {MENTION} " + _lag_roll(D.MENTION_LAGS, D.MENTION_ROLLS, _SAME).format("md"),
    "text_signals": f"WITH {TEXT} {_signals('td', *_TEXT_SIG)} SELECT {_SIGS} FROM sg",
    "stat_signals": f"WITH {STAT} {_signals('sd', 'price_cv_d', 'title_tang_pct_d', 'title_giam_pct_d', 'dir_score_d', '<')} SELECT {_SIGS} FROM sg",
    "mention_signals": f"""WITH {MENTION} SELECT target, date, {_i('pct_up > 0.5')} AS SIG_MAJORITY_UP, {_i('pct_down > 0.5')} AS SIG_MAJORITY_DOWN,
      {_i('pct_up > 0.3 AND pct_down > 0.3')} AS SIG_SPLIT, {_i('dir_score > 0.2 AND n_coffee >= 2')} AS SIG_BULLISH, {_i('dir_score < -0.2 AND n_coffee >= 2')} AS SIG_BEARISH,
      {_i('abs(dir_score) <= 0.1')} AS SIG_NEUTRAL, {_i('dir_entropy > 1.0')} AS SIG_HIGH_ENTROPY, {_i('n_sources >= 5')} AS SIG_MANY_SOURCES,
      {_i('n_articles >= 8')} AS SIG_MANY_ARTICLES, {_i('pct_high_cert > 0.7')} AS SIG_HIGH_CERT FROM md""",
    "notebook_signals": f"""WITH {NOTEBOOK}, q AS (SELECT round(quantile_cont(disagr_score, 0.75), 6) AS hi, round(quantile_cont(disagr_score, 0.25), 6) AS lo,
      round(quantile_cont(cert_entropy, 0.5), 6) AS qc, round(quantile_cont(n_articles, 0.5), 6) AS qn FROM nd)
      SELECT target, date, {_i('disagr_score > hi')} AS HIGH_DISAGR, {_i('disagr_score < lo')} AS LOW_DISAGR, {_i('pct_up > 0.5')} AS MAJORITY_UP, {_i('pct_down > 0.5')} AS MAJORITY_DOWN,
      {_i('pct_up > 0.3 AND pct_down > 0.3')} AS SPLIT_SIGNAL, {_i('pct_up > 0.75')} AS STRONG_UP, {_i('pct_down > 0.75')} AS STRONG_DOWN, {_i('avg_certainty <= 2')} AS HIGH_CERTAINTY,
      {_i('avg_certainty >= 3.5')} AS LOW_CERTAINTY, {_i('cert_entropy > qc')} AS MIXED_CERTAINTY, {_i('n_sources >= 3')} AS MANY_SOURCES, {_i('n_articles >= qn')} AS MANY_ARTICLES,
      {_i('pct_has_price > 0.7')} AS HIGH_COVERAGE FROM nd, q""",
    "flagship": f"WITH {TEXT}, lr AS ({_lag_roll(D.TEXT_LAGS, D.TEXT_ROLLS, _SHIFTED).format('td')}) {_signals('lr', *_TEXT_SIG)} SELECT * FROM sg",
}
