"""Relational, window, signal, statistic and rule operators on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import daily as D
from sparkloom.operators import boosting as B
from sparkloom.operators import models as M
from sparkloom.operators import relational as R
from sparkloom.operators import rules as U
from sparkloom.operators import signals as S
from sparkloom.operators import stats as T
from sparkloom.operators import windows as W
from sparkloom.sources import extract, readers, writers
from sparkloom.streaming import ingest


def series(spark, values, first="2024-01-01"):
    d = dt.date.fromisoformat(first)
    return spark.createDataFrame([("a", d + dt.timedelta(i), v) for i, v in enumerate(values)], "target string, date date, x double")


def column(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def test_rolling_shifted_or_not(spark):
    df = series(spark, [10.0, 20.0, 30.0, 40.0])
    w = W.per_series("target")
    assert column(W.add_rolling(df, ["x"], w), "x_roll3") == [None, 10, 15, 20]
    assert column(W.add_rolling(df, ["x"], w, shifted=False), "x_roll3") == [10, 15, 20, 30]
    assert column(df.withColumn("m", W.moving_average("x", w, 3)), "m") == [None, None, 20, 30]


def test_lag_is_positional(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, d), float(10 * d)) for d in (1, 2, 5)], "target string, date date, x double")
    assert column(W.add_lags(df, ["x"], W.per_series("target"), (1,)), "x_lag1") == [None, 10, 20]


def test_returns_guard_zero(spark):
    w = W.per_series("target")
    df = series(spark, [100.0, 110.0, 110.0, 0.0, 100.0])
    df = df.select("date", W.next_return("x", w).alias("r"), W.next_direction("x", w).alias("d"), W.next_label("x", w).alias("l"))
    assert [None if r is None else round(r, 6) for r in column(df, "r")] == [10, 0, -100, None, None]
    assert column(df, "d") == [1, 0, 0, 0, 0] and column(df, "l") == ["UP", "DOWN", "DOWN", "UP", "DOWN"]


def test_variation(spark):
    df = spark.createDataFrame([(1, 90000.0), (2, 90000.0), (2, 100000.0), (3, None)], "k int, p double")
    got = {r.k: r.v for r in df.groupBy("k").agg(D.variation(F.col("p")).alias("v")).collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.074432, abs=1e-6), 3: 0.0}


def test_mention_daily_fills_the_calendar(spark):
    rows = [(dt.date(2024, 1, 2), "a", "s1", "UP", 5.0, 1.0, 1, True), (dt.date(2024, 1, 2), "a", "s2", "UP", 7.0, None, 3, True), (dt.date(2024, 1, 2), "a", "s2", "DOWN", None, None, 2, True),
            (dt.date(2024, 1, 2), "a", "s3", "NONE", None, None, 5, True), (dt.date(2024, 1, 3), "a", "s1", "UP", 1.0, None, 1, False), (dt.date(2024, 1, 3), None, "s1", "UP", 1.0, None, 1, True)]
    facts = spark.createDataFrame(rows, "date date, target string, domain string, direction string, price double, price_change double, certainty int, relevant boolean")
    got = {r.date.day: r for r in D.mention_daily(facts, "2024-01-01", "2024-01-03").collect()}
    assert set(got) == {1, 2, 3} and got[2].dir_entropy == 1.5 and got[2].dir_score == 0.25
    assert (got[1].n_articles, got[1].price_median, got[1].pct_high_cert) == (0, None, 0.0) and (got[3].n_articles, got[3].n_coffee) == (1, 0)
    pooled = {r.date.day: r.n_articles for r in D.mention_daily(facts, "2024-01-01", "2024-01-03", by_target=False).collect()}
    assert pooled == {1: 0, 2: 4, 3: 2}


def test_low_disagreement_strict_or_not(spark):
    base = {"price_cv_d": 0.0, "title_tang_pct_d": 0.6, "title_giam_pct_d": 0.3, "dir_score_d": 0.15, "dir_entropy_d": 0.0, "n_articles_d": 1, "n_sources_d": 3}
    df = spark.createDataFrame([{**base, "target": "a", "date": dt.date(2024, 1, i + 1), "price_cv_d": v} for i, v in enumerate([0.0, 0.0, 0.0, 1.0])])
    assert column(S.stat_signals(df), "SIG_LOW_DISAGR") == [0, 0, 0, 0]
    text = df.toDF(*({"price_cv_d": "price_cv_ts_d", "title_tang_pct_d": "pct_tang_d", "title_giam_pct_d": "pct_giam_d", "dir_score_d": "dir_score_ts_d"}.get(c, c) for c in df.columns))
    got = S.text_signals(text)
    assert column(got, "SIG_LOW_DISAGR") == [1, 1, 1, 0] and column(got, "SIG_HIGH_DISAGR") == [0, 0, 0, 1]
    assert column(got, "SIG_NEUTRAL") == [1] * 4 and column(got, "SIG_SPLIT") == [1] * 4


def test_bins(spark):
    df = spark.createDataFrame([(0,), (200,), (201,)], "n int").select(S.fixed_bins(F.col("n"), (0, 200, 500), ("<200", "200-500")).alias("b"))
    assert [r.b for r in df.collect()] == [None, "<200", "200-500"]
    q = S.quantile_bins(series(spark, [1.0, 1.0, 1.0, 2.0, 3.0]), "x", 4)
    assert {(r.lo, r.hi): r["count"] for r in q.groupBy("lo", "hi").count().collect()} == {(1.0, 2.0): 4, (2.0, 3.0): 1}


def test_merge_and_pending(spark):
    links = spark.createDataFrame([("h", "t", 2, "q1"), ("h", "t", 1, "q2"), ("g", "t", 5, "q1")], "url_hash string, target string, at int, q string")
    assert {(r.url_hash, r.q) for r in R.keep_first(links, ("url_hash", "target"), (F.col("at"), F.col("q"))).collect()} == {("h", "q2"), ("g", "q1")}
    stored = spark.createDataFrame([("h", "q1")], "url_hash string, q string")
    assert R.insert_new(stored, links.select("url_hash", "q"), ("url_hash", "q")).count() == 3
    cache = spark.createDataFrame([("h", "json_error"), ("g", "ok")], "url_hash string, status string")
    assert {r.url_hash for r in R.pending(links, cache, "url_hash").collect()} == {"h"}
    assert R.pending(links, cache, "url_hash", retry=False).count() == 0


def test_fill_medians(spark):
    df = R.fill_medians(series(spark, [1.0, None, 3.0]), ["x"])
    assert column(df, "x") == [1.0, 2.0, 3.0]


def test_statistics(spark):
    # Tables of the distribution, and its closed form at one and two degrees of freedom.
    known = [(2.0, 10.0, 0.0733880348), (0.0, 5.0, 1.0), (-2.0, 10.0, 0.0733880348), (1.96, 1e6, 0.0499961), (12.706204736, 1.0, 0.05), (30.0, 50.0, 0.0), (None, 3.0, None), (1.0, 0.0, None)]
    known += [(t, 1.0, 1 - 2 * np.arctan(t) / np.pi) for t in (0.001, 0.5, 3.0, 400.0)] + [(t, 2.0, 1 - t / np.sqrt(2 + t * t)) for t in (0.01, 1.0, 40.0)]
    got = spark.createDataFrame([(k, t, n) for k, (t, n, _) in enumerate(known)], "k int, t double, n double").select("k", T.p_value(F.col("t"), F.col("n")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: p if p is None else pytest.approx(p, abs=2e-8 if n < 1e5 else 1e-6) for k, (_, n, p) in enumerate(known)}
    rows = [(float(i), float((i * 7) % 5), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, s int")
    a, b = (np.array(c) for c in zip(*((x, y) for x, y, _ in rows)))
    assert T.correlations(df, ["a"], "b").first().r == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert T.line(df, "b", "a").first().slope == pytest.approx(np.polyfit(a, b, 1)[0], abs=1e-6)
    rank = lambda v: np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])
    assert T.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], abs=1e-6)
    w = T.welch(df, ["s"], "b").first()
    one, none = b[1::2], b[::2]
    assert w.t == pytest.approx((one.mean() - none.mean()) / np.sqrt(one.var(ddof=1) / 10 + none.var(ddof=1) / 10), abs=1e-6)


def test_rules(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 0, 0)], "A int, B int, PRICE_UP int")
    sets = U.itemsets(df, ["A", "B", "PRICE_UP"], 0.25)
    assert {tuple(r["items"]): r.n for r in sets.collect()} == {("A",): 3, ("B",): 2, ("PRICE_UP",): 2, ("A", "B"): 2, ("A", "PRICE_UP"): 2, ("B", "PRICE_UP"): 1, ("A", "B", "PRICE_UP"): 1}
    found = {(tuple(r.antecedents), tuple(r.consequents)): (r.confidence, r.lift) for r in U.rules(sets, 0.6).collect()}
    assert found[("B",), ("A",)] == (1.0, pytest.approx(4 / 3, abs=1e-6)) and found[("A",), ("PRICE_UP",)] == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(4 / 3, abs=1e-6))
    assert [r.antecedents for r in U.predicting(U.rules(sets, 0.6), ["PRICE_UP"]).collect()] == [["A"]]


def test_folds_and_metrics(spark):
    df = series(spark, [float(i) for i in range(13)])
    sizes = [(a.count(), b.count()) for a, b in M.expanding_folds(df)]
    assert sizes == [(3, 2), (5, 2), (7, 2), (9, 2), (11, 2)]
    p = spark.createDataFrame([(i, float(y), float(q)) for i, (y, q) in enumerate(zip([1, 2, 3, 2], [9, 3, 1, 1]))], "date int, y double, prediction double")
    m = M.metrics(p).first()
    assert m.da == pytest.approx(2 / 3, abs=1e-6) and m.mae == 3.0


def regression(spark, n=60):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + [3.0, -7.0]
    y = x @ [3.0, -0.2] + rng.normal(size=n)
    return x, y, spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "date int, a double, b double, y double")


def test_ridge_scales_by_the_population(spark):
    x, y, df = regression(spark)
    z = (x - x.mean(0)) / x.std(0)
    exact = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    assert M.fit_linear(df, ["a", "b"], "y", 10.0, 0.0).stages[-1].coefficients.toArray() == pytest.approx(exact, rel=1e-4)
    b0, plain, standard = M.fit_gram(df, ["a", "b"], "y", 10.0, 0.0)
    assert standard == pytest.approx(exact, rel=1e-9) and b0 + x @ plain == pytest.approx(y.mean() + z @ exact, rel=1e-9)


def test_lasso_and_elastic_net_meet_their_conditions(spark):
    x, y, df = regression(spark)
    z = (x - x.mean(0)) / x.std(0)
    for alpha, l1 in ((0.5, 1.0), (0.5, 0.5), (5.0, 0.8), (100.0, 1.0)):
        _, _, w = M.fit_gram(df, ["a", "b"], "y", alpha, l1)
        slope = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - l1) * w
        assert all(abs(g - np.sign(c) * alpha * l1) < 1e-7 if c else abs(g) <= alpha * l1 + 1e-7 for g, c in zip(slope, w))


def test_grid_search_equals_separate_fits(spark):
    x, y, df = regression(spark)
    grid = [*M.LASSO_GRID, *M.RIDGE_GRID, *M.ELASTIC_GRID, (5.0, 1.0)]
    assert [len(g) for g in (M.LASSO_GRID, M.RIDGE_GRID, M.ELASTIC_GRID)] == [5, 6, 15]

    def error(g):
        out = []
        for a, b in M.expanding_folds(df):
            b0, w, _ = M.fit_gram(a, ["a", "b"], "y", *g)
            rows = np.array([(r.a, r.b, r.y) for r in b.collect()])
            out.append(np.abs(b0 + rows[:, :2] @ w - rows[:, 2]).mean())
        return np.mean(out)

    best = M.grid_search(df, ["a", "b"], "y", grid)
    assert error(best) <= min(error(g) for g in (grid[0], grid[7], grid[-1], grid[12])) + 1e-9


def test_boosted_trees():
    x = np.array([[float(i), 0.0] for i in range(40)])
    y = np.where(x[:, 0] < 13, 2.0, 5.0)
    for setting in (B.Setting(1, 1, 1.0, penalty=0.0), B.Setting(1, -1, 1.0, 1.0, 2, 0.0)):
        m = B.Boosted(setting).fit(x, y)
        assert m.predict(x) == pytest.approx(y) and m.importances()[0] > 0 == m.importances()[1]
    # A penalised leaf: the sum of its residuals over its rows and the penalty.
    m = B.Boosted(B.Setting(1, 1, 0.5, penalty=1.0)).fit(x, y)
    assert m.predict(x[:1])[0] == pytest.approx(y.mean() + 0.5 * (2.0 - y.mean()) * 13 / 14)
    assert len(B.BY_LEVEL) == len(B.BY_LEAF) == 36
    noisy = y + np.random.default_rng(1).normal(size=40) * 0.1
    deep = B.Boosted(B.Setting(50, -1, 0.3, 1.0, 5, 0.0, 5)).fit(x, noisy)
    assert all(sum(n[0] < 0 for n in t) <= 5 for t in deep.trees) and np.abs(deep.predict(x) - noisy).mean() < 0.1


def test_boosted_grid(spark):
    x, y, df = regression(spark)
    grid = (B.Setting(1, 1, 0.01), B.Setting(30, 2, 0.3))
    errors = {r.setting: r.mae for r in B.grid_errors(df, ["a", "b"], "y", grid, k=2).collect()}
    folds = [(a.toPandas().sort_values("date"), b.toPandas()) for a, b in M.expanding_folds(df, 2)]
    want = np.mean([np.abs(B.Boosted(grid[1]).fit(a[["a", "b"]].to_numpy(), a.y.to_numpy()).predict(b[["a", "b"]].to_numpy()) - b.y.to_numpy()).mean() for a, b in folds])
    assert errors[1] == pytest.approx(want) and errors[1] < errors[0]
    best = B.best_setting(df, ["a", "b"], "y", grid, k=2)
    assert best == grid[1] and B.predict(df, ["a", "b"], B.fit(df, ["a", "b"], "y", best)).filter("prediction is null").isEmpty()


def test_permutation_and_reconstruction(spark):
    x, y, df = regression(spark)
    got = {r.feature: r.importance for r in M.permutation_importance(lambda d: d.withColumn("prediction", F.col("a") * 3 - F.col("b") * 0.2), df, ["a", "b", "date"], "y").collect()}
    assert got["b"] > got["a"] > 0.5 and got["date"] == pytest.approx(0, abs=1e-9)
    row = spark.createDataFrame([(100.0, 5.0, 0.1)], "c double, delta double, ret double")
    assert M.reconstructed(row, "c", "delta").first().price == 105.0 and M.reconstructed(row, "c", "ret", True).first().price == pytest.approx(110.0)


def test_samples_and_named_joins(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "k int, g string")
    one, two = (R.seeded_sample(df.repartition(n), "k", 3, by=("g",)).collect() for n in (1, 5))
    assert sorted(one) == sorted(two) and len(one) == 6
    assert R.seeded_sample(df, "k", 1, by=("g",)).count() == 2
    right = spark.createDataFrame([(1, "x")], "other int, v string")
    assert [tuple(r) for r in R.join_on(df.filter("k < 2"), right, {"k": "other"}).orderBy("k").collect()] == [(0, "a", None), (1, "b", "x")]
    assert R.without(df, "g", "none").columns == ["k"] and R.columns_like(df, "k") == ["k"]


def test_pattern_features(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 0, 0)], "A int, B int, PRICE_UP int")
    found = U.predicting(U.rules(U.itemsets(df, ["A", "B", "PRICE_UP"], 0.25), 0.6), ["PRICE_UP"])
    assert [(r.A, r.pattern, r.hit) for r in U.pattern_features(df, ["A", "B"], found, "PRICE_UP").collect()] == [(a, "pat_00_up_c67p", a) for a in (1, 1, 1, 0)]


def test_config_is_plain_json(tmp_path):
    (tmp_path / "c.json").write_text('{"query_templates": [{"id": "t1"}]}')
    assert readers.config(str(tmp_path / "c.json"))["query_templates"][0]["id"] == "t1"


def test_cost(spark):
    r = extract.cost(spark.createDataFrame([(100,), (300,)], "tokens_used int"), 2.0).first()
    assert (r.n, r.tokens, r.mean_tokens, r.cost) == (2, 400, 200.0, pytest.approx(0.0008))


def test_extraction(spark):
    raw = [("a", '```json\n{"direction": "UP", "certainty": 1, "is_coffee_price": true}\n```', "ok"), ("b", "{bad", "ok"), ("c", None, "error: x"), ("d", '{"direction": "SIDEWAYS"}', "ok")]
    got = {r.url_hash: r for r in extract.parsed(spark.createDataFrame(raw, "url_hash string, raw string, status string")).collect()}
    assert (got["a"].direction, got["a"].certainty, got["a"]._status) == ("UP", 1, "ok")
    assert (got["b"].direction, got["b"].certainty, got["b"]._status) == ("NONE", 5, "json_error")
    assert got["c"]._status == "error: x" and got["d"].direction == "NONE"

    def client(prompt):
        if "bad" in prompt:
            raise ValueError("no answer")
        return '{"direction": "DOWN"}', 7

    articles = spark.createDataFrame([("a", "t", "x"), ("b", None, "bad")], "url_hash string, title string, content string")
    answers = extract.call_model(extract.prompts(articles, "{title}: {content}"), client)
    assert {r.url_hash: r._status for r in extract.parsed(answers).collect()} == {"a": "ok", "b": "error: no answer"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text("<p>hello</p>")
    assert [r.html for r in readers.html_files(spark, str(tmp_path / "p")).collect()] == ["<p>hello</p>"]
    (tmp_path / "q.csv").write_text('"Date,""Price"" "\n"01/02/2024,""1,234"""\n')
    assert [tuple(r) for r in readers.quoted_csv(spark, str(tmp_path / "q.csv"), ["Date", "Price"]).collect()] == [("01/02/2024", "1,234")]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "target string, k int")
    writers.by_target(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    writers.report(df, str(tmp_path / "rep"), F.concat_ws(":", "target", "k"))
    assert spark.read.text(str(tmp_path / "rep" / "text")).count() == 2


def test_stream_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = '{"url": "%s", "domain": "d", "collected_at": "2024-03-05T10:00:00+07:00", "status": "success"}\n'
    (tmp_path / "in" / "a.json").write_text(row % "u1" + row % "u1" + row % "u2")
    q = ingest.append_to(ingest.article_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_search_rotates_keys_and_resume_skips_done(spark, tmp_path):
    from sparkloom.sources import search

    ring = search.KeyRing(["a", "b"], calls=2)
    assert [ring.key() for _ in range(5)] == ["a", "a", "b", "b", "a"]

    def client(key, query, day):
        if key == "a":
            return 429, []
        return 200, [{"url": "https://x.y/z", "title": query, "date": "2 days ago"}]

    grid = spark.createDataFrame([(dt.date(2024, 3, 1), "q")], "day date, query string")
    row = search.links(search.search(grid, client, ["a", "b"]), F.lit("2024-03-10").cast("date")).first()
    assert (row.domain, row.title, row.published_date) == ("x.y", "q", dt.date(2024, 3, 8))
    seeds = spark.createDataFrame([("s",), ("t",)], "seed string")
    assert [r.suggestion for r in search.suggestions(seeds, lambda s: ["same"]).collect()] == ["same"]

    work = spark.createDataFrame([(i,) for i in range(6)], "url_hash int")
    path = str(tmp_path / "cache")
    writers.resume(work, path, "url_hash", lambda df: df.withColumn("status", F.when(F.col("url_hash") < 2, "error: x").otherwise("ok")), batches=2)
    writers.resume(work, path, "url_hash", lambda df: df.withColumn("status", F.lit("ok")), batches=2)
    assert spark.read.parquet(path).filter("status = 'ok'").count() == 6 and spark.read.parquet(path).count() == 8


def test_numbers_across_partitions(spark):
    import random

    from pyspark.sql import functions as F

    from sparkloom.operators.numbering import numbered

    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randint(0, 50) if rng.random() < 0.9 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    order = [F.col("v").asc_nulls_first(), F.col("i")]
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert {r.number: r.i for r in numbered(df, order).collect()} == {n: r[2] for n, r in enumerate(sorted(rows, key=place), 1)}
    got = {(r.k, r.n): r.i for r in numbered(df, order, ["k"], "n").collect()}
    assert got == {(k, n): r[2] for k in {r[0] for r in rows} for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=place), 1)}
    assert numbered(df.limit(0), order, ["k"]).collect() == []


def test_running_totals_across_partitions(spark):
    import random

    from sparkloom.operators.numbering import running_total

    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(-5, 9)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, i int, n long").repartition(5)
    place = sorted(rows, key=lambda r: r[1])
    assert {r.i: r.before for r in running_total(df, "n", ["i"]).collect()} == {r[1]: sum(x[2] for x in place if x[1] < r[1]) for r in rows}
    assert {r.i: r.before for r in running_total(df, "n", ["i"], ["k"]).collect()} == {r[1]: sum(x[2] for x in place if x[1] < r[1] and x[0] == r[0]) for r in rows}


def test_exact_quantiles_of_any_shape(spark):
    import random

    from sparkloom.operators.quantiles import exact_quantiles

    rng = random.Random(9)
    shapes = {
        "even": [rng.random() for _ in range(3000)], "tied": [float(rng.choice([1, 1, 1, 2])) for _ in range(3000)], "two": [0.0] * 1500 + [1.0] * 1500,
        "middle": [0.0] * 1490 + [rng.random() for _ in range(20)] + [1.0] * 1490, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-200, 200) for _ in range(3000)],
        "one": [5.0] * 3000, "gaps": [rng.random() if i % 3 else None for i in range(3000)], "none": [None] * 3000}
    df = spark.createDataFrame(list(zip(*shapes.values())), ", ".join(f"{c} double" for c in shapes)).repartition(3)
    shares = (0.0, 0.1, 0.25, 0.4999, 0.5, 0.75, 0.999, 1.0)
    wanted = {f"{c}_{p}": (c, p) for c in shapes for p in shares}
    for held in (1 << 16, 7):
        got = exact_quantiles(df, wanted, held)
        for c, values in shapes.items():
            there = sorted(x for x in values if x is not None)
            for p in shares:
                want = float(np.percentile(there, 100 * p)) if there else None
                assert got[f"{c}_{p}"] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-12)), (c, p, held)
    assert exact_quantiles(df.limit(0), {"x": ("even", 0.5)}) == {"x": None}
    odd = spark.createDataFrame([(float("nan"),), (2.0,), (None,), (float("inf"),), (-1.0,)], "x double")
    assert exact_quantiles(odd, {"m": ("x", 0.5)}) == {"m": 2.0}


def test_average_ranks_of_ties_and_groups(spark):
    import random

    from sparkloom.operators import windows as W

    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 1, 1, 2, 3, 4]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(4)

    def rank(x, among):
        there = [v for v in among if v is not None]
        return None if x is None else sum(v < x for v in there) + (sum(v == x for v in there) + 1) / 2

    assert {r.i: r.r for r in W.average_ranks(df, "x", "r").collect()} == {i: rank(x, [y for _, y, _ in rows]) for _, x, i in rows}
    assert {r.i: r.r for r in W.average_ranks(df, "x", "r", ["k"]).collect()} == {i: rank(x, [y for g, y, _ in rows if g == k]) for k, x, i in rows}


@pytest.mark.parametrize(("width", "block"), [(300, 1 << 16), (40, 16)])
def test_itemsets_of_wide_rows(spark, monkeypatch, width, block):
    from itertools import combinations

    from sparkloom.operators import rules as U

    monkeypatch.setattr(U, "BLOCK_ROWS", block)
    rng = np.random.default_rng(width)
    held = (rng.random((150, width)) < rng.choice([0.1, 0.3, 0.9], width)).astype(int)
    held[:20] = 1
    held[20:60] = held[20]
    names = [f"i{k:03d}" for k in range(width)]
    df = spark.createDataFrame([tuple(int(x) or None for x in r) for r in held], ", ".join(f"{n} int" for n in names)).repartition(3)
    got = {tuple(r["items"]): (r.n, r.support) for r in U.itemsets(df, names, 0.85).collect()}
    want = {}
    often = [k for k in range(width) if held[:, k].mean() >= 0.85]
    for size in (1, 2, 3):
        for some in combinations(often, size):
            n = int(held[:, list(some)].all(axis=1).sum())
            if n / len(held) >= 0.85:
                want[tuple(names[k] for k in some)] = (n, n / len(held))
    assert len(want) > width / 10 and got == want
    assert U.itemsets(df.limit(0), names).collect() == []


@pytest.mark.parametrize(("back", "ahead", "block"), [(3, 1, 3), (5, 2, 64), (0, 0, 10)])
def test_blocks_of_a_series_equal_one_window(spark, back, ahead, block):
    from pyspark.sql import Window

    df = spark.range(200).selectExpr("cast((id * 37) % 211 as int) as i", "cast(id % 13 as double) as x").repartition(5)

    def compute(rows, w):
        return rows.withColumns({f"b{k}": F.lag("x", k).over(w) for k in range(1, back + 1)} | {f"a{k}": F.lead("x", k).over(w) for k in range(1, ahead + 1)} | {"m": F.avg("x").over(w.rowsBetween(-back, ahead))})

    got = sorted(map(tuple, W.in_blocks(df, ["i"], compute, back, ahead, block).collect()))
    assert got == sorted(map(tuple, compute(df, Window.orderBy("i")).collect()))
    with pytest.raises(ValueError, match="exceed"):
        W.in_blocks(df, ["i"], compute, block + 1, 0, block)
