"""Article-level queries: text features, cleaning, links, extraction results, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import html as H
from ..functions import text as X
from ..functions.lexicon import COFFEE_BODY, COFFEE_TITLE, PROSE
from ..operators import relational as R
from ..operators import signals as S
from ..operators.stats import unpivoted
from ..sources.extract import by_rules, parsed, prompts
from ..sources.readers import table
from . import adapters as A

LENGTH_EDGES = (0, 200, 500, 1000, 3000, 10_000, 999_999)
LENGTH_LABELS = ("<200", "200-500", "500-1k", "1k-3k", "3k-10k", ">10k")
PRESENCE = {"the": r"(?iU)\bthe\b", "que": r"(?iU)\bque\b", "digit": r"\d", "rights": "(?i)all rights reserved", "url": "://"}


def article_features(s: SparkSession, d: str) -> DataFrame:
    f = A.article_facts(s, d)
    return f.select(
        "url_hash", "title", "n_up", "n_down", "n_stable", "n_flat", "n_recover", "n_slump", "title_up", "title_down", "ts_up", "ts_down", "ts_stable", "has_noise",
        F.round("dir_score", 6).alias("dir_score"), F.round("body_dir_score", 6).alias("body_dir_score"), F.length("content").alias("n_chars"))


def _priced(s: SparkSession, d: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    three = lambda c: F.lpad((c % 1000).cast("string"), 3, "0")
    line = F.concat(
        F.lit("Giá "), (k % 300).cast("string"), F.lit("."), three(z * 17), F.lit(" đồng, "), (k % 300 + 5).cast("string"), F.lit(","), three(z * 29),
        F.lit(" VND; hôm qua tăng "), (k % 25).cast("string"), F.lit("."), three(z * 13), F.lit(" đồng, giảm 1.500"))
    return table(s, d, "part").select("p_partkey", line.alias("content"))


def article_prices(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    p = X.numbers(c, COFFEE_BODY.price, COFFEE_BODY.price_low, COFFEE_BODY.price_high)
    change = X.numbers(c, COFFEE_BODY.change, below=COFFEE_BODY.change_cap)
    return _priced(s, d).withColumns({"p": p, "ch": change}).select(
        "p_partkey", F.size("p").alias("n_prices"), (F.size("p") > 0).alias("has_price"), F.array_min("p").alias("price_min"), F.array_max("p").alias("price_max"),
        X.array_median(F.col("p")).alias("price_median"), F.get("p", 0).alias("first_price"), F.round(X.array_mean(F.col("ch")), 6).alias("change_mean"),
        X.hits(c, COFFEE_BODY.up).alias("n_up"), X.hits(c, COFFEE_BODY.down).alias("n_down"))


def rule_extraction(s: SparkSession, d: str) -> DataFrame:
    out = by_rules(_priced(s, d), COFFEE_BODY)
    return out.select("p_partkey", "is_coffee_price", "direction", "price_vnd", "certainty", "_status")


def link_dedup(s: SparkSession, d: str) -> DataFrame:
    return R.keep_first(A.links(s, d), ("url_hash", "target"), (F.col("discovered"), F.col("query_id")))


def link_merge(s: SparkSession, d: str) -> DataFrame:
    all_links = A.links(s, d)
    stored = all_links.filter("query_id = 'q1' and doc_id % 3 <> 0").select("url_hash", "query_id", F.lit("stored").alias("origin"))
    return R.insert_new(stored, all_links.select("url_hash", "query_id", F.lit("new").alias("origin")), ("url_hash", "query_id"))


def resume_pending(s: SparkSession, d: str) -> DataFrame:
    a = A.articles(s, d)
    cache = a.filter("doc_id % 2 = 0").select("url_hash", F.when(F.col("doc_id") % 6 == 0, "json_error").otherwise("ok").alias("status"))
    return R.pending(a, cache, "url_hash").select("url_hash", "target", "date")


def link_content_join(s: SparkSession, d: str) -> DataFrame:
    """Links keep their place where an article is missing; titles are relevant by a phrase."""
    body = A.articles(s, d).filter("doc_id % 5 <> 0").select("url_hash", "content")
    found = link_dedup(s, d).join(body, "url_hash", "left")
    return found.select("url_hash", "domain", F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"), F.coalesce(F.lower("content").contains("the"), F.lit(False)).alias("relevant"))


def two_versions_join(s: SparkSession, d: str) -> DataFrame:
    """Two feature tables of the same days side by side, suffixed."""
    from .daily_queries import mention_daily, mention_daily_pooled

    days = mention_daily_pooled(s, d).select("date", "n_articles")
    by = mention_daily(s, d).select("target", "date", "n_articles", "dir_score")
    old = R.with_key_suffix(by.filter("target = 'arabica'").drop("target"), ["date"], "_old")
    llm = R.with_key_suffix(by.filter("target = 'robusta'").drop("target"), ["date"], "_llm")
    return days.join(old, "date", "left").join(llm, "date", "left")


def keyword_rates(s: SparkSession, d: str) -> DataFrame:
    a = A.articles(s, d).select("target", *(X.flag(F.col("content"), p).cast("int").alias(k) for k, p in PRESENCE.items())).filter("target is not null")
    long = unpivoted(a, list(PRESENCE), ["target"], "keyword", "hit")
    return long.cube("keyword", "target").agg(F.round(F.avg("hit"), 6).alias("rate")).filter("keyword is not null").select("keyword", F.coalesce("target", F.lit("all")).alias("target"), "rate")


def ngram_top(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "conversations").select(F.explode(X.ngrams(F.col("text"), 3)).alias("ngram"))
    return t.groupBy("ngram").count().orderBy(F.desc("count"), "ngram").limit(15)


def smart_truncate(s: SparkSession, d: str) -> DataFrame:
    return A.articles(s, d).select("url_hash", X.smart_truncate(F.col("content"), PROSE, budget=600).alias("kept"))


def bin_fixed(s: SparkSession, d: str) -> DataFrame:
    a = A.articles(s, d).select(S.fixed_bins(F.length("content"), LENGTH_EDGES, LENGTH_LABELS).alias("bucket"))
    g = a.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("bucket", "n", F.round(F.col("n") / F.col("total") * 100, 6).alias("pct"))


def describe_pct(s: SparkSession, d: str) -> DataFrame:
    """Distribution of articles a day, per target: two levels of grouping."""
    per_day = A.articles(s, d).filter("target is not null").groupBy("target", "date").agg(F.count("*").alias("n"))
    shares = (0.25, 0.5, 0.75, 0.9)
    return per_day.groupBy("target").agg(
        F.count("*").alias("days"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"),
        *(F.round(F.percentile("n", p), 6).alias(f"p{int(100 * p)}") for p in shares))


def crosstab_margins(s: SparkSession, d: str) -> DataFrame:
    """Orders by year and status with margins."""
    t = table(s, d, "orders").select(F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("status"))
    g = t.cube("year", "status").count().select(F.coalesce("year", F.lit("All")).alias("year"), F.coalesce("status", F.lit("All")).alias("status"), "count")
    return g.groupBy("year").pivot("status", ["F", "O", "P", "All"]).agg(F.first("count")).na.fill(0)


def top_domains(s: SparkSession, d: str) -> DataFrame:
    a = A.articles(s, d).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"))
    return a.orderBy(F.desc("n"), "domain").limit(20)


def json_extract(s: SparkSession, d: str) -> DataFrame:
    """Fenced JSON answers, some of them broken, to fields and a status."""
    e, i = table(s, d, "events"), F.col("event_id")
    answer = F.concat(F.lit('{"is_coffee_price": true, "direction": "'), F.element_at(F.array(*(F.lit(x) for x in ("UP", "DOWN", "STABLE", "MIXED", "NONE"))), (i % 5 + 1).cast("int")),
                      F.lit('", "certainty": '), (i % 5 + 1).cast("string"), F.lit("}"))
    raw = F.when(i % 10 == 0, "{bad").when(i % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    rows = e.select("event_id", raw.alias("raw"), F.when(i % 17 == 0, "error: timeout").otherwise("ok").alias("status"))
    return parsed(rows).select("event_id", "is_coffee_price", "direction", "certainty", "_status")


def extraction_status(s: SparkSession, d: str) -> DataFrame:
    g = json_extract(s, d).groupBy("_status", "direction").agg(F.count("*").alias("n"), F.round(F.avg("certainty"), 6).alias("certainty_mean"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).withColumn("pct", F.round(F.col("n") / F.col("total") * 100, 6)).drop("total")


def consistency(s: SparkSession, d: str) -> DataFrame:
    m = A.mentions(s, d).filter("price_change is not null")
    return m.groupBy("direction", X.consistency(F.col("direction"), F.col("price_change")).alias("verdict")).agg(F.count("*").alias("n"))


def date_mismatch(s: SparkSession, d: str) -> DataFrame:
    """Stated dates (here: drawn from the id) that stray from the publication's."""
    m = A.mentions(s, d).withColumn("stated", F.when(F.col("event_id") % 4 != 0, F.date_add("date", ((F.col("event_id") % 21) - 10).cast("int"))))
    off = F.abs(F.date_diff("stated", "date"))
    return m.groupBy("target").agg(
        F.count("stated").alias("n"), F.count_if(off > 2).alias("over_2"), F.count_if(off > 7).alias("over_7"), F.round(F.avg((off > 2).cast("int")), 6).alias("share_2"),
        F.count_if(F.coalesce("stated", "date") == F.col("date")).alias("same"))


def band_filter(s: SparkSession, d: str) -> DataFrame:
    """Out-of-band values to null, unparsable ones too; rows without a date or out of the range go."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("raw_date"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("raw"))
    o = o.withColumns({"date": F.when(F.col("o_orderkey") % 11 != 0, C.day(F.col("raw_date"))), "price": C.banded(C.number(F.col("raw")), 30_000, 250_000)})
    kept = o.filter(F.col("date").between(F.lit("1995-06-01").cast("date"), F.lit("1998-06-01").cast("date")))
    return kept.select("o_orderkey", "date", "price")


def url_parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.sha2("url", 256).alias("url_hash"), X.url_domain(F.col("url")).alias("domain"))


def date_parse(s: SparkSession, d: str) -> DataFrame:
    """Printed dates of four kinds, drawn from the id."""
    i, n = F.col("o_orderkey"), F.col("o_orderkey") % 28 + 1
    raw = (F.when(i % 5 == 0, F.concat(n.cast("string"), F.lit(" ngày trước"))).when(i % 5 == 1, F.concat(n.cast("string"), F.lit(" thg "), (i % 12 + 1).cast("string"), F.lit(", 2024")))
           .when(i % 5 == 2, F.concat(n.cast("string"), F.lit(" giờ trước"))).when(i % 5 == 3, F.concat(F.lit("Mar "), F.lpad(n.cast("string"), 2, "0"), F.lit(", 2024"))).otherwise("gần đây"))
    return table(s, d, "orders").select("o_orderkey", C.printed_date(raw, F.lit("2024-03-10").cast("date")).alias("date"))


def query_grid(s: SparkSession, d: str) -> DataFrame:
    """Every day by every template: a bounded product."""
    days = s.range(1).select(F.explode(F.sequence(F.lit("2024-02-27").cast("date"), F.lit("2024-03-02").cast("date"))).alias("day"))
    templates = table(s, d, "region").select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("template_id"), F.concat(F.lit("price "), F.col("r_name"), F.lit(" {day}/{month}/{year}")).alias("template"))
    q = F.col("template")
    for name, value in (("{day}", F.dayofmonth("day")), ("{month}", F.month("day")), ("{year}", F.year("day"))):
        q = F.replace(q, F.lit(name), value.cast("string"))
    return days.crossJoin(F.broadcast(templates)).select("day", "template_id", X.excluding(q, ["a.com", "b.org"]).alias("query"))


def html_pages(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))
    return t.select("page_id", "text", ((F.length("text") >= 200) & X.flag(F.col("text"), r"(?iU)\bthe\b")).alias("kept"))


def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return R.seeded_sample(A.articles(s, d).select("doc_id", "url_hash"), "doc_id", 5)


def seeded_per_domain(s: SparkSession, d: str) -> DataFrame:
    """One article of each domain."""
    return R.seeded_sample(A.articles(s, d).select("domain", "doc_id"), "doc_id", 1, by=("domain",))


def snippet_prices(s: SparkSession, d: str) -> DataFrame:
    """Prices whose thousands and rest are two groups of the pattern: their median, if one lies in the band."""
    p = X.split_numbers(F.col("content"), COFFEE_TITLE.split_price, COFFEE_TITLE.price_low, COFFEE_TITLE.price_high)
    return _priced(s, d).select("p_partkey", X.array_median(p).alias("ts_price"), (F.size(p) > 0).alias("ts_has_price"))


def text_flags(s: SparkSession, d: str) -> DataFrame:
    """Place and noise flags, and whether either a keyword or noise is there."""
    c = F.col("content")
    return A.articles(s, d).select(
        "url_hash", X.flag(c, PROSE.place).alias("has_place"), X.flag(c, PROSE.noise).alias("has_noise"), (X.flag(c, PRESENCE["digit"]) | X.flag(c, PROSE.noise)).alias("has_either"))


def facts_by_key(s: SparkSession, d: str) -> DataFrame:
    """Articles with extracted facts, whose key has another name; absent ones stay null."""
    a = A.articles(s, d).select("url_hash", "domain")
    facts = R.without(A.article_facts(s, d), "title", "no_such_column").filter("doc_id % 4 <> 0").select(F.col("url_hash").alias("article_hash"), "n_up", "price")
    return R.join_on(a, facts, {"url_hash": "article_hash"})


def coffee_features(s: SparkSession, d: str) -> DataFrame:
    """The domain's own words on articles of its language: counts in bodies, flags of titles, places as names are written, noise, prices and scores."""
    c, t, body, head = F.col("content"), F.col("title"), COFFEE_BODY, COFFEE_TITLE
    counts = {f"n_{n}": X.hits(c, getattr(body, n)) for n in ("up", "down", "stable", "flat", "recover", "slump")}
    a = A.coffee_articles(s, d).withColumns(counts)
    prices = X.numbers(c, body.price, body.price_low, body.price_high)
    return a.select(
        "p_partkey", *counts, X.flag(t, head.up).alias("title_up"), X.flag(t, head.down).alias("title_down"), X.flag(t, head.stable).alias("title_stable"), X.flag(c, body.place).alias("has_place"),
        X.flag(c, body.noise).alias("has_noise"), X.array_median(prices).alias("price"), F.round(X.array_mean(X.numbers(c, body.change, below=body.change_cap)), 6).alias("change_mean"),
        F.round(X.direction_score(F.col("n_up") + F.col("n_recover"), F.col("n_down") + F.col("n_slump")), 6).alias("dir_score"), F.round(X.body_direction(c, body), 6).alias("body_dir_score"))


def coffee_truncate(s: SparkSession, d: str) -> DataFrame:
    """The paragraphs of those articles that the domain's terms score best."""
    return A.coffee_articles(s, d).select("p_partkey", X.smart_truncate(F.col("content"), COFFEE_TITLE, budget=150, tail=20).alias("kept"))


def model_prompts(s: SparkSession, d: str) -> DataFrame:
    """Titles and the beginning of texts in a prompt's template."""
    return prompts(A.articles(s, d), "[{title}] {content} <end>", limit=120)


def masked_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", X.masked_key(F.col("c_name")).alias("masked"))


QUERIES = {f.__name__: f for f in (
    seeded_per_domain, snippet_prices, text_flags, facts_by_key, article_features, article_prices, rule_extraction, link_dedup, link_merge, resume_pending, link_content_join, two_versions_join, keyword_rates, ngram_top, smart_truncate,
    bin_fixed, describe_pct, crosstab_margins, top_domains, json_extract, extraction_status, consistency, date_mismatch, band_filter, url_parts, date_parse, query_grid, html_pages, seeded_sample,
    coffee_features, coffee_truncate, model_prompts, masked_keys)}

_PRICED = r"""
pr AS (SELECT p_partkey, 'Giá ' || (p_partkey % 300) || '.' || lpad(CAST(p_size * 17 % 1000 AS VARCHAR), 3, '0') || ' đồng, ' || (p_partkey % 300 + 5) || ',' || lpad(CAST(p_size * 29 % 1000 AS VARCHAR), 3, '0')
  || ' VND; hôm qua tăng ' || (p_partkey % 25) || '.' || lpad(CAST(p_size * 13 % 1000 AS VARCHAR), 3, '0') || ' đồng, giảm 1.500' AS content FROM part),
pp AS (SELECT *, list_filter(list_transform(regexp_extract_all(content, '(?i)\b(\d{2,3}[.,]\d{3})\s*(?:đồng|VNĐ|VND|vnđ)', 1), lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)), lambda x: x BETWEEN 30000 AND 250000) AS p,
  list_filter(list_transform(regexp_extract_all(content, '(?i)(?:tăng|giảm)\s+(\d{1,3}[.,]\d{3})\s*(?:đồng|VNĐ|đ)?', 1), lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)), lambda x: x < 20000) AS ch FROM pr)"""

_JSON = """
ev AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'error: timeout' WHEN event_id % 10 = 0 THEN 'json_error' ELSE 'ok' END AS _status, event_id % 5 AS k FROM events),
js AS (SELECT event_id, _status = 'ok' AS is_coffee_price, CASE WHEN _status = 'ok' THEN ['UP', 'DOWN', 'STABLE', 'MIXED', 'NONE'][k + 1] ELSE 'NONE' END AS direction,
  CAST(CASE WHEN _status = 'ok' THEN k + 1 ELSE 5 END AS INTEGER) AS certainty, _status FROM ev)"""

_LEN = "CASE " + " ".join(f"WHEN length(content) > {a} AND length(content) <= {b} THEN '{x}'" for a, b, x in zip(LENGTH_EDGES, LENGTH_EDGES[1:], LENGTH_LABELS)) + " END"

SQL = {
    "article_features": f"""WITH {A.FACTS} SELECT url_hash, title, n_up, n_down, n_stable, n_flat, n_recover, n_slump, title_up, title_down, ts_up, ts_down, ts_stable, has_noise,
      round(dir_score, 6) AS dir_score, round(body_dir_score, 6) AS body_dir_score, CAST(length(content) AS INTEGER) AS n_chars FROM facts""",
    "article_prices": f"""WITH {_PRICED} SELECT p_partkey, CAST(len(p) AS INTEGER) AS n_prices, len(p) > 0 AS has_price, list_min(p) AS price_min, list_max(p) AS price_max,
      CAST(list_median(p) AS DOUBLE) AS price_median, p[1] AS first_price, round(list_avg(ch), 6) AS change_mean, 1 AS n_up, 1 AS n_down FROM pp""",
    "rule_extraction": f"""WITH {_PRICED} SELECT p_partkey, len(p) > 0 AS is_coffee_price, 'MIXED' AS direction, CAST(list_median(p) AS DOUBLE) AS price_vnd,
      CASE WHEN len(p) > 0 THEN 1 ELSE 5 END AS certainty, 'ok' AS _status FROM pp""",
    "link_dedup": f"WITH {A.LINKS} SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY url_hash, target ORDER BY discovered, query_id) = 1",
    "link_merge": f"""WITH {A.LINKS}, st AS (SELECT url_hash, query_id, 'stored' AS origin FROM links WHERE query_id = 'q1' AND doc_id % 3 <> 0)
      SELECT * FROM st UNION ALL SELECT url_hash, query_id, 'new' FROM links l WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.url_hash = l.url_hash AND st.query_id = l.query_id)""",
    "resume_pending": f"WITH {A.ARTICLES} SELECT url_hash, target, date FROM art WHERE NOT (doc_id % 2 = 0 AND doc_id % 6 <> 0)",
    "link_content_join": f"""WITH {A.LINKS}, {A.ARTICLES}, one AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY url_hash, target ORDER BY discovered, query_id) = 1)
      SELECT o.url_hash, o.domain, CAST(coalesce(length(a.content), 0) AS INTEGER) AS n_chars, coalesce(contains(lower(a.content), 'the'), false) AS relevant
      FROM one o LEFT JOIN (SELECT * FROM art WHERE doc_id % 5 <> 0) a USING (url_hash)""",
    "keyword_rates": f"""WITH {A.ARTICLES}, k AS (SELECT target, CAST(list_contains(w, 'the') AS INTEGER) AS "the", CAST(list_contains(w, 'que') AS INTEGER) AS que, CAST(regexp_matches(content, '[0-9]') AS INTEGER) AS digit,
      CAST(contains(lower(content), 'all rights reserved') AS INTEGER) AS rights, CAST(contains(content, '://') AS INTEGER) AS url FROM tok WHERE target IS NOT NULL),
      l AS (UNPIVOT k ON "the", que, digit, rights, url INTO NAME keyword VALUE hit)
      SELECT keyword, coalesce(target, 'all') AS target, round(avg(hit), 6) AS rate FROM l GROUP BY GROUPING SETS ((keyword, target), (keyword))""",
    "ngram_top": r"""WITH w AS (SELECT list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM conversations),
      g AS (SELECT array_to_string(w[i:i + 2], ' ') AS ngram FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w))
      SELECT ngram, count(*) AS count FROM g WHERE NOT regexp_matches(ngram, '[0-9]') GROUP BY ngram ORDER BY count DESC, ngram LIMIT 15""",
    "bin_fixed": f"""WITH {A.ARTICLES}, b AS (SELECT {_LEN} AS bucket FROM art), g AS (SELECT bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY bucket)
      SELECT bucket, n, round(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS pct FROM g""",
    "describe_pct": f"""WITH {A.ARTICLES}, p AS (SELECT target, date, count(*) AS n FROM art WHERE target IS NOT NULL GROUP BY 1, 2)
      SELECT target, count(*) AS days, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most, round(quantile_cont(n, 0.25), 6) AS p25,
      round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90 FROM p GROUP BY target""",
    "crosstab_margins": """WITH t AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderstatus AS st FROM orders)
      SELECT coalesce(y, 'All') AS year, count(*) FILTER (st = 'F') AS "F", count(*) FILTER (st = 'O') AS "O", count(*) FILTER (st = 'P') AS "P", count(*) AS "All" FROM t GROUP BY ROLLUP (y)""",
    "top_domains": f"WITH {A.ARTICLES} SELECT domain, count(*) AS n, round(avg(length(content)), 6) AS mean_chars FROM art GROUP BY domain ORDER BY n DESC, domain LIMIT 20",
    "json_extract": f"WITH {_JSON} SELECT * FROM js",
    "extraction_status": f"WITH {_JSON} SELECT _status, direction, count(*) AS n, round(avg(certainty), 6) AS certainty_mean, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 6) AS pct FROM js GROUP BY 1, 2",
    "consistency": f"""WITH {A.MENTIONS} SELECT direction, CASE WHEN (direction = 'UP' AND price_change > 0) OR (direction = 'DOWN' AND price_change < 0) OR (direction = 'STABLE' AND price_change = 0)
      OR direction = 'MIXED' THEN 'OK' ELSE 'MISMATCH' END AS verdict, count(*) AS n FROM men WHERE price_change IS NOT NULL GROUP BY 1, 2""",
    "date_mismatch": f"""WITH {A.MENTIONS}, m AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN date + CAST(event_id % 21 - 10 AS INTEGER) END AS stated FROM men)
      SELECT target, count(stated) AS n, count(*) FILTER (abs(stated - date) > 2) AS over_2, count(*) FILTER (abs(stated - date) > 7) AS over_7,
      round(avg(CAST(abs(stated - date) > 2 AS INTEGER)), 6) AS share_2, count(*) FILTER (coalesce(stated, date) = date) AS same FROM m GROUP BY target""",
    "band_filter": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 5 <> 0 AND o_totalprice BETWEEN 30000 AND 250000 THEN o_totalprice END AS price
      FROM orders WHERE o_orderkey % 11 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1998-06-01'""",
    "url_parts": "SELECT page_id, sha256(url) AS url_hash, CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) ELSE '' END AS domain FROM pages",
    "date_parse": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN DATE '2024-03-10' - CAST(o_orderkey % 28 + 1 AS INTEGER) WHEN 1 THEN make_date(2024, o_orderkey % 12 + 1, o_orderkey % 28 + 1)
      WHEN 2 THEN DATE '2024-03-10' WHEN 3 THEN make_date(2024, 3, o_orderkey % 28 + 1) END AS date FROM orders""",
    "query_grid": """SELECT day, 't' || r_regionkey AS template_id, 'price ' || r_name || ' ' || day(day) || '/' || month(day) || '/' || year(day) || ' -site:a.com -site:b.org' AS query
      FROM region, (SELECT CAST(unnest(generate_series(DATE '2024-02-27', DATE '2024-03-02', INTERVAL 1 DAY)) AS DATE) AS day)""",
}
from .daily_queries import MENTION, POOLED  # noqa: E402

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SCORE = " + ".join(f"CASE WHEN contains(lower(p), '{t}') THEN {w} ELSE 0 END" for w, terms in ((3, PROSE.high_terms), (2, PROSE.medium_terms), (1, PROSE.low_terms)) for t in terms)
SQL["smart_truncate"] = rf"""WITH {A.ARTICLES}, pa AS (SELECT url_hash, i, {_STRIP.format("ps[i]")} AS p FROM (SELECT url_hash, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT url_hash, string_split(content, chr(10)) AS ps FROM art))),
  sc AS (SELECT url_hash, i, p, {_SCORE} + CASE WHEN regexp_matches(p, '(?i)\d{{2,3}}[.,]\d{{3}}\s*(?:đồng|VNĐ|VND|đ/kg|đồng/kg)') THEN 3 ELSE 0 END AS score FROM pa WHERE length(p) > 20 AND NOT regexp_matches(p, '(?i)all rights reserved|copyright')),
  cu AS (SELECT *, sum(length(p)) OVER (PARTITION BY url_hash ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) - length(p) AS used FROM sc WHERE score > 0),
  pt AS (SELECT url_hash, score, i, CASE WHEN used + length(p) <= 600 THEN p WHEN used <= 600 AND 600 - used > 100 THEN substr(p, 1, CAST(600 - used AS INTEGER)) END AS piece FROM cu),
  jo AS (SELECT url_hash, coalesce(string_agg(piece, chr(10) ORDER BY score DESC, i), '') AS kept FROM pt GROUP BY url_hash)
  SELECT url_hash, CASE WHEN length(content) < 50 THEN content ELSE coalesce(kept, substr(content, 1, 600)) END AS kept FROM art LEFT JOIN jo USING (url_hash)"""
SQL["seeded_sample"] = f"WITH {A.ARTICLES} SELECT doc_id, url_hash FROM art ORDER BY md5('42:' || doc_id), doc_id LIMIT 5"
SQL["seeded_per_domain"] = f"WITH {A.ARTICLES} SELECT domain, doc_id FROM art QUALIFY row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || doc_id), doc_id) = 1"
SQL["snippet_prices"] = rf"""WITH {_PRICED}, x AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(content, '(?i)\b(\d{{2,3}}[.,]\d{{3}})\s*(?:đồng|VNĐ|VND|đ/kg|đồng/kg)', 1),
  lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)), lambda x: x BETWEEN 30000 AND 250000) AS p FROM pr) SELECT p_partkey, CAST(list_median(p) AS DOUBLE) AS ts_price, len(p) > 0 AS ts_has_price FROM x"""
SQL["text_flags"] = f"""WITH {A.ARTICLES} SELECT url_hash, contains(content, '://') AS has_place, contains(lower(content), 'all rights reserved') AS has_noise,
  regexp_matches(content, '[0-9]') OR contains(lower(content), 'all rights reserved') AS has_either FROM art"""
SQL["facts_by_key"] = f"WITH {A.FACTS} SELECT a.url_hash, a.domain, f.n_up, f.price FROM art a LEFT JOIN (SELECT * FROM facts WHERE doc_id % 4 <> 0) f ON a.url_hash = f.url_hash"

SQL["two_versions_join"] = f"""SELECT p.date, p.n_articles, o.n_articles AS n_articles_old, o.dir_score AS dir_score_old, l.n_articles AS n_articles_llm, l.dir_score AS dir_score_llm
  FROM (WITH {POOLED} SELECT * FROM md) p LEFT JOIN (WITH {MENTION} SELECT * FROM md) o ON o.date = p.date AND o.target = 'arabica'
  LEFT JOIN (WITH {MENTION} SELECT * FROM md) l ON l.date = p.date AND l.target = 'robusta'"""

SQL["html_pages"] = rf"""WITH t AS (SELECT page_id, {H.visible_text_sql("html")} AS text FROM pages)
  SELECT page_id, text, length(text) >= 200 AND list_contains(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+'), 'the') AS kept FROM t"""

_TOLD = lambda words, of="w": " + ".join(f"len(list_filter({of}, lambda x: x = '{x}'))" for x in words)
_SEEN = lambda parts, of="content": " OR ".join(f"contains(lower({of}), '{x}')" for x in parts)
_TIMES = lambda parts: " + ".join(f"(len(lower(content)) - len(replace(lower(content), '{x}', ''))) // {len(x)}" for x in parts)
SQL["coffee_features"] = rf"""WITH {A.COFFEE}, x AS (SELECT *, CAST({_TOLD(["tăng"])} AS INTEGER) AS n_up, CAST({_TOLD(["giảm"])} AS INTEGER) AS n_down, CAST({_TIMES(["ổn định"])} AS INTEGER) AS n_stable,
  CAST({_TIMES(["đi ngang"])} AS INTEGER) AS n_flat, CAST({_TIMES(["phục hồi"])} AS INTEGER) AS n_recover, CAST({_TIMES(["sụt", "lao dốc"])} AS INTEGER) AS n_slump,
  list_filter(list_transform(regexp_extract_all(content, '(?i)(\d{{2,3}}[.,]\d{{3}})[\s\p{{Z}}]*(?:đồng|VNĐ|VND|vnđ)', 1), lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)), lambda x: x BETWEEN 30000 AND 250000) AS p,
  list_filter(list_transform(regexp_extract_all(content, '(?i)(?:tăng|giảm)[\s\p{{Z}}]+(\d{{1,3}}[.,]\d{{3}})', 1), lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS DOUBLE)), lambda x: x < 20000) AS ch FROM cw)
  SELECT p_partkey, n_up, n_down, n_stable, n_flat, n_recover, n_slump, list_contains(tw, 'tăng') OR {_SEEN(["tăng vọt", "cao hơn"], "title")} AS title_up, list_contains(tw, 'giảm') OR {_SEEN(["sụt", "lao dốc"], "title")} AS title_down,
  {_SEEN(["ổn định", "đi ngang", "giữ nguyên"], "title")} AS title_stable,
  regexp_matches(content, '(Đ|đ)ắk[\s\p{{Z}}]*(L|l)ắk') OR regexp_matches(content, '(T|t)ây[\s\p{{Z}}]*(N|n)guyên') AS has_place,
  {_SEEN(["mua ngay", "đặt hàng online"])} OR regexp_matches(lower(content), 'hotline[^\n]*:[\s\p{{Z}}]*\d') AS has_noise, CAST(list_median(p) AS DOUBLE) AS price, round(list_avg(ch), 6) AS change_mean,
  round(CAST(n_up + n_recover - n_down - n_slump AS DOUBLE) / (n_up + n_recover + n_down + n_slump + 1), 6) AS dir_score,
  CASE WHEN length(content) >= 50 THEN round(CAST(n_up - n_down AS DOUBLE) / (n_up + n_down + 1), 6) END AS body_dir_score FROM x"""
_COFFEE_SCORE = " + ".join(f"CASE WHEN contains(lower(p), '{t.lower()}') THEN {w} ELSE 0 END" for w, terms in ((3, COFFEE_TITLE.high_terms), (2, COFFEE_TITLE.medium_terms), (1, COFFEE_TITLE.low_terms)) for t in terms)
SQL["coffee_truncate"] = rf"""WITH {A.COFFEE}, pa AS (SELECT p_partkey, i, ps[i] AS p FROM (SELECT p_partkey, ps, unnest(range(1, len(ps) + 1)) AS i FROM ca)),
  sc AS (SELECT p_partkey, i, p, {_COFFEE_SCORE} + CASE WHEN regexp_matches(p, '(?i)\d{{2,3}}[.,]\d{{3}}\s*(?:đồng|VNĐ|VND|đ/kg|đồng/kg)') THEN 3 ELSE 0 END AS score FROM pa
    WHERE length(p) > 20 AND NOT ({_SEEN(["hotline", "xem thêm", "bình luận", "tin liên quan"], "p")})),
  cu AS (SELECT *, sum(length(p)) OVER (PARTITION BY p_partkey ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) - length(p) AS used FROM sc WHERE score > 0),
  fs AS (SELECT *, min(CASE WHEN used + length(p) > 150 THEN used END) OVER (PARTITION BY p_partkey) AS over FROM cu),
  pt AS (SELECT p_partkey, score, i, CASE WHEN used + length(p) <= 150 THEN p WHEN 150 - used > 20 THEN substr(p, 1, CAST(150 - used AS INTEGER)) END AS piece FROM fs WHERE over IS NULL OR used <= over),
  jo AS (SELECT p_partkey, coalesce(string_agg(piece, chr(10) ORDER BY score DESC, i), '') AS kept FROM pt GROUP BY p_partkey)
  SELECT p_partkey, CASE WHEN length(content) < 50 THEN content ELSE coalesce(kept, substr(content, 1, 150)) END AS kept FROM ca LEFT JOIN jo USING (p_partkey)"""
SQL["model_prompts"] = f"WITH {A.ARTICLES} SELECT url_hash, '[' || title || '] ' || substr(content, 1, 120) || ' <end>' AS prompt FROM art"
SQL["masked_keys"] = "SELECT c_custkey, left(c_name, 4) || '...' || right(c_name, 4) AS masked FROM customer"
