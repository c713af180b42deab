"""Files written by the sinks and read back by the readers, in the shared scratch folder."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.html import visible_text, visible_text_sql
from ..operators import relational as R
from ..sources import extract, filetree, merging, readers, schemas, search, writers
from ..sources.scratch import scratch_path
from . import adapters as A


def csv_links(s: SparkSession, d: str) -> DataFrame:
    """CSV with a header, its names trimmed and some of its columns read: titles with quotes, commas and line breaks survive."""
    path = scratch_path(s, "links")
    a = A.articles(s, d)
    named = {"URL_HASH": "url_hash", "TARGET": "target", "QUERY_ID": F.lit("q,1"), "DOMAIN": "domain", "TITLE": F.concat(F.lit('say "'), F.col("doc_id").cast("string"), F.lit('",\nend')), "SNIPPET": F.lit(""),
             "PUBLISHED_DATE": F.col("date").cast("string"), "DISCOVERED_AT": F.col("date").cast("timestamp")}
    rows = a.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()))
    rows.write.option("escape", '"').csv(path, header=True)
    back = readers.trimmed_names(readers.csv(s, path, schemas.LINKS, ("URL_HASH", "QUERY_ID", "TITLE", "PUBLISHED_DATE")))
    return back.toDF("url_hash", "query_id", "title", "published")


def csv_by_target(s: SparkSession, d: str) -> DataFrame:
    """A folder of CSV a target, read back with the target from the folders' names; columns picked by parts of their names."""
    path = scratch_path(s, "daily")
    m = A.mentions(s, d).select("target", "event_id", "price", "price_change", "certainty")
    writers.by_target(m, path, "csv")
    back = s.read.schema("event_id long, price double, price_change double, certainty int, target string").csv(path, header=True)
    return back.select("event_id", "target", *R.columns_like(back, "price"))


def csv_quoted(s: SparkSession, d: str) -> DataFrame:
    """Lines wrapped in quotes once more, with grouped numbers."""
    path = scratch_path(s, "quoted")
    o = F.col("o_orderkey")
    line = F.concat(F.lit('"'), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(',""'), (o % 900 + 1).cast("string"), F.lit(","), F.lpad((o % 1000).cast("string"), 3, "0"), F.lit('"",'), o.cast("string"), F.lit('"'))
    table = readers.table(s, d, "orders")
    table.select(line.alias("value")).write.text(path)
    back = readers.quoted_csv(s, path, ["Date", "Price", "Key"])
    return back.select(F.col("Key").cast("long").alias("o_orderkey"), F.to_date("Date", "MM/dd/yyyy").alias("date"), C.grouped_number(F.col("Price")).alias("price"))


def csv_split(s: SparkSession, d: str) -> DataFrame:
    """One column split into columns."""
    t = readers.table(s, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    parts = readers.split_column(t, "line", ("key", "name", "region"))
    return parts.select(F.col("key").cast("int").alias("key"), "name", F.col("region").cast("int").alias("region"))


def jsonl_raw(s: SparkSession, d: str) -> DataFrame:
    """Raw articles as JSON lines, by the declared schema: fetched ones have their page, others their error."""
    path = scratch_path(s, "raw")
    ok = F.col("page_id") % 3 != 0
    rows = readers.table(s, d, "pages").select(
        "url", F.lit("2024-03-05").cast("date").alias("date_ref"), F.when(ok, F.col("html")).alias("raw_html"), F.when(ok, "success").otherwise("failed_404").alias("status"), F.when(~ok, "gone").alias("error"))
    rows.write.json(path)
    back = readers.raw_articles(s, path)
    return back.select("url", "date_ref", "status", "error", F.coalesce(F.length("raw_html"), F.lit(0)).alias("n_chars"))


def jsonl_discovered(s: SparkSession, d: str) -> DataFrame:
    """Search results nested in JSON lines, a row each."""
    path = scratch_path(s, "found")
    i = F.col("page_id")
    result = F.struct((i % 10).cast("int").alias("rank"), "url", F.lit("d").alias("domain"), F.concat(F.lit("t"), i.cast("string")).alias("title"))
    groups = readers.table(s, d, "pages").groupBy((i % 7).alias("g"), F.floor(i / 500)).agg(F.collect_list(result).alias("results"))
    groups.select(F.lit("2024-03-05").cast("date").alias("date"), F.concat(F.lit("q"), F.col("g").cast("string")).alias("query"), "results").write.json(path)
    return readers.discovered(s, path).select("date", "query", "rank", "url", "title")


def report_lines(s: SparkSession, d: str) -> DataFrame:
    """A report as JSON rows and as text lines, both read back."""
    path = scratch_path(s, "report")
    rows = readers.table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    writers.report(rows, path, F.concat_ws(": ", "o_orderstatus", F.col("n").cast("string")))
    line = s.read.text(f"{path}/text").select(F.split_part("value", F.lit(":"), F.lit(1)).alias("o_orderstatus"), F.col("value").alias("line"))
    return s.read.schema("o_orderstatus string, n long").json(f"{path}/json").join(line, "o_orderstatus")


def appended(s: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches merged by key, one of them twice, then work resumed in batches: every key once, done."""
    path, done = scratch_path(s, "appended"), scratch_path(s, "done")
    c = readers.table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    merging.merge_new(c.filter("s_suppkey <= 60"), path, ["s_suppkey"])
    merging.merge_new(c.filter("s_suppkey > 40"), path, ["s_suppkey"])
    merging.merge_new(c.filter("s_suppkey > 40"), path, ["s_suppkey"])
    stored = merging.merged(s, path)
    writers.resume(stored, done, "s_suppkey", lambda df: df.withColumn("status", F.when(F.col("s_suppkey") % 5 == 0, "error: x").otherwise("ok")), batches=2)
    writers.resume(stored, done, "s_suppkey", lambda df: df.withColumn("status", F.lit("ok")), batches=2)
    return s.read.parquet(done).filter("status = 'ok'")


def texts_beside_pages(s: SparkSession, d: str) -> DataFrame:
    """The visible text of every page in a file of its own at the page's path, read back with the paths."""
    path = scratch_path(s, "texts")
    i = F.col("page_id").cast("string")
    pages = readers.table(s, d, "pages").select(F.concat(F.lit("site "), F.substring(i, -1, 1), F.lit("/p"), i, F.lit(".html")).alias("path"), visible_text(F.col("html")).alias("text"))
    filetree.write_files(pages, path)
    return filetree.read_files(s, path)


class _Killed(Exception):
    pass


def stream_appended(s: SparkSession, d: str) -> DataFrame:
    """Files of overlapping orders streamed into a keyed table; the query dies when a batch is stored but not committed, and is started again."""
    source, path, checkpoint = scratch_path(s, "orders"), scratch_path(s, "keyed"), scratch_path(s, "progress")
    o = readers.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    o.filter("o_orderkey % 3 <> 0").coalesce(1).write.parquet(source)
    o.filter("o_orderkey % 3 <> 1").coalesce(1).write.mode("append").parquet(source)
    stream = s.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def die(number: int) -> None:
        if number == 1:
            raise _Killed(str(number))

    for after in (die, None):
        query = merging.keyed_stream(stream, path, checkpoint, ["o_orderkey"], after=after)
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if "_Killed" not in str(e):
                raise
    return merging.merged(s, path)


TEMPLATES = tuple(f"price t{k} {{day}}/{{month}}/{{year}}" for k in range(4))


def search_source(s: SparkSession, d: str) -> DataFrame:
    """Pages as a search service's answers, read by day and access key; one of three keys is always refused, and one template has no answers."""
    path = scratch_path(s, "answers")
    i, day = F.col("page_id"), F.date_add(F.lit("2024-02-27").cast("date"), (F.col("page_id") % 5).cast("int"))
    query = F.concat(F.lit("price t"), (F.floor(i / 5) % 3).cast("string"), F.date_format(day, " d/M/y"))
    pages = readers.table(s, d, "pages").select(
        day.alias("day"), query.alias("query"), "url", F.concat(F.lit("page "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("snippet"), F.date_format(day, "MMM dd, yyyy").alias("date"))
    # `query` is a column of the files too, as slots may be shared.
    search.write_answers(pages, path)
    found = search.read_links(s, "sparkloom.sources.search:answers", "2024-02-27", "2024-03-02", TEMPLATES, ["k1", "k2", "k3"], calls=7, wait=0, answers=path, refused='["k2"]')
    return search.links(found, F.col("day")).drop("snippet")


def suggested(s: SparkSession, d: str) -> DataFrame:
    """Distinct suggestions of an offline autocomplete for every part's name."""
    def client(seed: str) -> list[str]:
        first, _, rest = seed.partition(" ")
        return [f"{first} price", f"{first} today", f"{rest} price"]

    return search.suggestions(readers.table(s, d, "part").select(F.col("p_name").alias("seed")), client)


def model_answers(s: SparkSession, d: str) -> DataFrame:
    """An offline model's answers to a prompt an article: some calls fail at first, some always, some answers are no JSON."""
    directions = ("UP", "DOWN", "STABLE", "MIXED", "NONE")

    def client():
        failed = set()

        def ask(prompt: str) -> tuple[str, int]:
            n = len(prompt)
            if n % 17 == 0 or (n % 4 == 1 and prompt not in failed):
                failed.add(prompt)
                raise TimeoutError("busy")
            return ("{bad" if n % 10 == 3 else f'```json\n{{"is_coffee_price": true, "direction": "{directions[n % 5]}", "certainty": {n % 5 + 1}}}\n```'), n

        return ask

    asked = extract.prompts(A.articles(s, d), "Title: {title}\nText: {content}", limit=500)
    got = extract.call_model(asked, client(), attempts=2, wait=0)
    return extract.parsed(got).select("url_hash", "is_coffee_price", "direction", "certainty", "tokens_used", "_status")


def csv_blank_names(s: SparkSession, d: str) -> DataFrame:
    """A CSV whose names stand between blanks."""
    path = scratch_path(s, "blanks")
    t = readers.table(s, d, "supplier").select(F.col("s_suppkey").alias(" Key"), F.col("s_name").alias("Name  "), F.col("s_acctbal").alias("  Balance "))
    t.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = readers.trimmed_names(s.read.csv(path, header=True))
    return back.select(F.col("Key").cast("long").alias("key"), F.col("Name").alias("name"), F.col("Balance").cast("double").alias("balance"))


def html_tree(s: SparkSession, d: str) -> DataFrame:
    """Pages as files below a folder, read with their paths and turned into text."""
    path = scratch_path(s, "pages")
    i = F.col("page_id").cast("string")
    pages = readers.table(s, d, "pages").select(F.concat(F.lit("d"), F.substring(i, -1, 1), F.lit("/p"), i, F.lit(".html")).alias("path"), "html")
    filetree.write_files(pages, path, text="html", kind=".html")
    files = readers.html_files(s, path)
    return files.select(F.substring_index("path", "/", -2).alias("path"), visible_text(F.col("html")).alias("text"))


def model_cost(s: SparkSession, d: str) -> DataFrame:
    """What the offline model's answers cost."""
    c = extract.cost(model_answers(s, d), 0.5)
    return c.select("n", "tokens", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("cost", 6).alias("cost"))


QUERIES = {f.__name__: f for f in (csv_links, csv_by_target, csv_quoted, csv_split, jsonl_raw, jsonl_discovered, report_lines, appended, texts_beside_pages, stream_appended, search_source, suggested, model_answers, csv_blank_names, html_tree, model_cost)}

SQL = {
    "csv_links": f"""WITH {A.ARTICLES} SELECT url_hash, 'q,1' AS query_id, 'say "' || doc_id || '",' || chr(10) || 'end' AS title, CAST(date AS VARCHAR) AS published FROM art""",
    "csv_by_target": f"WITH {A.MENTIONS} SELECT event_id, target, price, price_change FROM men",
    "csv_quoted": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST((o_orderkey % 900 + 1) * 1000 + o_orderkey % 1000 AS DOUBLE) AS price FROM orders",
    "csv_split": "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation",
    "jsonl_raw": """SELECT url, DATE '2024-03-05' AS date_ref, CASE WHEN page_id % 3 <> 0 THEN 'success' ELSE 'failed_404' END AS status, CASE WHEN page_id % 3 = 0 THEN 'gone' END AS error,
      CAST(CASE WHEN page_id % 3 <> 0 THEN coalesce(length(html), 0) ELSE 0 END AS INTEGER) AS n_chars FROM pages""",
    "jsonl_discovered": "SELECT DATE '2024-03-05' AS date, 'q' || (page_id % 7) AS query, CAST(page_id % 10 AS INTEGER) AS rank, url, 't' || page_id AS title FROM pages",
    "report_lines": "SELECT o_orderstatus, count(*) AS n, o_orderstatus || ': ' || count(*) AS line FROM orders GROUP BY o_orderstatus",
    "appended": "SELECT s_suppkey, s_nationkey, 'ok' AS status FROM supplier",
    "texts_beside_pages": f"SELECT 'site ' || (page_id % 10) || '/p' || page_id || '.txt' AS path, {visible_text_sql('html')} AS text FROM pages",
    "stream_appended": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "search_source": """WITH p AS (SELECT *, DATE '2024-02-27' + CAST(page_id % 5 AS INTEGER) AS day FROM pages)
      SELECT sha256(url) AS url_hash, CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) ELSE '' END AS domain, url, 'page ' || page_id AS title,
      'price t' || (page_id // 5 % 3) || ' ' || day(day) || '/' || month(day) || '/' || year(day) AS query, day, day AS published_date FROM p""",
    "suggested": """SELECT DISTINCT suggestion FROM (SELECT split_part(p_name, ' ', 1) AS f, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS r FROM part) x,
      LATERAL (SELECT unnest([f || ' price', f || ' today', r || ' price']) AS suggestion)""",
    "model_answers": f"""WITH {A.ARTICLES}, n AS (SELECT url_hash, length('Title: ' || title || chr(10) || 'Text: ' || substr(content, 1, 500)) AS n FROM art),
      t AS (SELECT *, CASE WHEN n % 17 = 0 THEN 'error: busy' WHEN n % 10 = 3 THEN 'json_error' ELSE 'ok' END AS _status FROM n)
      SELECT url_hash, _status = 'ok' AS is_coffee_price, CASE WHEN _status = 'ok' THEN ['UP', 'DOWN', 'STABLE', 'MIXED', 'NONE'][n % 5 + 1] ELSE 'NONE' END AS direction,
      CAST(CASE WHEN _status = 'ok' THEN n % 5 + 1 ELSE 5 END AS INTEGER) AS certainty, CAST(CASE WHEN n % 17 = 0 THEN 0 ELSE n END AS INTEGER) AS tokens_used, _status FROM t""",
}
SQL["csv_blank_names"] = "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier"
SQL["html_tree"] = f"SELECT 'd' || (page_id % 10) || '/p' || page_id || '.html' AS path, {visible_text_sql('html')} AS text FROM pages"
SQL["model_cost"] = f"SELECT count(*) AS n, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(avg(tokens_used), 6) AS mean_tokens, round(sum(tokens_used) * 0.5 / 1e6, 6) AS cost FROM ({SQL['model_answers']})"
