"""The driver's tables in the roles of articles, links, extracted facts and price series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import PROSE
from ..sources.readers import table

def articles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    content = X.text_or_empty(F.col("text"))
    return t.select(
        "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("url_hash"), F.col("lang").alias("target"), F.col("source").alias("domain"),
        content.alias("content"), X.first_line(content).alias("title"), F.substring(content, 1, 300).alias("snippet"),
        F.date_add(F.lit("2023-03-11").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("date"))


ARTICLES = r"""
art AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS url_hash, lang AS target, source AS domain, coalesce(text, '') AS content,
  substr(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 1, 200) AS title,
  substr(coalesce(text, ''), 1, 300) AS snippet, DATE '2023-03-11' + CAST(doc_id % 90 AS INTEGER) AS date FROM documents),
tok AS (SELECT *, regexp_extract_all(lower(content), '[\p{L}\p{N}\p{M}_]+') AS w, regexp_extract_all(lower(title), '[\p{L}\p{N}\p{M}_]+') AS tw,
  regexp_extract_all(lower(title || ' ' || snippet), '[\p{L}\p{N}\p{M}_]+') AS sw FROM art)"""


def article_facts(spark: SparkSession, d: str) -> DataFrame:
    """Per-article signals; prices are drawn from the id, as the texts hold hardly any."""
    a = articles(spark, d)
    c, ts, i = F.col("content"), X.joined(F.col("title"), F.col("snippet")), F.col("doc_id")
    counts = {f"n_{n}": X.hits(c, getattr(PROSE, n)).cast("long") for n in ("up", "down", "stable", "flat", "recover", "slump")}
    a = a.withColumns({
        **counts, "title_up": X.flag(F.col("title"), PROSE.up), "title_down": X.flag(F.col("title"), PROSE.down),
        "ts_up": X.flag(ts, PROSE.up), "ts_down": X.flag(ts, PROSE.down), "ts_stable": X.flag(ts, PROSE.stable),
        "has_noise": X.flag(c, PROSE.noise), "price": F.when(i % 3 != 0, (30_000 + i * 7919 % 120_000).cast("double")),
        "title_price": F.when(i % 5 == 0, (30_000 + i * 104_729 % 90_000).cast("double")), "change_mean": F.when(i % 4 == 0, (i % 19 * 1000).cast("double"))})
    return a.withColumns({
        "has_price": F.col("price").isNotNull(),
        "dir_score": X.direction_score(F.col("n_up") + F.col("n_recover"), F.col("n_down") + F.col("n_slump")),
        "body_dir_score": F.when(F.length("content") >= 50, X.direction_score(F.col("n_up"), F.col("n_down")))})


def _n(words: str, of: str = "w") -> str:
    return f"len(list_filter({of}, lambda x: x IN ({words})))"


FACTS = ARTICLES + f""",
cnt AS (SELECT *, {_n("'the','and'")} AS n_up, {_n("'der','que'")} AS n_down, {_n("'that','for'")} AS n_stable, {_n("'in'")} AS n_flat,
  {_n("'is'")} AS n_recover, {_n("'les'")} AS n_slump, {_n("'the','and'", 'tw')} > 0 AS title_up, {_n("'der','que'", 'tw')} > 0 AS title_down,
  {_n("'the','and'", 'sw')} > 0 AS ts_up, {_n("'der','que'", 'sw')} > 0 AS ts_down, {_n("'that','for'", 'sw')} > 0 AS ts_stable,
  contains(lower(content), 'all rights reserved') AS has_noise,
  CASE WHEN doc_id % 3 <> 0 THEN CAST(30000 + doc_id * 7919 % 120000 AS DOUBLE) END AS price,
  CASE WHEN doc_id % 5 = 0 THEN CAST(30000 + doc_id * 104729 % 90000 AS DOUBLE) END AS title_price,
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 19 * 1000 AS DOUBLE) END AS change_mean FROM tok),
facts AS (SELECT *, price IS NOT NULL AS has_price, CAST(n_up + n_recover - n_down - n_slump AS DOUBLE) / (n_up + n_recover + n_down + n_slump + 1) AS dir_score,
  CASE WHEN length(content) >= 50 THEN CAST(n_up - n_down AS DOUBLE) / (n_up + n_down + 1) END AS body_dir_score FROM cnt)"""


def disagreement_facts(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a direction, price and certainty each, as an extraction would give them."""
    f = article_facts(spark, d)
    up, down = F.col("n_up"), F.col("n_down")
    direction = F.when(up > down, "UP").when(down > up, "DOWN").when(F.col("n_stable") > 0, "STABLE").otherwise("NONE")
    return f.withColumns({"direction": direction, "certainty": (F.col("doc_id") % 5 + 1).cast("int")})


DISAGREEMENT = FACTS + """,
ext AS (SELECT *, CASE WHEN n_up > n_down THEN 'UP' WHEN n_down > n_up THEN 'DOWN' WHEN n_stable > 0 THEN 'STABLE' ELSE 'NONE' END AS direction,
  CAST(doc_id % 5 + 1 AS INTEGER) AS certainty FROM facts)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """Discovery links: some documents are found twice, under a second query, at other times."""
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("target"), F.col("source").alias("domain"))
    i = F.col("doc_id")
    second = t.filter(i % 7 == 0).withColumns({"query_id": F.lit("q2"), "discovered": i * 60 + F.when(i % 2 == 0, 3600).otherwise(-3600)})
    first = t.withColumns({"query_id": F.lit("q1"), "discovered": i * 60})
    return first.union(second).select(F.sha2(i.cast("string"), 256).alias("url_hash"), "doc_id", "target", "domain", "query_id", "discovered")


LINKS = """
links AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS url_hash, doc_id, lang AS target, source AS domain, 'q1' AS query_id, doc_id * 60 AS discovered FROM documents
  UNION ALL SELECT sha256(CAST(doc_id AS VARCHAR)), doc_id, lang, source, 'q2', doc_id * 60 + CASE WHEN doc_id % 2 = 0 THEN 3600 ELSE -3600 END FROM documents WHERE doc_id % 7 = 0)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Events as extracted facts: the kind is a direction, the value a price, k a certainty."""
    t = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    kind = F.create_map(*(F.lit(x) for x in ("purchase", "UP", "error", "DOWN", "view", "STABLE", "click", "MIXED", "signup", "NONE")))
    return t.select(
        "event_id", F.to_date("ts").alias("date"), F.when(F.col("user_id") % 2 == 0, "arabica").otherwise("robusta").alias("target"),
        F.col("user_id").cast("string").alias("domain"), kind[F.col("event_type")].alias("direction"),
        F.when(F.col("value") > 100, F.col("value")).alias("price"), F.when(k % 3 == 0, F.col("value") - 245).alias("price_change"),
        (k % 5 + 1).cast("int").alias("certainty"), (F.col("event_id") % 3 != 0).alias("relevant"))


MENTIONS = """
men AS (SELECT event_id, CAST(ts AS DATE) AS date, CASE WHEN user_id % 2 = 0 THEN 'arabica' ELSE 'robusta' END AS target, CAST(user_id AS VARCHAR) AS domain,
  CASE event_type WHEN 'purchase' THEN 'UP' WHEN 'error' THEN 'DOWN' WHEN 'view' THEN 'STABLE' WHEN 'click' THEN 'MIXED' WHEN 'signup' THEN 'NONE' END AS direction,
  CASE WHEN value > 100 THEN value END AS price, CASE WHEN k % 3 = 0 THEN value - 245 END AS price_change, k % 5 + 1 AS certainty, event_id % 3 <> 0 AS relevant
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def _mean_cents(c: str) -> Column:
    """Mean of amounts in whole cents: the same whatever the order of the sum."""
    cents = F.sum(F.round(F.col(c) * 100).cast("long"))
    return F.floor(cents / F.count("*")).cast("double") / 100


def prices(spark: SparkSession, d: str) -> DataFrame:
    """A daily series: the mean order total of a day."""
    t = table(spark, d, "orders")
    return t.groupBy(F.to_date("o_orderdate").alias("date")).agg(_mean_cents("o_totalprice").alias("price"))


PRICES = "px AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS DOUBLE) / 100 AS price FROM orders GROUP BY 1)"


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of ship days: low, high, close (mean) and volume."""
    t = table(spark, d, "lineitem")
    return t.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), _mean_cents("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))


BARS = """bars AS (SELECT CAST(l_shipdate AS DATE) AS date, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS DOUBLE) / 100 AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1)"""


def mention_prices(spark: SparkSession, d: str) -> DataFrame:
    """A price a day from the first day of the events on: the days of the orders moved onto the calendar in order."""
    first = table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("first"))  # one row
    p = prices(spark, d).withColumn("n", F.row_number().over(Window.orderBy("date")))
    return p.crossJoin(F.broadcast(first)).select(F.date_add("first", F.col("n") - 1).alias("date"), "price")


MENTION_PRICES = PRICES + """,
mpx AS (SELECT (SELECT min(CAST(ts AS DATE)) FROM events) + CAST(n - 1 AS INTEGER) AS date, price FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM px))"""


#: Paragraphs of made-up coffee news, with the domain's words in several cases, places that are spelt as names and not, prices, and lines that are noise.
PARAGRAPHS = (
    "Giá cà phê hôm nay tăng vọt, thị trường ổn định hơn tuần trước", "Tại Đắk Lắk giá cà phê robusta giảm nhẹ so với hôm qua", "ĐẮK LẮK VÀ TÂY NGUYÊN: NÔNG DÂN GIỮ HÀNG CHỜ GIÁ", "Cà phê Arabica đi ngang, giữ nguyên mức cũ",
    "Giá TĂNG mạnh, Tăng thêm 1.200 đồng rồi lại giảm 300 đồng mỗi ký", "Robusta phục hồi sau khi sụt sâu, xuất khẩu cao hơn", "Hotline đặt hàng: 0900 và mua ngay hôm nay để nhận ưu đãi", "Thu mua ở mức 57.600 đồng/kg tại Tây Nguyên, có nơi 58,100 VND",
    "Xem thêm tin liên quan và bình luận của bạn đọc ở cuối trang", "Lao dốc trên sàn London, thị trường tăng giảm thất thường và chưa ổn định", "đắk lắk và lâm đồng được mùa, gia lai mất mùa vì mưa", "Ngắn quá", "Tây  nguyên vào vụ, Đắk\u00a0Lắk cũng vậy, người dân phấn khởi",
)


def coffee_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the domain's language, put together from PARAGRAPHS by the keys of the parts: p_partkey, title, content."""
    k, z = F.col("p_partkey"), F.col("p_size")
    lines = F.array(*(F.lit(x) for x in PARAGRAPHS))
    picked = F.transform(F.sequence(F.lit(0), (k % 7).cast("int")), lambda j: F.get(lines, ((k * (j + 3) + z * j + j * j) % len(PARAGRAPHS)).cast("int")))
    content = F.array_join(picked, "\n")
    return table(spark, d, "part").select("p_partkey", X.first_line(content).alias("title"), content.alias("content"))


COFFEE = f"""
cl AS (SELECT p_partkey, list_transform(range(0, p_partkey % 7 + 1), lambda j: [{", ".join(f"'{x}'" for x in PARAGRAPHS)}][(p_partkey * (j + 3) + p_size * j + j * j) % {len(PARAGRAPHS)} + 1]) AS ps FROM part),
ca AS (SELECT p_partkey, ps, ps[1] AS title, array_to_string(ps, chr(10)) AS content FROM cl),
cw AS (SELECT *, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS tw FROM ca)"""
