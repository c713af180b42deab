"""Declared schemas: nothing is inferred."""

from pyspark.sql import types as T

_s = lambda *names: [T.StructField(n, T.StringType()) for n in names]

LINKS = T.StructType(_s("URL_HASH", "TARGET", "QUERY_ID", "DOMAIN", "TITLE", "SNIPPET", "PUBLISHED_DATE") + [T.StructField("DISCOVERED_AT", T.TimestampType())])
ARTICLES = T.StructType(_s("URL_HASH", "TARGET", "QUERY_ID", "DOMAIN", "PUBLISHED_DATE", "CONTENT"))
RAW_ARTICLES = T.StructType(
    [*_s("url", "domain"), T.StructField("date_ref", T.DateType()), T.StructField("collected_at", T.TimestampType()), *_s("title", "raw_html", "status", "error")])
DISCOVERED = T.StructType([
    T.StructField("date", T.DateType()), *_s("query"),
    T.StructField("results", T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), *_s("url", "domain", "title")])))])
EXTRACTION = T.StructType([
    T.StructField("is_coffee_price", T.BooleanType()), *_s("direction"), T.StructField("price_vnd", T.DoubleType()),
    T.StructField("price_change", T.DoubleType()), T.StructField("certainty", T.IntegerType()), *_s("content_date")])
STATUSES = ("success", "failed_404", "failed_blocked", "failed_timeout", "failed_other")
DIRECTIONS = ("UP", "DOWN", "STABLE", "MIXED", "NONE")
