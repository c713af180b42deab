"""Structured extraction from articles: the contract of a language-model stage, with an offline extractor."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import array_median, flag, hits, numbers, unfenced
from . import schemas

FALLBACK_CERTAINTY = 5
RESULT = "url_hash string, raw string, status string, tokens_used int"
_DDL = "is_coffee_price boolean, direction string, price_vnd double, price_change double, certainty int, content_date string"

#: A client answers one prompt with (raw answer, tokens used); errors become the status.
Client = Callable[[str], tuple[str, int]]


def prompts(articles: DataFrame, template: str, text: str = "content", limit: int = 1500) -> DataFrame:
    """url_hash, prompt: {title} and {content} of the template filled in."""
    filled = F.replace(F.replace(F.lit(template), F.lit("{title}"), F.coalesce("title", F.lit(""))), F.lit("{content}"), F.substring(F.coalesce(text, F.lit("")), 1, limit))
    return articles.select("url_hash", filled.alias("prompt"))


def call_model(rows: DataFrame, client: Client, at_once: int = 8, attempts: int = 1, wait: float = 0.5) -> DataFrame:
    """url_hash, raw, status, tokens_used: the client called on at most at_once partitions at a time; a failed call is tried again after a pause that doubles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, prompt in zip(batch.url_hash, batch.prompt):
                for attempt in range(attempts):
                    try:
                        raw, used = client(prompt)
                        row = key, raw, "ok", used
                        break
                    except Exception as e:
                        row = key, None, f"error: {str(e)[:50]}", 0
                        if attempt + 1 < attempts:
                            time.sleep(wait * 2**attempt)
                out.append(row)
            yield pd.DataFrame(out, columns=["url_hash", "raw", "status", "tokens_used"])

    return rows.repartition(at_once).mapInPandas(run, RESULT)


def parsed(answers: DataFrame, raw: str = "raw", status: str = "status") -> DataFrame:
    """Answers with the fields of the extraction and _status: ok, json_error or the call's error.

    Anything but ok gets the fallback: not relevant, NONE, no price, the least certain grade.
    """
    body = F.from_json(unfenced(F.col(raw)), _DDL + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = answers.withColumn("_j", body)
    good = F.col("_j").isNotNull() & F.col("_j._corrupt").isNull() & (F.col(status) == "ok")
    state = F.when(F.col(status) != "ok", F.col(status)).when(good, "ok").otherwise("json_error")
    field = lambda n, other: F.when(state == "ok", F.coalesce(F.col(f"_j.{n}"), F.lit(other))).otherwise(F.lit(other)).alias(n)
    direction = F.when((state == "ok") & F.col("_j.direction").isin(*schemas.DIRECTIONS), F.col("_j.direction")).otherwise("NONE").alias("direction")
    return df.select(
        *answers.columns, field("is_coffee_price", False), direction, field("price_vnd", None), field("price_change", None),
        field("certainty", FALLBACK_CERTAINTY), field("content_date", None), state.alias("_status"))


def by_rules(articles: DataFrame, lexicon: Lexicon, text: str = "content") -> DataFrame:
    """The extraction's columns without a model: prices and directions by the lexicon."""
    c = F.col(text)
    prices = numbers(c, lexicon.price, lexicon.price_low, lexicon.price_high)
    up, down, stable = hits(c, lexicon.up), hits(c, lexicon.down), flag(c, lexicon.stable)
    direction = F.when((up > 0) & (down > 0) & (up == down), "MIXED").when(up > down, "UP").when(down > up, "DOWN").when(stable, "STABLE").otherwise("NONE")
    return articles.select(
        "*", (F.size(prices) > 0).alias("is_coffee_price"), direction.alias("direction"), array_median(prices).alias("price_vnd"),
        F.lit(None).cast("double").alias("price_change"), F.when(F.size(prices) > 0, 1).otherwise(FALLBACK_CERTAINTY).alias("certainty"),
        F.lit(None).cast("string").alias("content_date"), F.lit("ok").alias("_status"))


def cost(answers: DataFrame, price_per_million: float) -> DataFrame:
    return answers.agg(F.count("*").alias("n"), F.sum("tokens_used").alias("tokens"), F.avg("tokens_used").alias("mean_tokens"), (F.sum("tokens_used") * price_per_million / 1e6).alias("cost"))
