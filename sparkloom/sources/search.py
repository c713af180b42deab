"""Search and autocomplete services behind an injected client: dates by templates in, links out."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.cleaning import printed_date
from ..functions.text import url_domain

#: Answers (key, query, day) with (status code, results of url, title, snippet, date).
SearchClient = Callable[[str, str, str], tuple[int, list[dict]]]
REFUSED = (403, 429)


class KeyRing:
    """Access keys in turn: the next one after `calls` uses or a refusal."""

    def __init__(self, keys: Sequence[str], calls: int = 900):
        if not keys:
            raise ValueError("no access keys")
        self.keys, self.calls, self.at, self.used = list(keys), calls, 0, 0

    def key(self) -> str:
        if self.used >= self.calls:
            self.rotate()
        self.used += 1
        return self.keys[self.at]

    def rotate(self) -> None:
        self.at, self.used = (self.at + 1) % len(self.keys), 0


_LINKS = "day date, query string, url string, title string, snippet string, printed string"


def search(grid: DataFrame, client: SearchClient, keys: Sequence[str], calls: int = 900, at_once: int = 4) -> DataFrame:
    """Links of every row of grid(day, query); a refused call is tried again with each other key, then gives none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring = KeyRing(keys, calls)
        for batch in batches:
            rows = []
            for day, query in zip(batch.day, batch["query"]):
                for _ in ring.keys:
                    code, results = client(ring.key(), query, str(day))
                    if code not in REFUSED:
                        rows += [(day, query, r.get("url"), r.get("title"), r.get("snippet"), r.get("date")) for r in results]
                        break
                    ring.rotate()
            yield pd.DataFrame(rows, columns=["day", "query", "url", "title", "snippet", "printed"])

    return grid.select("day", "query").repartition(at_once).mapInPandas(run, _LINKS)


def links(found: DataFrame, as_of: Column) -> DataFrame:
    """Search results as discovery links: hashed URL, domain and parsed date."""
    return found.filter("url is not null").select(
        F.sha2("url", 256).alias("url_hash"), url_domain(F.col("url")).alias("domain"), "url", "title", "snippet", "query", "day", printed_date(F.col("printed"), as_of).alias("published_date"))


def suggestions(seeds: DataFrame, client: Callable[[str], list[str]]) -> DataFrame:
    """Distinct autocomplete suggestions of seeds(seed)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"suggestion": [s for seed in batch.seed for s in client(seed)]}, dtype=object)

    return seeds.select("seed").mapInPandas(run, "suggestion string").distinct()


@dataclass
class Asked(InputPartition):
    """The queries of one day that go out under one key."""

    day: dt.date
    key: int
    queries: list[str]


class SearchReader(DataSourceReader):
    """Plans a partition a (day, key) and asks the service in it."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.keys = json.loads(options["keys"])
        self.attempts, self.wait = int(options.get("attempts", 3)), float(options.get("wait", 0.5))
        if not self.keys or self.attempts < 1:
            raise ValueError("a search needs access keys and at least one attempt")

    def partitions(self) -> list[Asked]:
        first, last = (dt.date.fromisoformat(self.options[k]) for k in ("first", "last"))
        calls, asked, n = int(self.options.get("calls", 900)), [], 0
        for k in range((last - first).days + 1):
            day = first + dt.timedelta(k)
            for template in json.loads(self.options["templates"]):
                query = template.replace("{day}", str(day.day)).replace("{month}", str(day.month)).replace("{year}", str(day.year))
                # The next key after `calls` queries, in turn.
                key = n // calls % len(self.keys)
                if not asked or (asked[-1].day, asked[-1].key) != (day, key):
                    asked.append(Asked(day, key, []))
                asked[-1].queries.append(query)
                n += 1
        return asked

    def read(self, partition: Asked) -> Iterator[tuple]:
        module, name = self.options["client"].split(":")
        client: SearchClient = getattr(importlib.import_module(module), name)(self.options)
        at = partition.key
        for query in partition.queries:
            code, results = 0, []
            for attempt in range(self.attempts):
                code, results = client(self.keys[at], query, str(partition.day))
                if code not in REFUSED:
                    break
                # Refused: the next key, after a pause that doubles.
                at = (at + 1) % len(self.keys)
                if attempt + 1 < self.attempts:
                    time.sleep(self.wait * 2**attempt)
            if code in REFUSED or not results:
                yield partition.day, query, code, None, None, None, None
            else:
                for r in results:
                    yield partition.day, query, code, r.get("url"), r.get("title"), r.get("snippet"), r.get("date")


class SearchSource(DataSource):
    """spark.read.format("link_search"): a search service as a table of links, a row a result and one without a URL for a query that has none or was refused to the last.

    Options: client ("module:factory", called with the options on the executors and giving a SearchClient), first and last (days), templates and keys (JSON lists; {day}, {month} and {year}
    are filled in), calls (queries under a key before the next one is used), attempts and wait (seconds before a second attempt, doubled for each further one). A partition is a (day, key).
    """

    @classmethod
    def name(cls) -> str:
        return "link_search"

    def schema(self) -> str:
        return "day date, query string, code int, url string, title string, snippet string, printed string"

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(dict(self.options))


def read_links(spark: SparkSession, client: str, first: str, last: str, templates: Sequence[str], keys: Sequence[str], **options) -> DataFrame:
    spark.dataSource.register(SearchSource)
    given = {"client": client, "first": first, "last": last, "templates": json.dumps(list(templates)), "keys": json.dumps(list(keys))}
    return spark.read.format("link_search").options(**given, **{k: str(v) for k, v in options.items()}).load()


def answers(options: dict[str, str]) -> SearchClient:
    """The offline stand-in: answers that write_answers() stored in the folder `answers`; keys that the option `refused` (a JSON list) names are refused."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(options["answers"])
    refused = json.loads(options.get("refused", "[]"))

    def ask(key: str, query: str, day: str) -> tuple[int, list[dict]]:
        if key in refused:
            return 429, []
        folder = fs.FileSelector(f"{root}/day={day}/slot={zlib.crc32(query.encode())}", allow_not_found=True)
        found: list[dict] = []
        for info in sorted(store.get_file_info(folder), key=lambda x: x.path):
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    found += [json.loads(line) for line in f.read().decode().splitlines()]
        return 200, [r for r in found if r["query"] == query]

    return ask


def write_answers(found: DataFrame, path: str) -> None:
    """Store results (day, query, url, title, snippet, date) where answers() finds those of a query."""
    found.withColumn("slot", F.crc32(F.col("query").cast("binary"))).write.partitionBy("day", "slot").json(path)
