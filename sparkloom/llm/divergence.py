"""How the sources of a language differ in their words: audit over integer-coded dictionaries (operator 12)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, pieces, read_table

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCUMENTS = 3
#: Terms of a group that are reported.
TOP = 200
SCALE_STEPS, STEP = 3, 1000  # shares are parts of STEP ** SCALE_STEPS, one thousand million
#: A chunk of the dictionary ends with so many terms, or bytes of them; a pair task holds two blocks of about so many sources.
CHUNK_TERMS, CHUNK_BYTES, BLOCK_SOURCES = 4096, 4 << 20, 64
#: Different terms that a worker counts before it hands them on, and bytes of text that are cut into words at once.
HELD_TERMS, PIECE = 200_000, 1 << 20

#: A-Z to a-z; other ASCII than letters to space; other bytes stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_COUNTED = "lang string, source string, term binary, n long, docs long"
_ENCODED = "lang string, chunk long, source string, n_terms int, total long, ids array<int>, counts array<long>, terms array<binary>"
_FOUND = "part string, lang string, source string, item string, value long, chunk long, id int"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of what a worker reads, handed on before it grows large."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()),
                    pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in pieces(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _words(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > HELD_TERMS:
                yield from flushed()
                size = 0
    yield from flushed()


class _Chunk:
    """Kept terms of one language in UTF-8 order, with the counts of the sources, while they are gathered."""

    def __init__(self, lang: str):
        self.lang, self.terms, self.rows, self.bytes = lang, [], [], 0

    def add(self, term: bytes, rows: list[tuple[str, int]]) -> None:
        self.terms.append(term)
        self.rows.extend((term, *r) for r in rows)
        self.bytes += len(term)

    def encoded(self, number: int) -> pa.RecordBatch:
        """A row for the dictionary (source null, counts of the whole language) and one for each source that has any of its terms."""
        vocabulary, terms = np.empty(len(self.terms), object), np.empty(len(self.rows), object)
        vocabulary[:], terms[:] = self.terms, [r[0] for r in self.rows]
        ids = np.searchsorted(vocabulary, terms)
        counts = np.array([r[2] for r in self.rows], np.int64)
        names, group = np.unique(np.array([r[1] for r in self.rows], object), return_inverse=True)
        # Exact: a bin of a source gets one count, and no total of a term reaches 2 ** 53.
        whole = np.bincount(ids, counts, len(vocabulary)).astype(np.int64)
        out = [(None, int(whole.sum()), None, whole, self.terms)]
        for g, name in enumerate(names):
            mine = group == g
            dense = np.bincount(ids[mine], counts[mine], len(vocabulary)).astype(np.int64)
            some = np.flatnonzero(dense)
            out.append((name, int(dense.sum()), some.astype(np.int32), dense[some], None))
        k = len(out)
        return pa.RecordBatch.from_arrays([
            pa.array([self.lang] * k, pa.string()), pa.array([number] * k, pa.int64()), pa.array([r[0] for r in out], pa.string()), pa.array([len(vocabulary)] * k, pa.int32()),
            pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.list_(pa.int64())),
            pa.array([r[4] for r in out], pa.list_(pa.binary()))], names=["lang", "chunk", "source", "n_terms", "total", "ids", "counts", "terms"])


def _encoder(least: int, chunk_terms: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of (part, lang, term, source, n, docs) that comes sorted by lang and term; part is the range partition."""
        chunk, made, key, rows, docs = None, 0, None, [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            """The run of one term is over."""
            nonlocal chunk, made
            if key is not None and docs >= least:
                chunk = chunk or _Chunk(key[0])
                chunk.add(key[1], rows)
                if len(chunk.terms) >= chunk_terms or chunk.bytes >= CHUNK_BYTES:
                    yield chunk.encoded(first + made)
                    chunk, made = None, made + 1

        first = 0
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() << 32
            for lang, term, source, n, d in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if (lang, term) != key:
                    yield from ended()
                    if chunk is not None and lang != chunk.lang:
                        yield chunk.encoded(first + made)
                        chunk, made = None, made + 1
                    key, rows, docs = (lang, term), [], 0
                rows.append((source, n))
                docs += d
        yield from ended()
        if chunk is not None:
            yield chunk.encoded(first + made)

    return encode


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 1) / (n + v)) in whole numbers, by long division so that nothing overflows."""
    whole, rest = np.divmod(counts + 1, n + v)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * STEP, n + v)
        whole = whole * STEP + digit
    return whole + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compare(top: int):
    def compare(table: pa.Table) -> pa.Table:
        """Pairs of two blocks of sources over one chunk of the dictionary; if the blocks are one, the most telling terms of its sources too."""
        fixed = table.drop_columns(["ids", "counts", "terms"]).to_pylist()
        size = fixed[0]["n_terms"]
        p, q, base, terms = {}, {}, None, None
        for k, r in enumerate(fixed):
            counts, ids = table["counts"][k].values, table["ids"][k].values
            counts = np.zeros(0, np.int64) if counts is None else counts.to_numpy(zero_copy_only=False)
            if r["role"] == "terms":
                base, terms = shares(counts, r["n"], r["v"]), table["terms"][k].values
                continue
            dense = np.zeros(size, np.int64)
            if ids is not None:
                dense[ids.to_numpy(zero_copy_only=False)] = counts
            share = shares(dense, r["n"], r["v"])
            if r["role"] in ("p", "both"):
                p[r["source"]] = share, dense
            if r["role"] in ("q", "both"):
                q[r["source"]] = share
        lang, chunk, out = fixed[0]["lang"], fixed[0]["chunk"], []
        names, others = list(q), np.stack(list(q.values())) if q else np.zeros((0, size), np.int64)
        for source, (share, dense) in p.items():
            out += [("pair", lang, source, item, int(f), chunk, None) for item, f in zip(names, _gap(share[None, :], others).sum(axis=1)) if item != source]
            if base is not None:
                ids = np.flatnonzero((dense > 0) & (share > base))
                value = _gap(share[ids], base[ids])
                best = np.lexsort((ids, -value))[:top]
                out += [("term", lang, source, terms[int(ids[k])].as_py().decode(), int(value[k]), chunk, int(ids[k])) for k in best]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["part", "lang", "source", "item", "value", "chunk", "id"])

    return compare


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, chunk_terms: int = CHUNK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far every source of a language is from each other one (part `pair`), and the terms that it has more often than the language (part `term`, the first `top`).

    docs has text, lang and source; nulls are ''. Terms are runs of ASCII letters, A-Z as a-z, and of all that is not ASCII. A language keeps the terms of at least
    `least` of its rows (rows that repeat a document count as documents). Shares and values are whole numbers. Texts are read whole, however long; empty ones and texts without a term make a group all the same.
    Values that tie are ordered by the item's UTF-8 bytes. An empty table gives an empty result; further columns are ignored. A language that keeps no term has its pairs, of value 0.

    Workers count words of what they read, one grouping sums them, and the sums are sorted by range: each range partition cuts the terms of a language that are kept into
    chunks, in which a term's id is its place (searchsorted), so that (chunk, id) orders like UTF-8. The counts of a source in a chunk are a vector (bincount). Pairs and
    terms are computed a chunk and two blocks of sources a task; only sums of chunks and the first terms of each are shuffled further. No dictionary and no source is held whole.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialize(counted, "counted")
    ranged = counted.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select(F.spark_partition_id().alias("part"), "lang", "term", "source", "n", "docs")
    encoded = materialize(ranged.mapInArrow(_encoder(least, chunk_terms), _ENCODED), "encoded")
    drop_scratch(counted)
    vectors, dictionaries = encoded.filter("source is not null"), encoded.filter("source is null")
    # One row a chunk, and one a (lang, source): small, but both may grow.
    chunks = dictionaries.select("lang", "chunk", "n_terms", "total", (F.row_number().over(Window.partitionBy("lang").orderBy("chunk")) - 1).alias("at"))
    langs = chunks.groupBy("lang").agg(F.sum("n_terms").alias("v"), F.sum("total").alias("lang_n"), F.count("*").alias("chunks"))
    groups = rows.select("lang", "source").distinct().join(vectors.groupBy("lang", "source").agg(F.sum("total").alias("n")), ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / block_sources).alias("blocks")).join(langs, "lang", "left")
    langs = materialize(langs.select("lang", "blocks", F.coalesce("v", F.lit(0)).alias("v"), "lang_n", F.coalesce("chunks", F.lit(0)).alias("chunks")), "langs")
    groups = materialize(groups.join(langs, "lang").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "blocks", "chunks"), "groups")
    # A row for every source in every chunk of its language, with a vector if it has any of the terms.
    every = groups.filter("v > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    every = every.join(chunks.select("lang", "at", "chunk", "n_terms"), ["lang", "at"]).join(vectors.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    mine = F.pmod(F.xxhash64("source"), F.col("blocks"))
    every = every.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one = F.col("mine") == F.col("other")
    first = F.struct(F.col("mine").alias("bs"), F.col("other").alias("bt"), F.when(one, "both").otherwise("p").alias("role"))
    second = F.struct(F.col("other").alias("bs"), F.col("mine").alias("bt"), F.lit("q").alias("role"))
    every = every.withColumn("k", F.explode(F.when(one, F.array(first)).otherwise(F.array(first, second))))
    names = ("lang", "chunk", "bs", "bt", "role", "source", "n", "v", "n_terms", "ids", "counts", "terms")
    every = every.withColumn("terms", F.lit(None).cast("array<binary>")).select("lang", "chunk", "k.bs", "k.bt", "k.role", "source", "n", "v", "n_terms", "ids", "counts", "terms")
    own = dictionaries.join(langs, "lang").withColumn("bs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.withColumns({"bt": F.col("bs"), "role": F.lit("terms"), "n": F.col("lang_n")}).select(*names)
    found = materialize(every.select(*names).unionByName(own).groupBy("lang", "chunk", "bs", "bt").applyInArrow(_compare(top), _FOUND), "found")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.filter("v = 0")
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.unionByName(none).withColumn("rank", F.row_number().over(by_item))
    by_id = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id")
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(by_id)).filter(F.col("rank") <= top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(sum(t.n) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
