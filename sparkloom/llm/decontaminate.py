"""Benchmark decontamination with a generalised suffix automaton (operator 10)."""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, read_table

WINDOW = 13
#: Text bytes of the items in one automaton, about 60 MB of it in each Python worker; more items make more automata, and a pass over the documents each.
BLOCK_BYTES = 2 << 20
#: A hit share of 1 in 20 words makes a document contaminated.
SHARE = 20

#: A-Z to a-z; ASCII other than letters and digits to space; other bytes stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SPAN = re.compile(rb"[^ ]+")


def fold(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


class _Builder:
    """States of a generalised suffix automaton as dicts, while it grows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The class of p's longest string and c, taken out of q."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this prefix or string already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


class SuffixAutomaton:
    """All word substrings of a list of items, in arrays, with the items that hold each window.

    A state's strings are suffixes of one another, longest `length`; `link`
    leads to the next shorter class. items are (name, words).
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        self.window = window
        read = [(name, array("i", [self.ids.setdefault(w, len(self.ids)) for w in words])) for name, words in items if words]
        self.names = [name for name, _ in read]
        self.shortest = min([window, *(len(w) for _, w in read)])
        grown = _Builder()
        for _, word_ids in read:
            last = 0
            for c in word_ids:
                last = grown.extend(last, c)
        self.link, self.length, following = grown.link, grown.length, grown.next
        n = len(following)
        # The state of the window that ends there: the last up the links whose strings reach the window.
        top = array("i", bytes(4 * n))
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist():
            if self.length[s] >= window:
                up = self.link[s]
                top[s] = top[up] if self.length[up] >= window else s
        holders: dict[int, set[int]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, (_, word_ids) in enumerate(read):
            s = 0
            for c in word_ids:
                s = following[s][c]
                if top[s]:
                    holders.setdefault(top[s], set()).add(k)
            if len(word_ids) < window:
                # The class of the whole item's string.
                while self.length[self.link[s]] >= len(word_ids):
                    s = self.link[s]
                ends.setdefault(s, []).append((len(word_ids), k))
        shared: dict[frozenset[int], frozenset[int]] = {}
        self.top, self.ends = top, ends
        self.holders = {s: shared.setdefault(mine, mine) for s, mine in ((s, frozenset(x)) for s, x in holders.items())}
        # The nearest state up the links, itself included, at which whole short items end; 0 is none.
        self.whole = array("i", bytes(4 * n))
        if ends:
            for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
                self.whole[s] = s if s in ends else self.whole[self.link[s]]
        # Transitions of a state, sorted by word, lie together.
        self.first, self.word, self.target = array("i", [0]), array("i"), array("i")
        for s in range(n):
            for c, t in sorted(following[s].items()):
                self.word.append(c)
                self.target.append(t)
            self.first.append(len(self.word))
            following[s] = None
        self.start = {c: t for c, t in zip(self.word[: self.first[1]], self.target)}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges [start, end) of window occurrences, and the items that have those windows."""
        get, start, first, word, target, link, length = self.ids.get, self.start, self.first, self.word, self.target, self.link, self.length
        top, holders, whole, ends, window = self.top, self.holders, self.whole, self.ends, self.window
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        s = n = 0
        for i, c in enumerate(map(get, words)):
            if c is None:
                s = n = 0
                continue
            while s:
                a, b = first[s], first[s + 1]
                if b - a > 1:
                    a = bisect_left(word, c, a, b)
                if a < b and word[a] == c:
                    s = target[a]
                    n += 1
                    break
                s = link[s]
                n = length[s]
            else:
                # Every word of an item leads on from the start.
                s, n = start[c], 1
            if n >= window:
                found.append((i + 1 - window, i + 1))
                items |= holders[top[s]]
            e = whole[s]
            while e:
                for size, k in ends[e]:
                    if size <= n:
                        found.append((i + 1 - size, i + 1))
                        items.add(k)
                e = whole[link[e]]
        return found, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:long,end:long>>"
_PART = "key long, ranges array<struct<start:long,end:long>>, items array<string>"

#: The automaton that this worker has built last, under the name of its block.
_built: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, items: Broadcast, window: int) -> SuffixAutomaton:
    if name not in _built:
        _built.clear()
        _built[name] = SuffixAutomaton([(k, fold(t).split()) for k, t in items.value], window)
    return _built[name]


def _hits(automaton: SuffixAutomaton, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged word ranges that are hit, and the names of the items."""
    if len(words) < automaton.shortest:
        return [], []
    found, items = automaton.scan(words)
    return merged(found), sorted({x for x in map(automaton.names.__getitem__, items) if x is not None})


def _judged(batch: pa.RecordBatch, texts: list, hits: list[tuple[list[tuple[int, int]], list[str]]], share: int) -> pa.RecordBatch:
    """The batch with the columns of _RESULT, from the hits of its texts."""
    counts, hit, spans = [], [], []
    for text, (ranges, _) in zip(texts, hits):
        folded = fold(text or "")
        at = [m.span() for m in _SPAN.finditer(folded)] if ranges else []
        counts.append(len(at) or len(folded.split()))
        hit.append(sum(b - a for a, b in ranges))
        spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
    total, words = np.array(counts, np.int64), np.array(hit, np.int64)
    ids = [names for _, names in hits]
    return pa.RecordBatch.from_arrays([
        *batch.columns, pa.array(total), pa.array(words), pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
        pa.array((words > 0) & (share * words >= total)), pa.array(ids, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ], names=[*batch.schema.names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"])


def _scanner(name: str, items: Broadcast, window: int, share: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, items, window)
        for batch in pieces(batches):
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            yield _judged(batch, texts, [_hits(automaton, fold(t or "").split()) for t in texts], share)

    return scan


def _part(name: str, items: Broadcast, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What one block of items hits in (key, text)."""
        automaton = _automaton(name, items, window)
        for batch in pieces(batches):
            hits = [(key, *_hits(automaton, fold(t or "").split())) for key, t in zip(*(batch.column(k).to_pylist() for k in range(2)))]
            hits = [h for h in hits if h[1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([h[0] for h in hits], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in h[1]] for h in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([h[2] for h in hits], pa.list_(pa.string()))], names=["key", "ranges", "items"])

    return scan


def _joiner(share: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the parts that all blocks of items gave."""
        for batch in pieces(batches):
            parts = batch.column(batch.schema.names.index("parts")).to_pylist()
            hits = [(merged([(r["start"], r["end"]) for p in x or () for r in p["ranges"]]), sorted({n for p in x or () for n in p["items"]})) for x in parts]
            rest = batch.drop_columns(["key", "parts"])
            yield _judged(rest, rest.column(rest.schema.names.index("text")).to_pylist(), hits, share)

    return join


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE,
                       block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Benchmark windows in every whole text of docs (text and the columns named in keep).

    Adds n_words, n_hit, n_items, items_sha256, contaminated, item_ids (as sorted strings) and
    spans (UTF-8 byte ranges of the hit words). The words of a document are streamed through
    the automaton of all items; a match of `window` words, or of a whole shorter item, hits them.
    Null or empty texts have no words and are never contaminated; null or empty items have no
    window; rows repeating an item_id count as one item, a null item_id hits but has no name. No items: nothing is hit.

    Items go through the driver in blocks of about block_bytes of text (or one item), each broadcast and
    made into an automaton once in a worker. One block needs one pass over the documents, which are not shuffled;
    a larger benchmark is dealt by hash to as many blocks and passes as it takes, and their hits are joined by a key of the rows.
    """
    spark = docs.sparkSession
    named = items.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + _RESULT

    def broadcast(block: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast([tuple(r) for r in block.orderBy("item_id", "text").toLocalIterator()])

    if blocks == 1:
        return rows.mapInArrow(_scanner(uuid.uuid4().hex, broadcast(named), window, share), schema)
    dealt = materialize(named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items", by="block")
    keyed = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "keyed")
    found = None
    for k in range(blocks):
        held = broadcast(dealt.filter(F.col("block") == k).select("item_id", "text"))
        part = materialize(keyed.select("key", "text").mapInArrow(_part(uuid.uuid4().hex, held, window), _PART), "part")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    parts = found.groupBy("key").agg(F.collect_list(F.struct("ranges", "items")).alias("parts"))
    return keyed.join(parts, "key", "left").mapInArrow(_joiner(share), schema)


def remove_spans(found: DataFrame) -> DataFrame:
    """The texts of find_contamination's result without the hit spans."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            t, s = (batch.schema.names.index(n) for n in ("text", "spans"))
            texts = []
            for text, spans in zip(batch.column(t).to_pylist(), batch.column(s).to_pylist()):
                if spans:
                    raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                    for x in spans:
                        kept.append(raw[at : x["start"]])
                        at = x["end"]
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield batch.set_column(t, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(cut, found.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
