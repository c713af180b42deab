"""Removal of repeated passages by suffix arrays of shards (operator 6)."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, drop_bucketed, drop_scratch, materialize, pieces, read_table
from .hashing import hash_sums, mixed
from .induced import Column, sorted_suffixes

LENGTH = 400
#: Bytes of the strings by which passages are dealt to shards.
GRAM = 96
#: Window starts that one piece of a long text has at most.
PIECE = 1 << 19
#: Bytes of passages in a shard.
SHARD_BYTES = 8 << 20
#: Anchors of more distinct passages are dealt again, by blocks of so many starts and the bytes that a block's windows share.
HOT, BLOCKS = 1024, (64, 8, 1)


def passages(data: bytes, length: int = LENGTH) -> list[tuple[np.ndarray, ...]]:
    """(anchor hash, passage hash, first start, last start, anchor place) for the windows of a text.

    A window's anchor is its GRAM-byte string of least hash, the first of equal ones: a
    function of the window's bytes, so equal windows have equal anchors wherever
    they are. Consecutive starts with one anchor make a passage, which reaches to the last one's end.
    """
    out = []
    wide = length - GRAM + 1
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        raw = np.frombuffer(data, np.uint8)[at : at + PIECE + length - 1]
        sums, shift = hash_sums(raw)
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * shift[: len(raw) - GRAM + 1])
        # Hash above, place below: the minimum finds the first place of the least hash.
        codes = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        n = len(raw) - length + 1
        padded = np.full(-(-len(codes) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(codes)] = codes
        blocks = padded.reshape(-1, wide)
        left = np.minimum.accumulate(blocks, 1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        anchors = (np.minimum(right[:n], left[wide - 1 : wide - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        last = np.append(first[1:], n) - 1
        anchor = anchors[first]
        whole = mixed(((sums[last + length] - sums[first]) * shift[first]) ^ np.uint64(0x5851F42D4C957F2D))
        out.append((grams[anchor].view(np.int64), whole.view(np.int64), at + first, at + last, at + anchor))
    return out


_FOUND = pa.schema([("doc", pa.binary()), ("copies", pa.int64())] + [(n, pa.int64()) for n in ("anchor", "passage", "first", "last", "place")])
_FOUND_SQL = "doc binary, copies long, anchor long, passage long, first long, last long, place long"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        owners, parts = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for p in passages(text.encode("utf-8", "surrogatepass")):
                owners.append(np.full(len(p[0]), k, np.int32))
                parts.append(p)
        if parts:
            own = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(2).take(own), *(pa.array(np.concatenate([p[k] for p in parts])) for k in range(5))], schema=_FOUND)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _blocks(starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passages (doc, text, copies, passages) cut into blocks of starts, dealt by all bytes that the windows of a block share.

        Blocks lie at fixed distances from the anchor's place, so equal windows fall into blocks of equal deals.
        """
        rows: dict[str, list] = {n: [] for n in _FOUND.names}
        for batch in pieces(batches):
            for doc, text, copies, cut in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                for w in cut:
                    a, first, last = w["place"], w["first"], w["last"]
                    for b in range((a - last) // starts, (a - first) // starts + 1):
                        low, high = a - starts * b - starts + 1, a - starts * b
                        deal = _hash(b"%d %d %d " % (w["anchor"], starts, b), data[high : low + LENGTH])
                        low, high = max(low, first), min(high, last)
                        for name, value in zip(rows, (doc, copies, deal, _hash(data[low : high + LENGTH]), low, high, a)):
                            rows[name].append(value)
                    if len(rows["doc"]) >= 1 << 16:
                        yield pa.RecordBatch.from_pydict(rows, schema=_FOUND)
                        rows = {n: [] for n in rows}
        if rows["doc"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_FOUND)

    return run


_CUT = pa.schema([(n, pa.int64()) for n in ("anchor", "passage", "weight")] + [("data", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted passages of each (text, passages)."""
    for batch in pieces(batches):
        rows: dict[str, list] = {n: [] for n in _CUT.names}
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                for name in _CUT.names[:3]:
                    rows[name].append(w[name])
                rows["data"].append(data[w["first"] : w["last"] + LENGTH])
                if len(rows["data"]) >= 4096:
                    yield pa.RecordBatch.from_pydict(rows, schema=_CUT)
                    rows = {n: [] for n in rows}
        if rows["data"]:
            yield pa.RecordBatch.from_pydict(rows, schema=_CUT)


def repeated_starts(shard: np.ndarray, begins: np.ndarray, weights: np.ndarray, folder: str, length: int = LENGTH, held: int = 1 << 22) -> np.ndarray:
    """Sorted starts, in a shard of passages, of windows whose occurrences weigh 2 or more.

    shard: symbols, a separator behind each passage; begins: where passages begin. In
    suffix order the occurrences of a window are neighbours whose common prefixes reach `length`; a suffix that meets a
    separator sooner cannot be among them, but is one of its own.
    """
    ends = np.append(begins[1:], len(shard)) - 1 - length
    found, rest, joins = [], np.zeros(0, np.int64), np.zeros(0, bool)
    def close(positions: np.ndarray, joined: np.ndarray) -> None:
        group = np.flatnonzero(~joined)
        owner = np.searchsorted(begins, positions, "right") - 1
        weight = np.where(positions <= ends[owner], weights[owner], 0)
        heavy = np.add.reduceat(weight, group) >= 2
        keep = np.repeat(heavy, np.diff(np.append(group, len(positions)))) & (weight > 0)
        found.append(positions[keep])

    for positions, prefixes in sorted_suffixes(shard, folder, length, held, depth=length):
        positions, joined = np.concatenate([rest, positions]), np.concatenate([joins, prefixes >= length])
        joined[:1] = False
        last = int(np.flatnonzero(~joined)[-1])
        if last:
            close(positions[:last], joined[:last])
        rest, joins = positions[last:], joined[last:]
    if len(rest):
        close(rest, joins)
    return np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1])) if len(starts) else np.zeros(0, np.int64)
    return starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(starts) else starts


def _sorted_shard(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The passages of one shard, through a file of symbols: the runs of repeated starts of each passage."""
        # Scratch of this task alone, where Spark's own operators spill, gone with the task.
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        folder = tempfile.mkdtemp(prefix="suffixes-", dir=spill if os.path.isdir(spill) else None)
        try:
            shard = Column(folder, "shard", np.uint8)
            columns = [Column(folder, name, np.int64) for name in ("begins", *_CUT.names[:3])]
            for piece in pieces(batches, 4096):
                data = piece.column(3)
                offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)
                raw = np.frombuffer(data.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
                ends = (offsets[1:] - offsets[0]).astype(np.int64)
                columns[0].add(shard.size + np.concatenate([[0], ends[:-1]]) + np.arange(len(ends)))
                for k, column in enumerate(columns[1:]):
                    column.add(piece.column(k).to_numpy(zero_copy_only=False))
                # UTF-8 has no byte above 0xF4, so symbols 2 .. 246 and the separator 1 fit.
                shard.add(np.insert(raw + np.uint8(2), ends, np.uint8(1)))
            if not shard.size:
                return
            begins, anchor, passage, weight = (c.mapped() for c in columns)
            starts = repeated_starts(shard.mapped(), begins, weight, folder, LENGTH, held)
            # A run never goes on into the next passage: the last starts of a passage are no windows.
            first, last = _runs(starts)
            owner = np.searchsorted(begins, first, "right") - 1
            low = first - begins[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[owner]), pa.array(passage[owner]), pa.array(low), pa.array(low + last - first)], names=["anchor", "passage", "low", "high"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


_REMOVED = pa.schema([("doc", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                      ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What remains of texts (doc, text, hits) without the windows that start in the runs of their passages."""
    for batch in pieces(batches):
        out: dict[str, list] = {n: [] for n in _REMOVED.names[1:]}
        for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for x in sorted((h["first"] + r["low"], h["first"] + r["high"] + LENGTH) for h in hits for r in h["runs"]):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append([*x])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(kept.hexdigest())
            out["spans"].append([{"a": a, "b": b} for a, b in spans])
        yield pa.RecordBatch.from_pydict({"doc": batch.column(0), **out}, schema=_REMOVED)


def _shared(found: DataFrame, name: str) -> DataFrame:
    """The passages of anchors that have more than one occurrence; nothing else can repeat."""
    # A table of its own, so that the join with a very common anchor can be split.
    anchors = materialize(found.groupBy("anchor").agg(F.sum("copies").alias("all")).filter("all > 1").select("anchor"), "anchors")
    return materialize(found.join(anchors, "anchor").select(*_FOUND.names), name)


def _by_doc(passages: DataFrame, *names: str) -> DataFrame:
    return passages.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("passages"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, held: int = 1 << 22, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges removed) for every row of docs.

    A byte goes if a 400-byte string over it also starts elsewhere, in any row, this one
    included. Equal texts are kept once, with the number of their rows, in a table bucketed by their digest that serves all
    joins with texts. Windows are dealt to shards by their anchors: where all windows of an anchor have one occurrence nothing can
    repeat, an anchor of one distinct passage that occurs twice repeats whole, and the distinct passages of all
    others are shuffled and sorted, each once, with its weight. An anchor of more than `hot` distinct passages is dealt again by
    blocks of its windows and the bytes they share, in the end by whole windows, so that shards stay near shard_bytes; a shard is sorted externally, whatever its size.

    Null texts are empty; rows that repeat an id are texts of their own, so a repeated row
    removes both. A null id is a row like others; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest, size = F.unhex(F.sha2(text.cast("binary"), 256)), F.octet_length(text).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), size.alias("n_bytes")), "rows")
    texts = docs.filter(size >= LENGTH).select(F.substring(digest, 1, 16).alias("doc"), text.alias("text"))
    # Nothing of the text decides which row stands for a class, as all are equal.
    texts = bucketed(texts.groupBy("doc").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "doc", "texts")

    everything = materialize(texts.select("doc", "text", "copies").mapInArrow(_passages, _FOUND_SQL), "passages")
    found = [_shared(everything, "shared")]
    drop_scratch(everything)
    for starts in BLOCKS:
        last = found[-1]
        crowds = last.select("anchor", "passage").distinct().groupBy("anchor").count().filter(F.col("count") > hot).select("anchor")
        crowds = materialize(crowds, "crowds")
        if crowds.isEmpty():
            break
        crowd = _by_doc(last.join(crowds, "anchor", "left_semi"), "anchor", "first", "last", "place")
        again = texts.join(crowd, "doc").select("doc", "text", "copies", "passages").mapInArrow(_blocks(starts), _FOUND_SQL)
        again = materialize(again, "blocks")
        found[-1] = materialize(last.join(crowds, "anchor", "left_anti"), "calm")
        found.append(_shared(again, "shared"))
        drop_scratch(last, again)
    parts, found = found, found[0]
    for part in parts[1:]:
        found = found.unionByName(part)

    one = F.min(F.struct("doc", "first", "last")).alias("one")
    distinct = materialize(found.groupBy("anchor", "passage").agg(F.sum("copies").alias("weight"), one).select("anchor", "passage", "weight", "one.*"), "distinct")
    several = distinct.groupBy("anchor").agg((F.count("*") > 1).alias("several"))
    distinct_of = materialize(distinct.join(several, "anchor"), "dealt")
    alone = distinct_of.filter("not several").select("anchor", "passage", F.lit(0).cast("long").alias("low"), (F.col("last") - F.col("first")).alias("high"))
    wanted = distinct_of.filter("several")
    cut = texts.join(_by_doc(wanted, "anchor", "passage", "weight", "first", "last"), "doc").select("text", "passages")
    cut = cut.mapInArrow(_cut, "anchor long, passage long, weight long, data binary")
    total = wanted.agg(F.sum(F.col("last") - F.col("first") + LENGTH)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    runs = materialize(cut.repartition(shards, "anchor").mapInArrow(_sorted_shard(held), "anchor long, passage long, low long, high long"), "runs")

    # A table of its own, so that the join with a very common passage can be split.
    by_passage = materialize(runs.unionByName(alone).groupBy("anchor", "passage").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "repeated")
    hits = found.join(by_passage, ["anchor", "passage"])
    hits = materialize(hits.groupBy("doc").agg(F.collect_list(F.struct("first", "runs")).alias("hits")), "hits")
    removed = texts.join(hits, "doc").select("doc", "text", "hits").mapInArrow(
        _removed, "doc binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")
    removed = materialize(removed, "removed")
    drop_scratch(*parts, distinct, distinct_of, runs, by_passage, hits)
    drop_bucketed(texts)

    out = rows.join(removed, F.substring("digest", 1, 16) == F.col("doc"), "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"), F.coalesce("spans", none).alias("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents")).drop("spans")
