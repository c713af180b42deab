"""Token ids as fixed-width bit-packed blocks (operator 5)."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, read_table, scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a block is closed at the next document end.
BLOCK_IDS = 1 << 15
#: Words kept in a worker's newer and older word table each.
WORDS_KEPT = 200_000

MAGIC = b"TPK1"
#: magic, bits per id, documents, ids, ids of the shard before this block.
HEADER = struct.Struct("<4sHxxIQQ")


def id_bits(vocabulary_size: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(packed: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """Ids first .. first + count - 1, without unpacking those before them."""
    raw = np.frombuffer(packed, np.uint8)
    if bits == 16:
        return raw.view("<u2")[first : first + count].astype(np.uint32)
    at = np.arange(first, first + count, dtype=np.int64) * bits
    low = at >> 3
    raw = np.concatenate([raw, np.zeros(5, np.uint8)])
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[low + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_block(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int, before: int) -> bytes:
    """One block: header, document ids, their presence, id offsets, packed ids."""
    there = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([
        HEADER.pack(MAGIC, bits, len(doc_ids), len(ids), before),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), there.tobytes(),
        np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(), pack_ids(ids, bits),
    ])


class Block:
    """A block read back; ids(i) unpacks document i alone."""

    def __init__(self, data: bytes):
        magic, self.bits, n, self.n_ids, self.before = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEADER.size
        ids = np.frombuffer(data, "<i8", n, at)
        there = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(x) if t else None for x, t in zip(ids, there)]
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.packed = memoryview(data)[at + 9 * n + 8 * (n + 1) :]

    def ids(self, i: int) -> np.ndarray:
        return unpack_ids(self.packed, self.bits, int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))


#: Pieces that the vocabulary's split makes of a word of plain letters, digits and marks;
#: apostrophes, other white space and further scripts are left to the library.
_PIECES = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+|\\n")


class _Packers(dict):
    """Number of ids -> the function that packs so many."""

    def __missing__(self, n: int):
        out = struct.Struct(f"<{n}I").pack
        if n < 64:
            self[n] = out
        return out


_PACKERS = _Packers()


class _Unsafe(Exception):
    """A word whose split from the text needs the text around it."""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids, as bytes, of a space and a word.

    The vocabulary's split puts a boundary before each space that a non-space
    follows, so such chunks are encoded alone, each distinct one once while it stays
    in the newer or older table.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize, self.older, self.marks = tokenizer, tokenizer.model.tokenize, {}, {}
        self.letters = _byte_letters()
        self.space = self.letters[0x20]

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _PACKERS[len(ids)](*ids)

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if word.isascii() and word.isalpha():
                ids = [t.id for t in self.tokenize(self.space + word)]
                out = _PACKERS[len(ids)](*ids)
            else:
                out = self.chunk(word)
        self[word] = out
        return out

    def chunk(self, word: str) -> bytes:
        if not word or not ("!" <= word[0] <= "~" or (word[0].isalpha() and word[0] < "ɐ")):
            raise _Unsafe
        last = word[-1]
        if last in ".,;:!?" and word[:-1].isalpha():
            return self[word[:-1]] + self.piece(last)
        pieces = _PIECES.findall(word)
        if len("".join(pieces)) != len(word) or "\n\n" in word:
            return self.encode(" " + word)
        out = self.merge(" " + pieces[0])
        for x in pieces[1:]:
            out += self.piece(x)
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a piece of the split inside a word."""
        out = self.marks.get(text)
        if out is None:
            out = self.merge(text)
            if len(self.marks) < WORDS_KEPT:
                self.marks[text] = out
        return out

    def merge(self, piece: str) -> bytes:
        """Ids of one piece of the split, to which the merges apply directly."""
        ids = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return _PACKERS[len(ids)](*ids)

    def turn(self) -> None:
        if len(self) > WORDS_KEPT:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of texts under a tokenizer file, equal to those of its library's encode(add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer)
        self.bits = id_bits(self.tokenizer.get_vocab_size())

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(x in text for x in self.added):
            return self.words.encode(text)
        first, *rest = text.split(" ")
        try:
            out = b"".join(map(self.words.__getitem__, rest))
        except _Unsafe:
            return self.words.encode(text)
        self.words.turn()
        return (self.words.encode(first) if first else b"") + out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder, with its word tables, for all tasks of a worker."""
    return Encoder(path)


def _packer(path: str, end_id: int, block_ids: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = struct.pack("<I", end_id)
        shard = TaskContext.get().partitionId()
        docs: list = []
        parts: list[bytes] = []
        before = block = held = 0

        def closed() -> pa.RecordBatch:
            nonlocal before, block, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            data = write_block(docs, [len(x) // 4 for x in parts], ids, encoder.bits, before)
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()),
                "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "data": pa.array([data], pa.binary())})
            before, block, held = before + len(ids), block + 1, 0
            docs.clear()
            parts.clear()
            return row

        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc_id)
                parts.append(encoder(text) + end)
                held += len(parts[-1]) // 4
                if held >= block_ids:
                    yield closed()
        if docs:
            yield closed()

    return pack


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                    id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write its ids, an end id after each document, in ascending id order.

    A shard is a range of ids; its blocks are rows of a Parquet table (shard, block, before,
    n_ids, data), so that Spark's own writers commit them to any store. Null texts are
    empty; repeated ids are ordered by their texts' hash, a null id comes first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # The hash spreads one id's rows over ranges, should it hold very many.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_packer(vocabulary, end_id, block_ids), "shard int, block long, before long, n_ids long, data binary").write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            block = Block(data.as_py())
            n = len(block.doc_ids)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard] * n, pa.int32()), "doc_id": pa.array(block.doc_ids, pa.int64()),
                "inside": pa.array(block.before + block.offsets[:-1], pa.int64()),
                "n_tokens": pa.array(np.diff(block.offsets), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(block.ids(i).astype("<u4").tobytes()) for i in range(n)], pa.int64())})


def read_token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from written blocks."""
    blocks = spark.read.schema("shard int, block long, before long, n_ids long, data binary").parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row a shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = blocks.select("shard", "data").mapInArrow(_reader, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs as token blocks in the shared scratch folder and digest what is read back.

    One row a document; an empty table gives an empty result; other columns are ignored.
    """
    import public_tokenizers

    path = scratch_path(docs.sparkSession, "tokens")
    write_token_ids(docs, path, vocabulary or public_tokenizers.path(VOCABULARY))
    return read_token_digest(docs.sparkSession, path)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read_table(spark, sf_dir, "documents"))
