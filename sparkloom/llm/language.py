"""Language identification by hyperdimensional profiles (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read_table
from .hashing import mixed

#: Length of a hypervector.
DIM = 1024
GRAM = 3
#: At most about so many labelled rows are learned from, drawn by hash, of each language as many or all it has.
TRAIN_ROWS = 20_000
UNDETERMINED = "und"
#: A worker keeps the vectors of so many n-grams (a byte a number), the first that it meets; those of others are made anew, and are the same.
KEPT = 8192
_SCALE = 1 << 20
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BITS = 21
_LETTERS = np.array([c if chr(c).isalpha() else 0 for c in range(0x300)], np.int64)


def letters(text: str) -> np.ndarray:
    """Code points of the letters of the lower-cased text, runs of other characters as one 0, with 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = _LETTERS[np.minimum(codes, 0x2FF)]
    far = np.flatnonzero(codes >= 0x300)
    if len(far):
        some, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([c if chr(c).isalpha() else 0 for c in some.tolist()])[at]
    out = np.concatenate([[0], out, [0]])
    return out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The random vectors of letters, -1 and 1, drawn from their code points by a hash: every letter has its own."""
    words = codes.astype(np.uint64)[:, None] * _STEP + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * _SEED
    bits = np.unpackbits(mixed(mixed(words)).astype("<u8").view(np.uint8), axis=1)
    return bits.view(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams (packed code points): each letter's is rotated by its place, and they are multiplied."""
    out = np.ones((len(grams), DIM), np.int8)
    for k in range(GRAM):
        some, at = np.unique(grams >> (_BITS * (GRAM - 1 - k)) & ((1 << _BITS) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(some), GRAM - 1 - k, 1)[at]
    return out


class _Memory:
    """Vectors of the first KEPT n-grams that a worker met: n-grams in order beside the places of their vectors."""

    def __init__(self):
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.empty((KEPT, DIM), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct n-grams in rising order."""
        at = np.searchsorted(self.known, grams)
        there = np.zeros(len(grams), bool)
        inside = np.flatnonzero(at < len(self.known))
        there[inside] = self.known[at[inside]] == grams[inside]
        if there.all():
            return self.vectors[self.place[at]]
        out = np.empty((len(grams), DIM), np.int8)
        out[there] = self.vectors[self.place[at[there]]]
        missing = grams[~there]
        out[~there] = made = gram_vectors(missing)
        n = len(self.known)
        new = missing[: KEPT - n]
        if len(new):
            self.vectors[n : n + len(new)] = made[: len(new)]
            where = at[~there][: len(new)]
            self.known, self.place = np.insert(self.known, where, new), np.insert(self.place, where, np.arange(n, n + len(new)))
        return out


_memory = _Memory()


def profile(text: str | None) -> np.ndarray | None:
    """The document's bundle: the sum of its n-gram vectors. None without letters."""
    x = letters(text or "")
    if not x.any():
        return None
    packed = np.zeros(len(x) - GRAM + 1, np.int64)
    for k in range(GRAM):
        packed = packed << _BITS | x[k : len(packed) + k]
    grams, counts = np.unique(packed, return_counts=True)
    out = np.zeros(DIM, np.float32)
    for k in range(0, len(grams), 4096):
        out += counts[k : k + 4096].astype(np.float32) @ _memory.of(grams[k : k + 4096]).astype(np.float32)
    return out


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def even_shares(sizes: dict, most: int) -> dict:
    """The share of each label's rows that is drawn: all labels get the same number of rows at most, so that about `most` are drawn; a label of fewer rows is drawn whole."""
    left, shares = most, {}
    for k, (label, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        share = min(1.0, left / (len(sizes) - k) / n)
        shares[label] = share
        left -= share * n
    return shares


def label_shares(rows: DataFrame, by: str, most: int) -> dict:
    """The shares of even_shares for column `by`; labels are not null and so few that the driver can count the rows of each."""
    return even_shares({label: n for label, n in rows.groupBy(by).count().toLocalIterator()}, most)


def drawn(rows: DataFrame, id_col: str, by: str, shares: dict) -> DataFrame:
    """The rows whose id's hash falls below the share of their label."""
    if all(x == 1.0 for x in shares.values()):
        return rows
    limit = F.create_map(*(F.lit(x) for label, share in shares.items() for x in (label, int(share * (1 << 30)))))
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) < limit[F.col(by)])


def bounded_sample(rows: DataFrame, id_col: str, by: str, most: int) -> tuple[DataFrame, dict]:
    """All rows if they are few; else about `most`, drawn by label. Also the shares."""
    shares = label_shares(rows, by, most)
    return drawn(rows, id_col, by, shares), shares


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer sums of unit bundles by language, as (lang, place, total): the same in any order."""
    total: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v = profile(text)
            if v is not None and (norm := float(np.sqrt((v.astype(np.float64) ** 2).sum()))):
                total[lang] = total.get(lang, np.zeros(DIM, np.int64)) + np.rint(v * (_SCALE / norm)).astype(np.int64)
    for lang, v in total.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * DIM, pa.string()), "place": pa.array(np.arange(DIM, dtype=np.int32)), "total": pa.array(v)})


def learn_prototypes(rows: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from rows with an id, text and non-null lang.

    The result has DIM numbers a language, whatever the input's size.
    """
    sample, _ = bounded_sample(rows.filter("lang is not null"), id_col, "lang", train_rows)
    sums = sample.select("lang", "text").mapInArrow(_bundles, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    found: dict[str, np.ndarray] = {}
    for lang, place, total in sums.toLocalIterator():
        found.setdefault(lang, np.zeros(DIM))[place] = total
    langs = sorted(found)
    matrix = np.array([found[x] for x in langs]).reshape(len(langs), DIM)
    return langs, matrix / np.maximum(np.sqrt((matrix**2).sum(1)), 1e-300)[:, None]


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score, the cosine with that language's prototype (0 if negative)."""
    # What all languages share says nothing: languages are compared after its removal.
    centre = prototypes.mean(0) if len(langs) > 1 else np.zeros(DIM)
    rest = prototypes - centre
    rest = (rest / np.maximum(np.sqrt((rest**2).sum(1)), 1e-300)[:, None]).T
    names = np.array([*langs, UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            best, score = [], []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                v = profile(text) if langs else None
                norm = float(np.sqrt((v.astype(np.float64) ** 2).sum())) if v is not None else 0.0
                if not norm:
                    best.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                v = v.astype(np.float64) / norm
                k = int(((v - centre * (v @ centre)) @ rest).argmax())
                best.append(names[k])
                score.append(min(1.0, max(0.0, float(v @ prototypes[k]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Columns of keep, held_out, lang_pred and score for every row of docs(doc_id, text, lang).

    Prototypes bundle rows whose crc32(doc_id) mod 4 is not 2 and whose lang is not
    null: all of them, or about train_rows drawn by hash, the bound shared evenly by the languages so that rare ones are learned whole. Predictions see the whole text alone. A text
    that is null or has no letter, or a table without labelled rows, gives `und` and score 0; ties go to
    the first language. A null id is not held out. Repeated rows are predicted alike; an empty table gives an empty result.
    """
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    langs, prototypes = learn_prototypes(docs.filter(~held).select("doc_id", "text", "lang"), train_rows)
    found = predict(docs, langs, prototypes, keep)
    return found.withColumn("held_out", held)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
