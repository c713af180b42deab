"""Near-duplicate documents by one-permutation MinHash (operator 3)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, connected_components, drop_bucketed, drop_scratch, materialize, pieces, read_table
from .hashing import mixed, stretches

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 85
BINS, BAND_ROWS = 256, 6
BANDS = BINS // BAND_ROWS
#: Bits of a sketch and of a bitmap.
SKETCH = 2048
#: A class of more pairs than HUB_PAIRS has them dealt to SLICES parts.
HUB_PAIRS, SLICES = 256, 256

#: A-Z to a-z, the six ASCII white-space characters to space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
_LENGTH = _rng.integers(1, 1 << 63, SHINGLE + 1, np.uint64)
_ROW = _rng.integers(1, 1 << 63, BAND_ROWS, np.uint64) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BANDS, np.uint64)



def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the lower-cased (A-Z) text, in order."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    return np.concatenate([*(w.hashes() for w in stretches(data)), np.zeros(0, np.uint64)])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of all words as one shingle if there are fewer."""
    words = word_hashes(text or "")
    n = min(len(words), SHINGLE)
    if not n:
        return words
    total = np.full(len(words) - n + 1, _LENGTH[n], np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


@functools.cache
def _asked_by(bins: int) -> np.ndarray:
    """Bins that each empty bin asks in turn, the same for all documents."""
    return np.random.default_rng([20240607, bins]).integers(0, bins, (bins, 4096)).astype(np.uint16)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of a non-empty sorted hash set, densified; bins is a power of two.

    The leading bits of a hash are its bin, so the first hash of each bin is its minimum.
    An empty bin asks bins in a fixed random order of its own until
    one is filled, and takes that one's value.
    """
    bin_of = (hashes >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    out[bin_of[first]] = hashes[first]
    full[bin_of[first]] = True
    order = _asked_by(bins)
    empty, at, step = np.flatnonzero(~full), 0, 16
    while len(empty) and at < order.shape[1]:
        asked = order[empty, at : at + step]
        filled = full[asked]
        got = filled.any(1)
        out[empty[got]] = out[asked[got, filled[got].argmax(1)]]
        empty, at, step = empty[~got], at + step, step * 4
    out[empty] = hashes[0]
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each bin's minimum, as 64-bit integers. An estimate that drops no pair: few hashes fill all bins, so it varies widely for small sets."""
    return np.packbits((signature(hashes, SKETCH) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The leading bits that occur among the hashes, as 64-bit integers.

    A bit that only one of two sets has stands for a hash that the other lacks, so bitmaps bound what is common with certainty.
    """
    bits = np.zeros(SKETCH, np.uint8)
    bits[(hashes >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes)[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return mixed((rows * _ROW).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sizes, digests, bands = [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_set(text)
            sizes.append(len(hashes))
            digests.append(_digest(hashes))
            bands.append(band_keys(hashes) if len(hashes) else np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)]))),
        ], names=["doc_id", "n_shingles", "digest", "bands"])


def _digest(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [x for x in map(shingle_set, batch.column(0).to_pylist()) if len(x)]
        maps = [bitmap(x) for x in sets]
        yield pa.RecordBatch.from_arrays([
            pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()),
            pa.array(maps, pa.list_(pa.int64())), pa.array([len(x) - int(np.bitwise_count(m.view(np.uint64)).sum()) for x, m in zip(sets, maps)], pa.int64()),
            ], names=["digest", "hashes", "bitmap", "hidden"])


def _common(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs u, v whose hash sets meet the similarity."""
        for batch in pieces(batches):
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """No pair reaches the similarity unless its set sizes are near enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _may_link(a: str, b: str, n: Column, m: Column, hidden_n: Column, hidden_m: Column, percent: int) -> Column:
    """False only for pairs that cannot reach the similarity: a set has no more hashes in common than the bits both
    bitmaps have and its hashes beyond one a bit."""
    common = F.least(hidden_n, hidden_m)
    for k in range(SKETCH // 64):
        common = common + F.bit_count(F.col(a)[k].bitwiseAND(F.col(b)[k]))
    return (100 + percent) * common >= percent * (n + m)


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs(u, v) with the part of v's pairs that each belongs to, and (v, part) of all parts.

    A hub of at most HUB_PAIRS pairs has one part; one of more has SLICES, so that none of its
    pairs meet in one task and its set is copied no more often than it has pairs.
    """
    sliced = pairs.withColumn("slice", F.pmod(F.xxhash64("u"), F.lit(SLICES)).cast("int"))
    slices = sliced.groupBy("v", "slice").count().groupBy("v").agg(F.sum("count").alias("n"), F.collect_list("slice").alias("slices"))
    parts = slices.select("v", F.explode("slices").alias("slice"), (F.col("n") > HUB_PAIRS).alias("dealt"))
    parts = materialize(parts.select("v", "slice", F.when(F.col("dealt"), F.col("slice")).otherwise(0).alias("part")), "hubs")
    return sliced.join(parts, ["v", "slice"]).select("u", "v", "part"), parts.select("v", "part").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(u, v) that are similar by their full shingle sets; sets lie bucketed by node, so only those of one side and of hubs move, and once."""
    pairs, parts = _dealt(materialize(pairs.select("u", "v"), "pairs"))
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")).join(parts.hint("merge"), "v")
    rows = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), ["v", "part"]).select("u", "v", "a", "b")
    return materialize(rows.mapInArrow(_common(percent), "u long, v long"), "confirmed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents with equal shingle sets form one class, whose digest is its key; only classes go on.
    Classes meet in banded buckets of their densified signatures; each bucket proposes a
    star from its class that meets most others, so a bucket of n proposes n - 1 pairs. Proposals are confirmed on
    full sets: first one hub for every class, then the hubs that are still in another
    component. Buckets that hold several components after that get the rest: each class outside the bucket's largest
    component against the classes of other components, so no pair that shares a bucket goes
    unexamined unless it is connected already or the bitmaps of its sets rule it out. A pair at a similarity of 85 shares
    no bucket with probability 2e-9, one at 80 with 3e-6.

    Null and empty texts have no shingles and stand alone. Rows that repeat an id are one
    document, linked with all that one of them is like: they share its component. A null id stands alone with a null component and is kept. An
    empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_signer, "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")
    filled = signed.filter("digest is not null and doc_id is not null")
    # Equal digests have equal sets, so any of their rows gives the size and the bands; the table also lets joins with a very common class be split.
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    placed_rows = materialize(filled.select("doc_id", "digest").join(classes.select("digest", "node"), "digest").select("doc_id", "node"), "members")
    # Texts under one id are one document.
    several = placed_rows.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v < most").select("doc_id", "v")
    same = materialize(placed_rows.join(several, "doc_id").filter("node > v").select(F.col("node").alias("u"), "v"), "same")

    rows = classes.select(F.col("node").alias("u"), "n", F.explode("bands").alias("key"))
    # Only rows of buckets with several classes are kept from here on.
    shared = rows.groupBy("key").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    met = materialize(rows.join(shared.select("key", "size"), "key").dropDuplicates(["key", "u"]), "buckets")
    # A class that meets many is like many: such hubs confirm most of their bucket at once.
    weight = met.groupBy("u").agg(F.sum("size").alias("weight"))
    ranked = met.join(weight, "u")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("weight", F.negative("u").alias("minus"), "n")).alias("hub"))
    hubs = hubs.select("key", F.negative("hub.minus").alias("v"), F.col("hub.n").alias("m"), F.col("hub.weight").alias("weight"))
    stars = met.join(hubs, "key").filter("u <> v").filter(_sizes_fit(F.col("n"), F.col("m"), percent))
    stars = materialize(stars.groupBy("u", "v").agg(F.max("weight").alias("weight")), "stars")
    meeting = materialize(met.select(F.col("u").alias("node")).distinct().join(classes.select("node", "digest", "rep"), "node"), "meeting")
    # One plan at every size: the texts of a corpus are never on a side that might be broadcast.
    wanted = texts.join(meeting.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("text")
    found = wanted.mapInArrow(_sets, "digest binary, hashes binary, bitmap array<long>, hidden long").dropDuplicates(["digest"])
    sets = found.join(meeting.select("digest", "node").hint("merge"), "digest").drop("digest").dropDuplicates(["node"])
    sets = bucketed(sets, "node", "sets")

    tried = stars.groupBy("u").agg(F.max(F.struct("weight", F.negative("v").alias("minus"))).alias("hub")).select("u", F.negative("hub.minus").alias("v"))
    links = same.union(_confirmed(tried, sets, percent))
    parts = materialize(connected_components(links), "parts")

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are not connected yet."""
        p, q = (parts.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("u", "cu"), ("v", "cv")))
        ends = pairs.join(p, "u", "left").join(q, "v", "left")
        return ends.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")

    rest = stars.join(tried, ["u", "v"], "left_anti")
    links = links.union(_confirmed(apart(rest), sets, percent))
    parts = materialize(connected_components(links), "parts")

    placed = met.select("key", "u", "n").join(parts.select(F.col("node").alias("u"), "component"), "u", "left")
    placed = placed.withColumn("component", F.coalesce("component", "u"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    bitmaps = sets.select(F.col("node").alias("u"), "bitmap", "hidden").join(classes.select(F.col("node").alias("u"), "bands"), "u")
    placed = materialize(placed.join(mixed, "key", "left_semi").join(bitmaps, "u"), "placed")
    # Largest component of a bucket: most classes, then least id.
    largest = placed.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", F.negative("component").alias("c"))).alias("top"))
    outside = placed.join(largest.select("key", F.negative("top.c").alias("main")), "key").filter("component <> main")
    other = placed.select("key", F.col("u").alias("v"), F.col("n").alias("m"), F.col("component").alias("cv"), F.col("bitmap").alias("other"), F.col("hidden").alias("unseen"), F.col("bands").alias("met"))
    strays = (
        outside.select("key", "u", "n", "component", "main", "bitmap", "hidden", "bands").join(other, "key").filter("component <> cv")
        .filter((F.col("cv") == F.col("main")) | (F.col("u") > F.col("v"))).filter(_sizes_fit(F.col("n"), F.col("m"), percent))
        .filter(_may_link("bitmap", "other", F.col("n"), F.col("m"), F.col("hidden"), F.col("unseen"), percent))
        .filter(F.array_min(F.array_intersect("bands", "met")) == F.col("key"))  # once, though they share more buckets
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        .join(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    )
    links = links.union(_confirmed(strays, sets, percent))
    parts = connected_components(links)

    # A component is called by the least id of its classes.
    of = classes.select("node", "rep").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = of.groupBy("part").agg(F.min("rep").alias("component_id"))
    members = materialize(of.select("node", "part").join(named, "part").select("node", "component_id"), "named")
    drop_bucketed(sets)
    drop_scratch(met, stars, placed)
    final = materialize(placed_rows.join(members, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "final")
    out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS hit FROM d UNION SELECT e.u AS node, r.hit FROM r JOIN e ON e.v = r.node WHERE r.hit < e.u),
m AS (SELECT node, min(hit) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
