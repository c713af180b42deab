"""Toxicity by a factorization machine over hashed terms (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, read_table
from .hashing import stretches
from .language import bounded_sample, drawn, fold, label_shares

#: At most about so many labelled rows are learned from, drawn by hash, of either label as many or all it has.
TRAIN_ROWS = 20_000
#: Terms are hashed to so many bits; the machine holds the most telling ones, of so
#: many rows and so much chi-square against the label at least.
TERM_BITS = 31
TERMS = 1 << 14
LEAST_ROWS, LEAST_GAIN = 4, 20.0
#: Of so many terms, half the most telling and the rest the most common, all pairs are screened: a pair is held if
#: either term has so much chi-square among the rows of the other.
PAIR_TERMS, PAIR_GAIN = 1024, 40.0
#: A word counts as a term, and so do its first 4, 5 and 6 bytes.
PREFIXES = (4, 5, 6)
FACTORS = 8
EPOCHS = 30
#: Linear weights are fitted alone in so many epochs first, from log-odds lowered by so many standard errors.
LINEAR_EPOCHS, ERRORS = 10, 2.0
#: A row loses a random share of its terms each time, half of them on average, so that a term must also tell without the others.
DROP = 1.0
THRESHOLD = 0.7

_FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms: letter runs of the lower-cased text and their prefixes."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)
    parts = [np.zeros(0, np.uint64)]
    for words in stretches(data):
        parts.append(words.hashes())
        # The length tells a prefix from a word spelt alike.
        parts.extend(words.prefixes(n) * np.uint64(2 * n + 1) for n in PREFIXES)
    return np.unique(np.concatenate(parts) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def places(held: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where terms stand among the sorted terms held; others are left out."""
    if not len(held):
        return np.zeros(0, np.int64)
    at = np.searchsorted(held, found)
    at[at == len(held)] = 0
    return at[held[at] == found]


class FactorizationMachine:
    """y = b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the terms held, x 1 if a text has the term."""

    def __init__(self, held: np.ndarray, factors: int = FACTORS, seed: int = 20240617):
        self.held = held
        self.bias = 0.0
        # The last row stands for padding and stays 0.
        self.weights = np.zeros(len(held) + 1)
        self.vectors = np.random.default_rng(seed).normal(0, 0.01, (len(held) + 1, factors))
        self.vectors[-1] = 0

    def places(self, found: np.ndarray) -> np.ndarray:
        return places(self.held, found)

    def raw(self, at: np.ndarray) -> np.ndarray:
        """Scores before the logistic, of padded rows of places."""
        v = self.vectors[at]
        s = v.sum(1)
        return self.bias + self.weights[at].sum(1) + 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2)))

    def score(self, found: np.ndarray) -> float:
        at = self.places(found)
        return float(1 / (1 + np.exp(-np.clip(self.raw(at[None, :])[0], -40, 40))))

    def start(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Bias from the labels' shares; weights from each term's own log-odds, drawn to 0 by ERRORS standard errors."""
        share = labels.mean() if len(labels) else 0.0
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        size = len(self.held)
        at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        of = np.repeat(labels, [len(r) for r in rows])
        yes = np.bincount(at, of, size) + 0.5
        no = np.bincount(at, 1 - of, size) + 0.5
        odds = np.log(yes / (labels.sum() + 1)) - np.log(no / ((1 - labels).sum() + 1))
        self.weights[:size] = np.sign(odds) * np.maximum(np.abs(odds) - ERRORS * np.sqrt(1 / yes + 1 / no), 0)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 3e-5, batch: int = 128,
            linear: int = LINEAR_EPOCHS, drop: float = DROP) -> None:
        """Adaptive gradient descent on the logistic loss, in a seeded order.

        Signs that come together would share the weight of their rows, and one alone would say little; so weights start at
        what each term says by itself, and rows lose terms at random while they are learned (a row never loses all).
        """
        rng = np.random.default_rng(len(rows))
        self.start(rows, labels)
        pad = len(self.held)
        gw, gv, gb = np.full(pad + 1, 1e-6), np.full(self.vectors.shape, 1e-6), 1e-6
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            # Rows of like length share a batch, so padding stays small.
            order = order[np.argsort([len(rows[k]) // 32 for k in order], kind="stable")]
            for k in rng.permutation(range(0, len(order), batch)):
                some = order[k : k + batch]
                at = np.full((len(some), max(1, max(len(rows[i]) for i in some))), pad)
                for n, i in enumerate(some):
                    at[n, : len(rows[i])] = rows[i]
                left = np.where(rng.random(at.shape) < rng.random((len(some), 1)) * drop, pad, at)
                at = np.where((left == pad).all(1)[:, None], at, left)
                raw = self.raw(at) if epoch >= linear else self.bias + self.weights[at].sum(1)
                g = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[some]) / len(some)
                used, inverse = np.unique(at, return_inverse=True)
                inverse = inverse.reshape(at.shape)
                if epoch >= linear:
                    v = self.vectors[at]
                    each = g[:, None, None] * (v.sum(1)[:, None, :] - v)
                    dv = np.stack([np.bincount(inverse.ravel(), each[:, :, f].ravel(), len(used)) for f in range(v.shape[2])], 1) + decay * self.vectors[used]
                    gv[used] += dv * dv
                    self.vectors[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
                dw = np.bincount(inverse.ravel(), np.repeat(g, at.shape[1]), len(used)) + decay * self.weights[used]
                db = g.sum()
                gw[used] += dw * dw
                gb += db * db
                self.weights[used] -= rate * dw / np.sqrt(gw[used])
                self.bias -= rate * db / np.sqrt(gb)
                self.weights[pad] = 0
                self.vectors[pad] = 0


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [terms(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "terms"])


def pairs_that_tell(n: np.ndarray, p: np.ndarray, gain: float = PAIR_GAIN, least: int = LEAST_ROWS) -> np.ndarray:
    """Whether each term is in a pair that tells by its company: among the rows of either term, the other parts the labels.

    n and p count rows and positive rows of each pair of terms, and of each term on the diagonal. A word that comes
    with telling ones by chance does not part their rows, so it is not taken.
    """
    of = np.diag(n)[:, None].astype(np.float64)
    rate = np.diag(p)[:, None] / np.maximum(of, 1)
    spread = n * (1 - n / np.maximum(of, 1)) * rate * (1 - rate)
    within = np.where(spread > 0, (p - n * rate) ** 2 / np.maximum(spread, 1e-12), 0.0)
    # Both kinds of rows are wanted: with and without the other term.
    told = (np.minimum(within, within.T) >= gain) & (n >= least) & (of - n >= least) & (of.T - n >= least)
    np.fill_diagonal(told, False)
    return told.any(1)


def _pairs_of(known: DataFrame, terms_held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positive rows of each pair of terms; a task gives two matrices, whatever its rows."""
    size = len(terms_held)
    held = known.sparkSession.sparkContext.broadcast(terms_held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, p = np.zeros((size, size), np.int32), np.zeros((size, size), np.int32)
        for batch in pieces(batches):
            x = np.zeros((batch.num_rows, size), np.float32)
            for k, t in enumerate(batch.column(1)):
                x[k, places(held.value, np.asarray(t.values))] = 1
            positive = x[np.asarray(batch.column(0)) == 1]
            n += (x.T @ x).astype(np.int32)
            p += (positive.T @ positive).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], names=["n", "p"])

    n, p = np.zeros((size, size), np.int64), np.zeros((size, size), np.int64)
    # The sample is bounded, so a few tasks do and a few matrices come back.
    for row in known.coalesce(8).mapInArrow(count, "n binary, p binary").toLocalIterator():
        n += np.frombuffer(row.n, np.int32).reshape(size, size)
        p += np.frombuffer(row.p, np.int32).reshape(size, size)
    return n, p


def learn(rows: DataFrame, train_rows: int = TRAIN_ROWS, held_terms: int = TERMS, pair_terms: int = PAIR_TERMS,
          shares: dict | None = None) -> FactorizationMachine:
    """A machine learned from rows(doc_id, text, toxic), all of them or about train_rows drawn by hash; all if they were drawn before, by the shares given.

    It holds the terms of at least LEAST_ROWS rows that part the labels most (chi-square), and of pair_terms terms those
    that part them in company only. If rows were drawn, the bias is set back to the labels' shares in all rows. What reaches
    the driver is bounded by train_rows, held_terms and pair_terms.
    """
    labelled = rows.filter("toxic is not null").select("doc_id", "text", F.col("toxic").cast("boolean").cast("int").alias("toxic"))
    sample, shares = bounded_sample(labelled, "doc_id", "toxic", train_rows) if shares is None else (labelled, shares)
    known = materialize(sample.select("toxic", "text").mapInArrow(_terms_of, "toxic int, terms array<long>"), "terms")
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / n if n else 0.0
    counts = known.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    gain = F.pow(F.col("p") - F.col("n") * F.lit(share), 2) / (F.col("n") * F.lit(max(share * (1 - share), 1e-12)))
    common = materialize(counts.filter(F.col("n") >= LEAST_ROWS).select("term", F.least("n", F.lit(n) - F.col("n")).alias("parted"), gain.alias("gain")), "counts")
    told = [r[0] for r in common.filter(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "term").limit(held_terms).select("term").collect()]
    if 0 < positive < n:
        best = told[: pair_terms // 2]
        often = common.orderBy(F.desc("parted"), "term").limit(pair_terms).select("term").collect()
        tried = np.sort(np.array(list(dict.fromkeys([*best, *(r[0] for r in often)]))[:pair_terms], np.int64))
        if len(tried):
            told = [*told, *tried[pairs_that_tell(*_pairs_of(known, tried))].tolist()]
    machine = FactorizationMachine(np.unique(np.array(told, np.int64)))
    if not n or not 0 < positive < n:
        machine.bias = 40.0 * (2 * share - 1) if n else -40.0
        return machine
    held = known.sparkSession.sparkContext.broadcast(machine)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = [held.value.places(np.asarray(t.values)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int64()))], names=["toxic", "terms"])

    data = sorted((tuple(r.terms), r.toxic) for r in known.mapInArrow(narrowed, "toxic int, terms array<long>").toLocalIterator())
    machine.fit([np.array(t, np.int64) for t, _ in data], np.array([y for _, y in data], np.float64))
    machine.bias += float(np.log(shares[0] / shares[1]))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [held.value.score(terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Learns from labelled rows whose crc32(doc_id) mod 3 is not 1; scores see the whole text alone. Null and empty
    texts have no terms and score the machine's bias. Without labels of both kinds every score is
    near 0, or near 1 if all are toxic. Rows with a null id are scored and not held out; repeated rows score alike; repeated
    labels weigh more. An empty table gives an empty result.
    """
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    toxic = F.col("toxic").cast("boolean").cast("int").alias("toxic")
    marks = labels.filter("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), toxic).filter(~held_out)
    # Rows are counted and drawn without their texts.
    shares = label_shares(marks.join(docs.select("doc_id"), "doc_id"), "toxic", train_rows)
    some = materialize(drawn(marks, "doc_id", "toxic", shares), "drawn")
    # Labels without a document, or of one id, can be more than the bound: these are joined by a shuffle.
    some = F.broadcast(some) if some.count() <= 2 * train_rows else some.hint("merge")
    machine = learn(docs.select("doc_id", "text").join(some, "doc_id"), train_rows, shares=shares)
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
