"""Near-duplicate embeddings by randomised-rotation binary codes (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, read_table

THRESHOLD = 0.98
#: Vectors compared with one another in one task; larger buckets are cut into such blocks.
BLOCK = 2048
#: Classes a bucket should hold; a label of more is spread by code bits.
BUCKET = 8192
#: Chance that a pair at the threshold shares no bucket, where labels are spread.
MISS = 1e-9
SEED = 20240521
_PAIRS = 1 << 16


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Binary codes (packed signs of the rotated unit vectors) and correction factors <code, vector>.

    A code stands for the unit vector sign / sqrt(dim) in the rotated space.
    """
    turned = unit @ rotation(unit.shape[1], seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unbiased inner-product estimates of coded vectors (rows) with unit queries (columns)."""
    return _code_products(codes, queries @ rotation(queries.shape[1], seed)) / factors[:, None]


def bound(factors: np.ndarray, dim: int, threshold: float = THRESHOLD, epsilon: float | None = None) -> np.ndarray:
    """Least estimate of a pair whose cosine reaches the threshold.

    With cosine c the estimate is c + sqrt(1 - c^2) * sqrt(1 - f^2) / f * z, where z is
    the code's error along a random direction: of size 1 at most, and about
    epsilon / sqrt(dim - 1) with a confidence set by epsilon. None takes the certain bound, so
    that no link is lost; the pairs above it are computed exactly.
    """
    z = 1.0 if epsilon is None or dim < 2 else min(1.0, epsilon / math.sqrt(dim - 1))
    return threshold - z * math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factors**2)) / factors


def _code_products(codes: np.ndarray, turned: np.ndarray) -> np.ndarray:
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (signs @ turned.T.astype(np.float32)) / np.float32(math.sqrt(dim))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def links_between(a: np.ndarray, b: np.ndarray | None, threshold: float, epsilon: float | None, coded: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of a and b with cosine >= threshold in double precision; i < j if b is None. coded: codes and factors of a."""
    unit = _unit
    other = a if b is None else b
    codes, factors = encode(unit(a)) if coded is None else coded
    products = _code_products(codes, unit(other) @ rotation(a.shape[1]))
    # The estimate is the product over the factor; 1e-4 covers its single precision.
    least = (bound(factors, a.shape[1], threshold, epsilon) * factors).astype(np.float32) - np.float32(1e-4)
    i, j = np.nonzero(products >= least[:, None])
    if b is None:
        i, j = i[i < j], j[i < j]
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((other * other).sum(1))
    sure = [np.einsum("ij,ij->i", a[i[k : k + _PAIRS]], other[j[k : k + _PAIRS]]) / (na[i[k : k + _PAIRS]] * nb[j[k : k + _PAIRS]]) >= threshold
            for k in range(0, len(i), _PAIRS)]
    sure = np.concatenate([*sure, np.zeros(0, bool)])
    return i[sure], j[sure]


def bucket_tables(largest: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: int | None = BUCKET) -> tuple[int, int]:
    """(code bits, tables) that spread a label of so many classes over buckets.

    A bit differs between two vectors with probability angle / pi, so a pair at the
    threshold shares a bucket of some table but with probability `miss`. Labels that fit in one bucket
    get one table of no bits: all pairs, exactly; so do all if bucket is None.
    """
    bits = max(0, math.ceil(math.log2(max(1, largest) / bucket))) if bucket else 0
    if not bits:
        return 0, 1
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - alike))


def _bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key per row and table: `bits` sign bits of a rotation of the table's own."""
    dim, out = unit.shape[1], np.zeros((len(unit), tables), np.int64)
    for t in range(tables if bits else 0):
        planes = np.random.default_rng([SEED, dim, t]).standard_normal((dim, bits))
        out[:, t] = (unit @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
    return out


def _by_length(v: pd.Series) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and scaled rows of the vectors of each length."""
    for dim in set(map(len, v)):
        where = [k for k, x in enumerate(v) if len(x) == dim]
        yield where, scaled(np.array([v.iloc[k] for k in where], np.float64))


def _least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each index's component under the links i-j."""
    low = np.arange(n)
    while len(i):
        to = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, to)
        np.minimum.at(low, j, to)
        low = low[low]
        if (low == before).all():
            break
    return low


def _compare(threshold: float, epsilon: float | None):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One block, or two against each other: each vector's links here and a vector it is connected to."""
        first = rows.side.to_numpy() == 0
        vectors = scaled(np.array(rows.vector.tolist(), np.float64))
        keys = np.array(rows["keys"].tolist(), np.int64)
        ids, copies, table = rows.vec_id.to_numpy(), rows.copies.to_numpy(), int(rows.table.iloc[0])
        at = np.flatnonzero(first)
        alone = bool(rows.alone.iloc[0])
        to = at if alone else np.flatnonzero(~first)
        if not len(at) or not len(to):
            return pd.DataFrame({"vec_id": [], "n": [], "to": []})
        codes = np.frombuffer(b"".join(rows.code.iloc[at]), np.uint8).reshape(len(at), -1)
        i, j = links_between(vectors[at], None if alone else vectors[to], threshold, epsilon, (codes, rows.factor.to_numpy()[at]))
        i, j = at[i], to[j]
        if table:  # a pair counts in the first table in which it meets
            new = [~(keys[i[k : k + _PAIRS], :table] == keys[j[k : k + _PAIRS], :table]).any(1) for k in range(0, len(i), _PAIRS)]
            new = np.concatenate([*new, np.zeros(0, bool)])
            i, j = i[new], j[new]
        n = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        low = ids[order][_least_linked(len(ids), place[i], place[j])[place]]
        some = n > 0
        return pd.DataFrame({"vec_id": ids[some], "n": n[some].astype(np.int64), "to": low[some]})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, epsilon: float | None = None, bucket: int | None = BUCKET, miss: float = MISS,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows are linked if their labels are equal and not null and the cosine is at least the threshold
    in double precision; vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a label or an id, link with nothing. Vectors of unequal length never link.
    Equal vectors of a label are one class, compared once. A class's rows link with one another and
    with all rows of the classes linked to it. Rows that repeat an id are vectors of
    their own that share a component. An empty table gives an empty result.

    Finite vectors whose squares overflow or vanish are compared by their direction like others.

    Codes and correction factors are computed once a class and stored with it. Classes of a label meet in buckets
    (bucket_tables; bucket=None compares all pairs of a label, however many) that are cut into
    blocks of BLOCK; each pair of blocks is a task in which the stored codes and factors of the one and the turned vectors of the other
    pick the pairs to compute exactly. A task returns a row a vector, its number of links and a
    least connected vector, so a group of n near copies never emits its pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    # The largest size of a component: null, NaN or infinite if any component is.
    peak = F.aggregate("vector", F.lit(0.0), lambda s, x: F.when(s.isNull() | x.isNull(), None).otherwise(F.greatest(s, F.abs(x))))
    sound = F.coalesce((peak > 0) & (peak < float("inf")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    able = rows.filter(sound)
    copies = able.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    @F.pandas_udf("code binary, factor double")
    def coded(v: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(v)
        for where, x in _by_length(v):
            for k, code, factor in zip(where, *encode(_unit(x))):
                out[k] = (code.tobytes(), factor)
        return pd.DataFrame(out, columns=["code", "factor"])

    classes = copies.select(F.monotonically_increasing_id().alias("class"), "label", "vector", "rep", "copies", coded("vector").alias("coded"))
    classes = materialize(classes.select("class", "label", "vector", "rep", "copies", "coded.code", "coded.factor"), "classes")
    member = able.join(classes.drop("code", "factor"), ["label", "vector"]).select("vec_id", "class", "rep", "copies")
    member = materialize(member, "member")

    sizes = classes.withColumn("dim", F.size("vector")).groupBy("label", "dim").count()
    bits, tables = bucket_tables(sizes.agg(F.max("count")).first()[0] or 0, threshold, miss, bucket)

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        for where, x in _by_length(v):
            for k, found in zip(where, _bucket_keys(_unit(x), bits, tables)):
                out[k] = found
        return pd.Series(out)

    keyed = classes.select(F.col("class").alias("vec_id"), "label", "vector", F.size("vector").alias("dim"), "copies", "code", "factor", keys("vector").alias("keys"))
    placed = keyed.select("*", F.posexplode("keys").alias("table", "key"))
    at = ["label", "dim", "table", "key"]
    held = placed.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = placed.join(held, at)
    mine = F.pmod(F.xxhash64("vec_id", "table"), "blocks").alias("mine")
    # Each vector goes to the pairs (low, high) of blocks that its own is part of.
    dealt = placed.select("*", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        *at, "vec_id", "vector", "copies", "code", "factor", "keys", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("alone"))
    found = materialize(
        dealt.groupBy(*at, "low", "high").applyInPandas(_compare(threshold, epsilon), "vec_id long, n long, to long"), "links")

    totals = found.groupBy(F.col("vec_id").alias("class")).agg(F.sum("n").alias("n"))
    names = classes.select("class", "rep")
    ends = found.select(F.col("vec_id").alias("class"), "to").filter("`class` <> to").distinct()
    ends = ends.join(names, "class").select(F.col("rep").alias("u"), F.col("to").alias("class")).join(names, "class").select("u", F.col("rep").alias("v"))
    edges = ends.union(member.filter("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    parts = connected_components(edges)
    linked = member.join(totals, "class", "left").select("vec_id", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = rows.filter(~sound).select("vec_id", F.lit(None).cast("long").alias("rep"), F.lit(0).cast("long").alias("n_links"))
    out = linked.union(alone).join(parts, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e
      WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS hit FROM e UNION SELECT p.u AS node, r.hit FROM r JOIN p ON p.v = r.node WHERE r.hit < p.u),
m AS (SELECT node, min(hit) AS component_id FROM r GROUP BY node),
c AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e JOIN m ON m.node = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""
