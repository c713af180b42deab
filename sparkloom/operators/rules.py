"""Frequent itemsets and association rules over 0/1 columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


#: Items of one word of a row's bits, rows of one conditional base that a task takes, and numbers of the matrix that it multiplies at once.
WORD, BLOCK_ROWS, MATRIX = 32, 1 << 16, 1 << 22


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    """Rows of words to rows of n zeros and ones, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(words.astype("<u4")).view(np.uint8).reshape(len(words), -1), axis=1, count=n, bitorder="little")


def _grown(table: pa.Table) -> pa.Table:
    """A conditional base, rows that hold `last` as (words, n): what it holds of items before `last`, alone and in twos."""
    last = table["last"][0].as_py()
    words = table["words"].combine_chunks()
    words = words.flatten().to_numpy().reshape(len(words), -1)
    n, both = table["n"].to_numpy().astype(np.float64), np.zeros((last, last))
    step = max(1, MATRIX // max(last, 1))
    for at in range(0, len(words), step):
        held = _bits(words[at : at + step], last).astype(np.float64)
        # Exact: sums of whole numbers below 2 ** 53.
        both += (held * n[at : at + step, None]).T @ held
    x, y = np.nonzero(np.triu(both))
    return pa.table({"x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32()), "last": pa.array(np.full(len(x), last), pa.int32()), "n": pa.array(both[x, y].astype(np.int64))})


def itemsets(rows: DataFrame, items: Sequence[str], support: float = 0.05, longest: int = 3) -> DataFrame:
    """items (sorted array), n, support of every itemset of up to `longest` items (at most 3) that reaches the support, counted exactly.

    Pattern growth: frequent items are ranked by their counts, rows become bits of the ranks, and equal rows are counted once. Each item's conditional base, the rows that hold it
    cut to more frequent items, goes to tasks of its own in blocks; a task counts single items and twos of its base as a product of its bits with themselves, so a row of m items costs
    m rows of bits, not its m ** 3 / 6 triples. Sums of blocks that miss the support go. Rows of no item count in the support's base; null is not held. One count an item reaches the driver.
    """
    if not 1 <= longest <= 3:
        raise ValueError("itemsets have one to three items")
    spark, held = rows.sparkSession, {i: F.coalesce(F.col(i) == 1, F.lit(False)) for i in items}
    rows = stored(rows.select(*(c.alias(i) for i, c in held.items())), "transactions")
    found = rows.agg(F.count("*").alias("_total"), *(F.count_if(F.col(i)).alias(f"_n{k}") for k, i in enumerate(items))).first()
    total = found[0]
    counts = sorted(((found[k + 1], i) for k, i in enumerate(items)), key=lambda x: (-x[0], x[1]))
    ranked = [(i, n) for n, i in counts if total and n / total >= support]
    singles = spark.createDataFrame([([i], n) for i, n in ranked], "items array<string>, n long")
    share = (F.col("n") / F.lit(total or 1)).alias("support")
    if longest == 1 or len(ranked) < 2:
        return singles.select("items", "n", share)
    words = [sum(((F.col(i).cast("long") * (1 << k)) for k, (i, _) in enumerate(ranked[at : at + WORD])), F.lit(0).cast("long")) for at in range(0, len(ranked), WORD)]
    several = rows.groupBy(F.array(*words).alias("words")).agg(F.count("*").alias("n"))
    there = F.filter(F.sequence(F.lit(1), F.lit(len(ranked) - 1)), lambda k: F.getbit(F.get("words", F.floor(k / WORD).cast("int")), k % WORD) == 1)
    base = several.select("words", "n", F.explode(there).alias("last"))
    # An item's base has at most as many different rows as rows hold it.
    blocks = F.get(F.array(*(F.lit(-(-n // BLOCK_ROWS)) for _, n in ranked)), F.col("last"))
    base = base.withColumn("block", F.pmod(F.xxhash64("words"), blocks))
    grown = base.groupBy("last", "block").applyInArrow(_grown, "x int, y int, last int, n long")
    grown = grown.groupBy("x", "y", "last").agg(F.sum("n").alias("n")).filter(F.col("n") / F.lit(total) >= support)
    if longest == 2:
        grown = grown.filter("x = y")
    names = F.array(*(F.lit(i) for i, _ in ranked))
    sets = grown.select(F.array_sort(F.array_distinct(F.array(*(F.get(names, F.col(c)) for c in ("x", "y", "last"))))).alias("items"), "n")
    return singles.unionByName(sets).select("items", "n", share)


def rules(sets: DataFrame, confidence: float = 0.55, longest: int = 3, digits: int = 6) -> DataFrame:
    """antecedents, consequents, support, confidence, lift for every split of every frequent itemset."""
    split = None
    for size in range(2, longest + 1):
        at = range(1, size + 1)
        pick = lambda places: F.array(*(F.element_at("items", p) for p in places))
        pairs = [F.struct(pick(left).alias("a"), pick([p for p in at if p not in left]).alias("c")) for k in range(1, size) for left in combinations(at, k)]
        part = sets.filter(F.size("items") == size).select("items", "support", F.explode(F.array(*pairs)).alias("s"))
        split = part if split is None else split.union(part)
    one = lambda c, n: sets.select(F.col("items").alias(c), F.col("support").alias(n))
    r = split.select(F.col("s.a").alias("antecedents"), F.col("s.c").alias("consequents"), "support")
    r = r.join(one("antecedents", "sa"), "antecedents").join(one("consequents", "sc"), "consequents")
    r = r.select("antecedents", "consequents", F.round("support", digits).alias("support"), F.round(F.col("support") / F.col("sa"), digits).alias("confidence"),
                 F.round(F.col("support") / F.col("sa") / F.col("sc"), digits).alias("lift"))
    return r.filter(F.col("confidence") >= confidence)


def predicting(found: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rules whose consequents hold a label and whose antecedents hold none."""
    those = F.array(*(F.lit(x) for x in labels))
    return found.filter(F.arrays_overlap("consequents", those) & ~F.arrays_overlap("antecedents", those))


def top_rules(found: DataFrame, k: int) -> DataFrame:
    text = F.array_join("antecedents", ",")
    return found.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), text, F.array_join("consequents", ",")).limit(k)


def pattern(antecedents: Sequence[str]) -> Column:
    """1 where all antecedents hold."""
    out = F.lit(True)
    for a in antecedents:
        out = out & (F.col(a) == 1)
    return F.coalesce(out, F.lit(False)).cast("int")


def pattern_features(rows: DataFrame, items: Sequence[str], found: DataFrame, up: str, k: int = 10) -> DataFrame:
    """rows with pattern and hit for each of the k best rules: 1 where all its antecedents hold.

    A pattern is named by its place, the direction it predicts and its confidence. k rules of some items each are broadcast.
    """
    w = Window.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), F.array_join("antecedents", ","), F.array_join("consequents", ","))
    name = F.format_string("pat_%02d_%s_c%dp", F.row_number().over(w) - 1, F.when(F.array_contains("consequents", up), "up").otherwise("down"), F.round(F.col("confidence") * 100).cast("int"))
    best = top_rules(found, k).select(name.alias("pattern"), "antecedents")
    held = F.array_compact(F.array(*(F.when(F.col(i) == 1, F.lit(i)) for i in items)))
    hit = F.size(F.array_except("antecedents", held)) == 0
    return rows.crossJoin(F.broadcast(best)).withColumn("hit", hit.cast("int")).drop("antecedents")
