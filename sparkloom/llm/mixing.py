"""Mixing sources to target weights by capped water-filling (operator 2).

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
SEED = "mix-0"
#: Leading hex digits of the draw that name its slice; 4096 slices a source.
SLICE_DIGITS = 3
#: Sources whose rows of four numbers and a name are broadcast.
MOST_SOURCES = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows, or sums of rows, with source and size.

    Weights 1, 2, 3 repeat over the sources in code point order, null last. The
    level L with sum(min(max_epochs * size, L * weight)) = total is found by
    filling the sources in the order in which they reach their cap: clamping
    and resharing the excess until none is above ends at the same level.
    The table has one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("weights"),
        F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)).alias("filled"),
        F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, -1)).alias("spent"),
    )
    # The level if exactly the sources before this one are capped.
    level = (F.col("total") - F.coalesce("filled", F.lit(0))).cast("double") / (F.col("weights") - F.coalesce("spent", F.lit(0)))
    per = per.withColumn("level", level)
    # It holds at the first source that stays within its cap.
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Words that the mix takes from every row: doc_id, size, source_size, target, taken, repeats.

    A source's target is taken as whole repetitions of all its rows and one
    fractional repetition: rows in the order of a seeded draw (md5 of seed and
    id) until the words left over are spent; the row on which they end gives only
    the words still missing, so a source's words are its target rounded down. `repeats`
    counts the times a row is wholly taken, the ending row by rounding. Columns of keep are passed through.

    Null and empty texts have size 0 and take nothing. Repeated ids draw alike and
    are ordered by size; a null id draws as the empty string. An empty table gives an empty
    result. Other columns are ignored.

    No source is sorted and no text is moved: sums per slice of the draw, written once, tell in which slice a source
    ends. Rows of the slices before it are taken, those behind it not; only the rows of the one
    slice on which a source ends, one in some thousands, are ordered. What a source needs is one
    row, broadcast up to MOST_SOURCES of them and joined by shuffle beyond.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        *(F.col(c) for c in keep if c not in ("doc_id", "source", "size")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("draw", draw)
    rows = rows.withColumn("slice", F.conv(F.substring("draw", 1, SLICE_DIGITS), 16, 10).cast("int"))
    slices = materialize(rows.groupBy("source", "slice").agg(F.sum("size").alias("size")), "slices")
    goal = source_targets(slices, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    ends = starts.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # The first slice of a source that is not wholly taken, and the words that it still gives.
    stop = F.min(F.when(F.col("start") + F.col("size") > F.col("rest"), F.struct("slice", (F.col("rest") - F.col("start")).alias("left"))))
    per = ends.groupBy(F.col("source").alias("s")).agg(*(F.first(c).alias(c) for c in ("source_size", "target", "whole")), stop.alias("stop"))
    per = materialize(per.select("s", "source_size", "target", "whole", F.col("stop.slice").alias("stop"), F.col("stop.left").alias("left")), "goal")
    per = F.broadcast(per) if per.count() <= MOST_SOURCES else per
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("s")))
    at_end = F.coalesce(F.col("slice") == F.col("stop"), F.lit(False))
    run = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.coalesce(F.sum("size").over(run), F.lit(0))))
    clear = rows.filter(~at_end).withColumn("extra", F.when(F.col("slice") < F.col("stop"), F.col("size")).otherwise(0))
    out = clear.unionByName(rows.filter(at_end).withColumn("extra", last))
    return out.select(
        "doc_id", *(c for c in keep if c not in ("doc_id", "size")), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        (F.col("whole") + F.when(F.col("extra") * 2 > F.col("size"), 1).otherwise(0)).cast("int").alias("repeats"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("repeats")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-0:' || doc_id) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER o, 0) AS filled, coalesce(sum(weight) OVER o, 0) AS spent FROM w
      WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - filled AS DOUBLE) / CAST(weights - spent AS DOUBLE) AS lv FROM f),
m AS (SELECT arg_min(lv, cap / weight) AS level FROM l WHERE lv * weight <= cap),
g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level * weight, CAST(cap AS DOUBLE))) AS target FROM l, m),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
r AS (SELECT d.*, h.source_size, h.target, h.whole, CAST(floor(h.target) AS BIGINT) - h.whole * h.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, rest - run)) AS BIGINT) AS taken FROM r
"""
