"""From documents to token blocks: language, near duplicates, benchmark passages, mixing, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, minhash, mixing, tokenids
from sparkloom.llm.common import drop_scratch, finished, materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents are near copies at 100 * common shingles >= NEAR_PERCENT * all their shingles.
NEAR_PERCENT = 80


def _kept_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stage that adds columns and return the columns of docs, whatever further ones are called."""
    names = docs.columns
    safe = [n if n in COLUMNS else f"further_{i}" for i, n in enumerate(names)]
    return stage(docs.toDF(*safe)).select(*safe).toDF(*names)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `und` goes.

    Null and empty texts and texts without a letter are `und`. Whole texts are read, however long. Every row is judged by itself,
    so rows that repeat an id or a text fare alike; a null id is a row like others. An empty table stays empty; further columns pass, whatever they are called.
    """
    return _kept_columns(docs, lambda d: language.identify(d, keep=tuple(d.columns)).filter(F.col("lang_pred") != language.UNDETERMINED))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (NEAR_PERCENT of the shingles): that of the least id.

    Null and empty texts are like nothing and stay. Every row is a document: rows without an id and rows that repeat one are compared by
    their texts like others, come after all other rows (before them if ids reach 2 ** 62) and in any order among themselves. Texts are read whole. An empty table stays empty; further columns
    pass, whatever they are called.
    """
    def one_of_each(d: DataFrame) -> DataFrame:
        rows = _row_keys(d)
        found = materialize(minhash.near_duplicates(rows, "row_key", percent=NEAR_PERCENT), "duplicates")
        # One plan at every size: what goes grows with the corpus, so it is never broadcast.
        gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("row_key"))
        return rows.join(gone.hint("merge"), "row_key", "left_anti")

    return _kept_columns(docs, one_of_each)


def _row_keys(docs: DataFrame) -> DataFrame:
    """Docs with a row_key: the id if no other row has it, else a number of the row's own above all ids, or below them if ids reach 2 ** 62."""
    several = materialize(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "several")
    if several.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    low, high = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    own = F.monotonically_increasing_id()
    key = F.lit(high + 1) + own if high < 1 << 62 else F.lit(low - 1) - own
    repeated = docs.join(several.hint("merge"), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    repeated = materialize(repeated.withColumn("row_key", key), "repeated")
    single = docs.filter("doc_id is not null").join(several.hint("merge"), "doc_id", "left_anti")
    return single.withColumn("row_key", F.col("doc_id")).unionByName(repeated)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items: fewer than 5 % of the words lie in item windows.

    Null and empty texts have no words and stay. Every row is judged by itself, over its whole text; rows that repeat an id or a text fare
    alike, and a null id is a row like others. An empty table, or an empty benchmark, changes nothing; further columns pass, whatever they are called.
    """
    items = read_table(spark, sf_dir, "benchmark")
    return _kept_columns(docs, lambda d: decontaminate.find_contamination(d, items, keep=tuple(d.columns)).filter(~F.col("contaminated")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three rows of each, or none.

    Null and empty texts have no words and go. The null source is one of the sources. Ties of the draw (repeated ids, null ids) are
    ordered by size; rows that are equal in both are interchangeable. Whole texts are counted. An empty table stays empty; further columns pass, whatever they are called.
    """
    def repeated(d: DataFrame) -> DataFrame:
        mixed = mixing.mix(d, keep=tuple(d.columns)).filter("repeats > 0")
        return mixed.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("repeats"))))

    return _kept_columns(docs, repeated)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of the mix, as read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone. Rows follow their ids, a null one first; rows that repeat an id each have ids of their own, in any order
    if their texts differ. Whole texts are encoded. An empty table gives an empty result; further columns are not read.
    """
    return tokenids.token_ids(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: Language identification and tokenization have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        # What a stage wrote on the way goes when its result is stored, and so does its input.
        docs = finished(lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
        if before is not None:
            drop_scratch(before)
        before = docs
    return docs
