"""Merges, stream sinks, files a row and the search source."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparkloom.sources import filetree, merging, search


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_inserts_new_keys_once(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (2, "a")], "k int, v string")
    assert merging.merge_new(first.limit(0), path, ["k"]) == 0
    merging.merge_new(first, path, ["k"], folders=4)
    assert rows(merging.merged(spark, path)) == sorted([(1, "a"), (2, "a"), (None, "n")], key=str)
    files = {f: os.path.getmtime(f) for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names if n.endswith(".parquet"))}
    assert merging.merge_new(first, path, ["k"], folders=4) == 0
    second = spark.createDataFrame([(2, "changed"), (7, "new"), (None, "other")], "k int, v string")
    assert merging.merge_new(second, path, ["k"], folders=4) == 1
    assert rows(merging.merged(spark, path)) == sorted([(1, "a"), (2, "a"), (None, "n"), (7, "new")], key=str)
    # Folders without a new key are not written again.
    assert any(os.path.exists(f) and os.path.getmtime(f) == t for f, t in files.items())
    assert merging.merge_new(spark.createDataFrame([(7,), (8,)], "k int"), str(tmp_path / "keys only"), ["k"]) > 0


@pytest.mark.parametrize("keyed", [True, False])
def test_streams_store_every_batch_once(spark, tmp_path, keyed):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 15).selectExpr("id", f"{k} AS file").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, file int").option("maxFilesPerTrigger", 1).parquet(source)
    seen = []

    def die_once(number):
        seen.append(number)
        if seen.count(1) == 1 and number == 1:
            raise RuntimeError("killed between the batch and its commit")

    start = (lambda: merging.keyed_stream(stream, path, checkpoint, ["id"], after=die_once)) if keyed else (lambda: merging.batch_stream(stream, path, checkpoint, after=die_once))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    start().awaitTermination()
    start().awaitTermination()
    assert seen == [0, 1, 1, 2]
    ids = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(ids) == sorted(range(35) if keyed else [i for k in range(3) for i in range(k * 10, k * 10 + 15)])


def test_a_file_a_row(spark, tmp_path):
    folder = str(tmp_path / "tree")
    texts = [("a/b/c d.html", "né\nline\n"), ("a/x.htm", None), ("top+50%.html", "t"), ("a/b/c d.html", "zz")]
    df = spark.createDataFrame(texts, "path string, text string").repartition(3)
    for _ in range(2):
        filetree.write_files(df, folder)
    assert rows(filetree.read_files(spark, folder)) == [("a/b/c d.txt", "né\nline\n"), ("a/x.txt", ""), ("top+50%.txt", "t")]
    assert json.load(open(f"{folder}/{filetree.DONE}")) == {"files": 3, "bytes": 13}
    assert not [n for _, _, names in os.walk(folder) for n in names if n.endswith(".part")]
    for bad in ("../out.html", "/etc/x.html", None):
        with pytest.raises(Exception, match="not a path below"):
            filetree.write_files(spark.createDataFrame([(bad, "x")], "path string, text string"), folder)


def test_search_by_day_and_key(spark, tmp_path):
    path = str(tmp_path / "answers")
    found = [("2024-03-01", "q0 1/3", f"http://a.b/{i}", f"t{i}", "s", "Mar 01, 2024") for i in range(3)] + [("2024-03-02", "q1 2/3", "http://c.d/", "t", None, None)]
    search.write_answers(spark.createDataFrame(found, "day string, query string, url string, title string, snippet string, date string"), path)
    how = {"client": "sparkloom.sources.search:answers", "first": "2024-03-01", "last": "2024-03-02", "templates": ["q0 {day}/{month}", "q1 {day}/{month}", "q2 {day}/{month}"], "keys": ["k1", "k2"], "calls": 2, "wait": 0, "answers": path}
    df = search.read_links(spark, **how)
    # Six queries, two a key in turn: q0 q1 | q2 and q0 | q1 q2, by day.
    assert df.rdd.getNumPartitions() == 4
    got = rows(df.select(F.col("day").cast("string"), "query", "code", "url"))
    none = [("2024-03-01", "q1 1/3"), ("2024-03-01", "q2 1/3"), ("2024-03-02", "q0 2/3"), ("2024-03-02", "q2 2/3")]
    assert got == sorted([(d, q, 200, u) for d, q, u, *_ in found] + [(*x, 200, None) for x in none], key=str)
    assert rows(search.read_links(spark, **how, refused='["k2"]').select("query", "url")) == rows(df.select("query", "url"))
    refused = search.read_links(spark, **how, refused='["k1", "k2"]').collect()
    assert len(refused) == 6 and {(r.code, r.url) for r in refused} == {(429, None)}
    with pytest.raises(Exception, match="access keys"):
        search.read_links(spark, **{**how, "keys": []}).collect()
