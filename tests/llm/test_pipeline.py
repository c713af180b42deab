"""The corpus pipeline against a composition of the brute-force versions."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from .test_llm import brute_hits, brute_minhash, brute_mix, edited
from .util import DOCS, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(37)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(k, prose(rng, 20)) for k in range(6)]
    bases = [prose(rng, 40) for _ in range(12)]
    texts = [edited(rng, rng.choice(bases), rng.choice([0, 1, 6, 9])) for _ in range(60)] + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    texts += [f"{prose(rng, 30)} {t} {prose(rng, 10)}" for _, t in items] + [f"{prose(rng, 900)} {items[0][1]}", None, "", "12 34", "\n"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "c", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "kept": F.lit("x"), "n_words": F.lit(0)})
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_pipeline_equals_brute_force(spark, folder):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    path, rows, items = folder
    kept = [(i, t, s) for i, t, _, s, _ in rows if t and any(c.isalpha() for c in t)]
    stays = brute_minhash([(i, t) for i, t, _ in kept], corpus_pipeline.NEAR_PERCENT)
    kept = [r for r in kept if stays[r[0]][2]]
    hits = brute_hits([(i, t) for i, t, _ in kept], items)
    assert any(h[4] for h in hits.values()) and any(h[1] and not h[4] for h in hits.values())
    kept = [r for r in kept if not hits[r[0]][4]]
    mixed = brute_mix(kept)
    times = {i: taken // size + (taken % size * 2 > size) for i, (size, _, _, taken) in mixed.items()}
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, text, _ in sorted(kept):
        for _ in range(times[i]):
            ids = t.encode(text, add_special_tokens=False).ids + [0]
            want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)


def test_stages_keep_the_columns_and_handle_edges(spark, folder):
    import corpus_pipeline

    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    none = docs.limit(0)
    twice = docs.filter("doc_id < 3").union(docs.filter("doc_id < 3"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, none, path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, path).count() == 0
    rows_of = docs.filter("doc_id < 3").count()
    alone = corpus_pipeline.near_duplicate_stage(spark, twice, path).collect()
    assert len(alone) == len({r.doc_id for r in alone}) <= rows_of
    nulls = docs.filter("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.near_duplicate_stage(spark, nulls, path).count() == 2


def test_near_duplicates_go_by_row(spark, folder):
    import corpus_pipeline

    path, *_ = folder
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    # Id 1 has two texts, of which one is a copy of another row's; rows without an id are copies too.
    rows = [(1, a), (1, b), (2, c), (3, b + " end"), (None, c), (None, d), (None, d), (None, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for shift, other in ((0, b + " end"), (1 << 62, b)):
        keyed = docs.withColumn("doc_id", F.col("doc_id") + F.lit(shift))
        got = corpus_pipeline.near_duplicate_stage(spark, keyed, path).collect()
        assert sorted(r.text or "" for r in got) == sorted([a, other, c, d, "", "", ""])
        assert {r.doc_id is None for r in got if r.text == c} == {shift > 0}


def test_near_duplicates_at_the_stages_similarity(spark, folder):
    import corpus_pipeline

    path, *_ = folder
    words = [f"w{k}" for k in range(104)]
    # 100 shingles each, 10 or 12 of them different: 90 of 110 (81.8 %) and 88 of 112 (78.6 %).
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:94] + [f"x{k}" for k in range(10)])), (3, " ".join([f"y{k}" for k in range(12)] + words[12:]))], "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, path).collect()) == [1, 3]
