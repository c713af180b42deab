"""Very long texts, repeated and null ids, and clashing columns in operators that judge or count rows by themselves."""

import random
import re
import struct
import zlib

import pytest

from sparkloom.llm import language, mixing, tokencounts, tokenids, toxicity

from .util import DOCS, clashing, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark):
    """(rows, table) with a text of some 2 MB, ids that repeat with the same and with other texts, and null ids."""
    rng = random.Random(41)
    long = prose(rng, 300_000)
    assert len(long) > 3 << 19
    some = [prose(rng, rng.randint(3, 30)) for _ in range(30)]
    rows = [(i + 1, t) for i, t in enumerate(some)]
    rows += [(3, some[2]), (3, some[2]), (3, some[9]), (4, None), (None, some[0]), (None, some[1]), (None, None), (None, ""), (77, long), (78, long), (None, long), (79, "x" * (1 << 16)), (80, "")]
    df = spark.createDataFrame([(i, t, rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 0) for i, t in rows], DOCS)
    return rows, clashing(df).repartition(5)


def by_row(found, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in found.collect()), key=str)


def test_mixing_of_odd_rows(spark):
    rows, df = table(spark)
    got = mixing.mix(df).collect()
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((i, len(SPACE.findall(t or ""))) for i, t in rows), key=str)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target * len({r.source_size for r in got if r.target == target})) <= 1


def test_language_of_odd_rows(spark):
    rows, df = table(spark)
    got = by_row(language.identify(df, keep=("doc_id", "text")), "text", "lang_pred", "score")
    assert [(i, t) for i, t, *_ in got] == sorted(((i, t) for i, t in rows), key=str)
    told = {}
    for _, t, lang, score in got:
        assert told.setdefault(t, (lang, score)) == (lang, score)
    assert told[None][0] == told[""][0] == language.UNDETERMINED and all(v[0] in ("en", "de") for t, v in told.items() if t)


def test_token_ids_of_odd_rows(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows, df = table(spark)
    t = Tokenizer.from_file(public.path(tokenids.VOCABULARY))
    encoded = {text: t.encode(text or "", add_special_tokens=False).ids + [0] for text in {x for _, x in rows}}
    got = tokenids.token_ids(df).collect()
    crc = {text: zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for text, x in encoded.items()}
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(encoded[x]), crc[x]) for i, x in rows), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_toxicity_of_odd_rows(spark):
    rows, df = table(spark)
    labels = spark.createDataFrame([(i % 40 + 1, i % 2) for i in range(50)] + [(None, 1), (77, 1), (3, None)], "doc_id long, toxic int")
    got = by_row(toxicity.detect(df, labels), "score", "predicted", "held_out")
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=str)
    assert all(0 <= score <= 1 and predicted == (score >= 0.7) for _, score, predicted, _ in got)
    # So many labels without a document that they are joined by a shuffle.
    absent = spark.range(10_000, 20_000).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    few = toxicity.detect(df, labels.union(absent), train_rows=20)
    assert [r[0] for r in by_row(few, "score")] == [r[0] for r in got]


def test_token_counts_of_odd_rows(spark):
    pytest.importorskip("public_tokenizers")
    rows, df = table(spark)
    got = by_row(tokencounts.count_tokens(df), "n_words", "n_tokens")
    assert sorted(r[:2] for r in got if r[0] is not None) == sorted((i, len(SPACE.findall(t or ""))) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    long = {(n, k) for i, n, k in got if i in (77, 78)}
    assert len(long) == 1 and (None, *next(iter(long))) in got
