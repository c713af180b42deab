"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import os
import random
import re
import struct
import tempfile
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, embeddings, induced, language, minhash, mixing, sharding, suffixdedup, tokencounts, tokenids, toxicity
from sparkloom.llm.common import connected_components

from .util import DOCS, clashing, components, docs, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Components


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    order = rng.sample(range(100), 100)
    links = [*zip(order, order[1:]), *((200, 201 + i) for i in range(50)), (300, 300), (400, 401), (401, 400), (400, 401)]
    df = spark.createDataFrame([*links, (None, 1)], "u long, v long")
    want = components({x for e in links for x in e}, links)
    del want[300]  # a loop alone is no link
    assert {r.node: r.component for r in connected_components(df).collect()} == want


# 1


def brute_embeddings(rows, threshold=0.98):
    able = {}
    for i, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            able[i] = (a, label)
    links = collections.defaultdict(set)
    for i, (a, la) in able.items():
        for j, (b, lb) in able.items():
            if i != j and la == lb and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i].add(j)
    low = components([r[0] for r in rows], [(i, j) for i, js in links.items() for j in js])
    return {i: (len(links[i]), low[i], low[i] == i) for i, *_ in rows}


def embedding_rows(seed=0, n=160):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((i + 10, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, [-0.0, 1.0, 2.0], [0.0, 1.0, 2.0]]
    return rows + [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (2001, [2 * x for x in rows[0][1]], rows[0][2])]


@pytest.mark.parametrize("block, bucket", [(2048, 8192), (7, None), (16, 20)])
def test_embeddings_equal_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = embedding_rows()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, bucket=bucket).collect()}
    assert got == brute_embeddings(rows)


def test_embedding_bounds_hold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 64))
    b = a + rng.normal(size=a.shape) * 0.1
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    codes, factors = embeddings.encode(a)
    est = np.diag(embeddings.estimate(codes, factors, b))
    true = (a * b).sum(1)
    assert abs((est - true).mean()) < 0.02
    at = true >= 0.98
    assert at.any() and (est[at] >= embeddings.bound(factors, 64)[at] - 1e-4).all()


def test_embeddings_of_any_scale(spark):
    """Squares that overflow or vanish change no cosine."""
    rows = [(k, [x * f for x in v], 0) for k, (f, v) in enumerate(((1e200, (1.0, 2.0)), (1e-200, (1.0, 2.01)), (1.0, (1.0, 2.02)), (1e300, (-2.0, 1.0))))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 2


def brute_mix(rows, seed=mixing.SEED):
    size = {i: len(SPACE.findall(t or "")) for i, t, _ in rows}
    totals = collections.Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in totals else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    capped, total = set(), sum(totals.values())
    while True:
        left = total - sum(3 * totals[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        for s in names:
            target[s] = 3.0 * totals[s] if s in capped else left * weight[s] / w
        over = {s for s in names if target[s] > 3 * totals[s]} - capped
        if not over:
            break
        capped |= over
    out = {}
    for s in names:
        own = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        goal = int(target[s] + 1e-9)
        whole = goal // totals[s] if totals[s] else 0
        rest = goal - whole * totals[s]
        for _, i in own:
            extra = min(size[i], rest)
            rest -= extra
            out[i] = (size[i], totals[s], pytest.approx(target[s]), whole * size[i] + extra)
    return out


def test_mix_equals_water_filling(spark):
    rng = random.Random(5)
    texts = [(prose(rng, rng.randint(0, 40)), "en", rng.choice(["a", "b", "B", "é", "z", "𝒳", None, "big", "big", "big"])) for _ in range(150)]
    texts += [(None, "en", "void"), ("", "en", "void"), ("x", None, "tiny")]
    df = docs(spark, texts)
    got = mixing.mix(clashing(df)).collect()
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in got} == brute_mix([(i + 1, t, s) for i, (t, _, s) in enumerate(texts)])
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_of_repeated_rows(spark):
    df = docs(spark, [("a b c", "en", "s")] * 3)
    got = mixing.mix(df.selectExpr("1L doc_id", "text", "lang", "source", "n_chars")).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 9


def test_mix_of_more_sources_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    df = docs(spark, [(prose(rng, rng.randint(0, 30)), "en", rng.choice(["a", "b", None])) for _ in range(60)])
    want = sorted(map(tuple, mixing.mix(df, keep=("text",)).collect()), key=str)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(df, keep=("text",)).collect()), key=str) == want


def test_mix_plan_is_native(spark):
    plan = mixing.mix(docs(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 3


def brute_minhash(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = components(sets, links)
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
    return " ".join(w)


@pytest.mark.parametrize("hub_pairs", [256, 3])
def test_minhash_equals_brute_force(spark, monkeypatch, hub_pairs):
    monkeypatch.setattr(minhash, "HUB_PAIRS", hub_pairs)
    rng = random.Random(7)
    bases = [prose(rng, rng.choice([4, 6, 30, 150])) for _ in range(15)]
    texts = [edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 4])) for _ in range(120)]
    hot = prose(rng, 120)
    texts += [edited(rng, hot, rng.choice([1, 3, 4, 5, 8])) for _ in range(60)]
    texts += [None, "", " \n", "One", "one", "ONE two", "É é", "\x0b".join("abcdef"), " ".join("abcdef"), "word " * 3000, texts[0]]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(clashing(docs(spark, texts))).collect()}
    assert got == brute_minhash(list(enumerate(texts, 1)))


def test_bitmaps_rule_out_no_link(spark):
    rng = np.random.default_rng(47)
    rows = []
    for common, apart in [(6, 1), (12, 2), (17, 3), (34, 6), (340, 60), (3400, 600)] * 40:
        x = rng.permutation(np.unique(rng.integers(0, (1 << 64) - 1, common + apart, np.uint64)))
        a, b = x[: common + apart // 2], np.concatenate([x[:common], x[common + apart // 2 :]])
        maps = [minhash.bitmap(s) for s in (a, b)]
        rows.append((*(m.tolist() for m in maps), len(a), len(b), *(len(s) - int(np.bitwise_count(m.view(np.uint64)).sum()) for s, m in zip((a, b), maps))))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n long, m long, x long, y long")
    may = minhash._may_link("a", "b", *(df[c] for c in "nmxy"), minhash.PERCENT)
    assert df.filter(may).count() == len(rows)
    unlike = df.withColumn("b", F.array(*[F.lit(0)] * 32).cast("array<long>")).filter("n < 100")
    assert unlike.filter(may).count() == 0


def test_pairs_of_a_hub_are_dealt_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICES", 8)
    want = {(u, 7) for u in range(1000, 1300)} | {(u, u % 5) for u in range(1000, 1020)}
    pairs, parts = minhash._dealt(spark.createDataFrame(sorted(want), "u long, v long"))
    got = [tuple(r) for r in pairs.collect()]
    assert {(u, v) for u, v, _ in got} == want and len(got) == len(want)
    assert {part for _, v, part in got if v == 7} == set(range(8)) and {part for _, v, part in got if v != 7} == {0}
    assert sorted(map(tuple, parts.collect())) == sorted({(v, part) for _, v, part in got})


def test_minhash_edges(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    df = docs(spark, ["a b c", "a b c"]).selectExpr("if(doc_id = 1, null, 7L) doc_id", "text")
    assert sorted(map(tuple, minhash.near_duplicates(df.union(df)).collect()), key=str) == [(7, 1, 7, True)] * 2 + [(None, 1, None, True)] * 2


def test_minhash_of_repeated_ids_and_very_long_texts(spark):
    """Texts under one id are one document, linked with what either is like; texts beyond a piece are read whole."""
    rng = random.Random(8)
    a, b, long = prose(rng, 100), prose(rng, 100), prose(rng, 190_000)
    assert len(long) > 1 << 20
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, long), (5, long[:-40] + " other end"), (6, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df.repartition(parts)).collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 6, True)]


def test_minhash_at_another_similarity(spark):
    rng = random.Random(9)
    base = prose(rng, 104).split()
    near = [*base[:50], "x", *base[51:]]  # 95 of 105 shingles
    df = docs(spark, [" ".join(base), " ".join(near)])
    assert [sorted(r.component_id for r in minhash.near_duplicates(df, percent=p).collect()) for p in (90, 91)] == [[1, 1], [1, 2]]


def test_signature_densifies_and_estimates():
    rng = np.random.default_rng(2)
    x = rng.permutation(np.unique(rng.integers(0, (1 << 64) - 1, 400, np.uint64)))
    a, b = np.sort(x[:340]), np.sort(x[60:])
    want = 280 / 400
    assert np.mean(minhash.signature(a) == minhash.signature(b)) == pytest.approx(want, abs=0.12)
    assert np.mean(minhash.signature(a[:3], 1024) == minhash.signature(a[:3], 1024)) == 1
    same = 1 - np.unpackbits((minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint8)).mean()
    assert same == pytest.approx((1 + want) / 2, abs=0.05)


# 4


def test_language_held_out_accuracy(spark):
    rng = random.Random(11)
    letters = {"xx": ("ba", "ke", "lo"), "yy": ("tir", "ös", "un"), "zz": ("ñi", "qua", "ver")}
    rows = [(" ".join("".join(rng.choice(letters[k]) for _ in range(3)) for _ in range(rng.randint(3, 40))), k, "s") for k in letters for _ in range(60)]
    odd = [None, "", "1234 --", "漢字"]
    df = docs(spark, rows + [(t, None, "s") for t in odd])
    got = {r.doc_id: r for r in language.identify(clashing(df)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(got[i].lang_pred, k) for i, (_, k, _) in enumerate(rows, 1) if got[i].held_out]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    tail = [got[len(rows) + 1 + k].lang_pred for k in range(len(odd))]
    assert tail[:3] == ["und"] * 3 and tail[3] in letters
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify(docs(spark, [("abc", None, "s")])).collect()} == {"und"}


@pytest.mark.parametrize("kept", [0, 50, 8192])
def test_language_bundles_like_brute_force(monkeypatch, kept):
    monkeypatch.setattr(language, "KEPT", kept)
    monkeypatch.setattr(language, "_memory", language._Memory())
    rng = random.Random(3)
    texts = ["Ab  a", "x", "\u0416\u0443\u043a, \u0416\u0423\u041a! zebra 42", "\u8a9e\U00020000\u3042 \u8a9e", *(prose(rng, 40) for _ in range(20))]
    for text in [*texts, *texts]:
        spelt = [0]
        for c in text.lower():
            spelt += [ord(c)] if c.isalpha() else [0] if spelt[-1] else []
        spelt += [0] if spelt[-1] else []
        vectors = {c: language.letter_vectors(np.array([c]))[0].astype(int) for c in spelt}
        total = sum(np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c] for a, b, c in zip(spelt, spelt[1:], spelt[2:]))
        assert language.profile(text).tolist() == total.tolist()
    codes = np.array([0, *range(0x61, 0x7B), *range(0x4E00, 0x4E80)])
    letters = language.letter_vectors(codes).astype(int)
    assert set(np.unique(letters)) == {-1, 1} and np.abs(letters @ letters.T - 1024 * np.eye(len(codes))).max() < 220


def test_language_of_other_scripts(spark):
    rng = random.Random(41)
    rows, ranges = [], {"ru": (0x430, 32), "bg": (0x430, 32), "el": (0x3B1, 25), "he": (0x5D0, 27), "zh": (0x4E00, 2000), "ja": (0x3041, 80)}
    for lang, (first, n) in ranges.items():
        words = ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(2, 5))) for _ in range(200)]
        rows += [(" ".join(rng.choices(words, k=30)), lang, "s") for _ in range(80)]
    got = language.identify(docs(spark, rows), keep=("doc_id", "lang")).collect()
    for lang in ranges:
        held = [r.lang_pred == lang for r in got if r.held_out and r.lang == lang]
        assert len(held) >= 10 and np.mean(held) >= 0.95


def test_language_cosines_like_brute_force(spark):
    rng = random.Random(43)
    rows = [(prose(rng, 30) if k % 2 else " ".join(w[::-1] + "q" for w in prose(rng, 30).split()), "ab"[k % 2], "s") for k in range(60)]
    got = language.identify(docs(spark, rows)).collect()
    unit = lambda v: v / np.sqrt((v.astype(float) ** 2).sum())
    learned = {x: unit(sum(unit(language.profile(t)) for k, (t, y, _) in enumerate(rows) if y == x and zlib.crc32(str(k + 1).encode()) % 4 != 2)) for x in "ab"}
    for r in got:
        assert r.score == pytest.approx(float(unit(language.profile(rows[r.doc_id - 1][0])) @ learned[r.lang_pred]), abs=1e-5)


def test_language_does_not_see_labels(spark):
    rng = random.Random(12)
    rows = [(prose(rng, 20), rng.choice("ab"), "s") for _ in range(80)]
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, rows)).collect()}
    blind = [(t, None if zlib.crc32(str(i).encode()) % 4 == 2 else k, "other") for i, (t, k, _) in enumerate(rows, 1)]
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, blind)).collect()}


# 5


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=70), st.data())
def test_packing_round_trip(bits, ids, data):
    ids = np.array(ids, np.uint64) % np.uint64(1 << bits)
    packed = tokenids.pack_ids(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids)))
    assert tokenids.unpack_ids(packed, bits, first, len(ids) - first).tolist() == ids[first:].tolist()


def test_block_random_access():
    block = tokenids.Block(tokenids.write_block([5, None, 7], [2, 0, 3], np.arange(5, dtype=np.uint32), 11, 40))
    assert block.doc_ids == [5, None, 7] and block.before == 40 and [block.ids(i).tolist() for i in range(3)] == [[0, 1], [], [2, 3, 4]]


def test_token_ids_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(tokenids.VOCABULARY)
    t = Tokenizer.from_file(path)
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(1, 60)) + rng.choice(["", ".", "\nNext line", "  two", " 12.5%"]) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "a  b", " x", "it's don't", "<|endoftext|> x", "é ñu, çà.", "漢字 かな", "tab\tq", "a\x1cb \x1cc", "word " * 4000]
    df = clashing(docs(spark, texts))
    path_out = tempfile.mkdtemp() + "/blocks"
    tokenids.write_token_ids(df, path_out, path, block_ids=64)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenids.read_token_digest(spark, path_out).collect()}
    start, want = 0, {}
    for i, text in enumerate(texts, 1):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert got == want
    assert tokenids.token_ids(empty(spark)).count() == 0


# 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.sampled_from([2, 8, 1 << 22]), st.sampled_from([1, 3, 1 << 18]), st.sampled_from([1, 2, 1 << 10]), st.sampled_from([5, 1000]), st.sampled_from([np.uint8, np.int64]))
def test_suffix_order_and_prefixes(symbols, held, block, window, cap, kind):
    symbols = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    kept = induced.BLOCK, induced.WINDOW
    induced.BLOCK, induced.WINDOW = block, window
    try:
        with tempfile.TemporaryDirectory() as folder:
            out = list(induced.sorted_suffixes(np.array(symbols, kind), folder, cap, held))
            assert not any(files for _, _, files in os.walk(folder))
    finally:
        induced.BLOCK, induced.WINDOW = kept
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(symbols[a:], symbols[b:])) if x != y), len(symbols) - max(a, b))
    assert np.concatenate([p for p, _ in out]).tolist() == order
    assert np.concatenate([x for _, x in out]).tolist() == [0, *(min(cap, prefix(a, b)) for a, b in zip(order, order[1:]))]


def test_recursion_on_shards_beyond_held():
    """A mebibyte of prose and of passages around one core, sorted by recursion as in memory."""
    rng = np.random.default_rng(19)
    words = [rng.integers(99, 125, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(500)]
    prose_bytes = np.frombuffer(b" ".join(words[k] for k in rng.integers(0, 500, 1 << 17))[: 1 << 19], np.uint8)
    rows = rng.integers(97, 123, (1100, 464)).astype(np.uint8)
    rows[:, 60:400], rows[:, 463] = rng.integers(97, 123, 340), 1
    for shard in (prose_bytes, rows.ravel()):
        outs = []
        for held in (1 << 22, 1 << 15):
            began = time.perf_counter()
            with tempfile.TemporaryDirectory() as folder:
                blocks = list(induced.sorted_suffixes(shard, folder, 400, held, len(shard)))
            outs.append([np.concatenate(x) for x in zip(*blocks)])
            assert time.perf_counter() - began < 60
        assert (outs[0][0] == outs[1][0]).all() and (outs[0][1] == outs[1][1]).all()


def brute_removed(texts, length=400):
    data = {i: (t or "").encode() for i, t in texts}
    seen = collections.Counter(x[k : k + length] for x in data.values() for k in range(len(x) - length + 1))
    out = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[i] = (len(x), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, held", [(1024, 1 << 22), (1, 500), (3, 1 << 22)])
def test_repeated_passages_equal_brute_force(spark, hot, held):
    rng = random.Random(17)
    shared = [prose(rng, 90), prose(rng, 150), "é" * 450, "ab" * 300]
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(shared + ["", ""]) + prose(rng, rng.randint(0, 60)) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "x" * 399, "x" * 400, "y" * 401, "z" * 2000, shared[1][:399], shared[1][:400], shared[0] + "\0" + shared[0]]
    texts += [prose(rng, 30) + shared[1][20:360] + prose(rng, 30) for _ in range(8)]
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_passages(clashing(df), held=held, hot=hot).collect()}
    assert got == brute_removed(list(enumerate(texts, 1)))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sparkloom")]


def test_repeated_passages_of_very_long_texts_and_repeated_ids(spark):
    """Texts beyond a piece, one passage across the seam; rows that repeat an id, and null ids, are texts of their own."""
    rng = random.Random(18)
    block = prose(rng, 2000)
    long = prose(rng, 140_000)
    assert len(long) > suffixdedup.PIECE + 5000
    across = long[suffixdedup.PIECE - 700 : suffixdedup.PIECE + 700]
    rows = [(1, long), (2, across + block), (2, block), (None, "q" + across[300:900]), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_passages(df).collect())
    want = brute_removed(list(enumerate(t for _, t in rows)))
    assert got == sorted((i or 0, *want[k]) for k, (i, _) in enumerate(rows))


def test_repeated_passages_of_an_empty_table(spark):
    assert suffixdedup.repeated_passages(empty(spark)).count() == 0


# 7


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(19)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        words = prose(rng, rng.randint(5, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["dunce", "grubface", "DUNCE"]))
        rows.append(" ".join(words))
        labels.append((i + 1, int(toxic)))
    df = docs(spark, rows + [None, "", "word " * 5000])
    known = spark.createDataFrame(labels + [(5, None), (10**6, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(clashing(df), known).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7) for i in got)
    assert [got[900 + k].predicted for k in (1, 2, 3)] == [0, 0, 0]


def test_toxicity_of_a_sign_that_came_with_others_only(spark):
    rng = random.Random(37)
    signs = ["dunce", "grubface", "snotling", "ratbag", "twerp", "yokel"]
    rows, labels = [], []
    for i in range(1200):
        toxic = rng.random() < 0.15
        words = prose(rng, rng.randint(5, 60)).split()
        for sign in rng.sample(signs, 4) if toxic else []:
            words.insert(rng.randrange(len(words)), sign)
        rows.append(" ".join(words))
        labels.append((i + 1, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs(spark, rows + signs + [prose(rng, 30) + " " + s for s in signs] + [prose(rng, 30)]), known).collect()}
    assert [got[1201 + k].predicted for k in range(13)] == [1] * 12 + [0]
    assert all(got[i].predicted == y for i, y in labels if got[i].held_out)


def test_machine_scores_like_a_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.FactorizationMachine(np.arange(10, 60, 5), factors=4)
    machine.bias, machine.weights[:-1], machine.vectors[:-1] = -0.3, rng.normal(0, 0.5, 10), rng.normal(0, 0.5, (10, 4))
    for found in ([], [15], [10, 20, 55], [1, 11, 30, 35, 99]):
        at = [machine.held.tolist().index(x) for x in found if x in machine.held]
        raw = machine.bias + sum(machine.weights[i] for i in at)
        raw += sum(float(machine.vectors[i] @ machine.vectors[j]) for i in at for j in at if i < j)
        assert machine.score(np.array(found, np.int64)) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_machine_starts_from_bounded_log_odds():
    rows, labels = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], np.int64)] * 25, np.array([1.0, 1, 0, 0] * 25)
    machine = toxicity.FactorizationMachine(np.arange(2))
    machine.start(rows, labels)
    odds = np.log(50.5 / 51) - np.log(0.5 / 51)
    assert machine.weights[:2].tolist() == pytest.approx([odds - 2 * np.sqrt(1 / 50.5 + 1 / 0.5), 0.0]) and machine.bias == 0


def test_machine_fits_an_interaction():
    rows = [np.array(x, np.int64) for x in ([0], [1], [0, 1], [2])] * 100
    machine = toxicity.FactorizationMachine(np.arange(3))
    machine.fit(rows, np.array([0.0, 0, 1, 0] * 100), epochs=60)
    assert [round(machine.score(r)) for r in rows[:4]] == [0, 0, 1, 0]


def test_toxicity_learns_a_label_that_only_a_pair_tells(spark):
    rng = random.Random(29)
    rows, labels = [], []
    for i in range(1500):
        words, both = prose(rng, rng.randint(5, 30)).split(), [rng.random() < 0.5 for _ in range(2)]
        for word, there in zip(("gulfish", "xeroned"), both):
            if there:
                words.insert(rng.randrange(len(words)), word)
        rows.append(" ".join(words))
        labels.append((i + 1, int(both[0] != both[1])))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs(spark, rows), known).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels if got[i].held_out]) > 0.95


def test_company_tells_by_both_sides():
    # 0 xor 1 is the label, 2 comes with 0 by chance, 3 tells by itself.
    rng = np.random.default_rng(5)
    x = (rng.random((4000, 4)) < 0.5).astype(np.int64)
    y = x[:, 0] ^ x[:, 1]
    x[:, 3] = y & x[:, 3]
    n, p = x.T @ x, (x * y[:, None]).T @ x
    assert toxicity.pairs_that_tell(n, p)[:3].tolist() == [True, True, False]


def test_labels_share_the_sample(spark):
    assert language.even_shares({"a": 10, "b": 1000, "c": 3000}, 1010) == {"a": 1.0, "b": 0.5, "c": pytest.approx(1 / 6)}
    assert language.even_shares({"a": 1, "b": 2}, 5) == {"a": 1.0, "b": 1.0}
    rows = spark.range(4000).selectExpr("id", "if(id % 400 = 0, 'rare', 'often') lang")
    sample, shares = language.bounded_sample(rows, "id", "lang", 300)
    n = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert n["rare"] == 10 and shares["rare"] == 1.0 and 200 < n["often"] < 380


def test_toxicity_of_a_drawn_sample(spark):
    rng = random.Random(31)
    rows = [prose(rng, 20) + (" dunce" if k % 10 == 0 else "") for k in range(2000)]
    known = spark.createDataFrame([(k + 1, int(k % 10 == 0)) for k in range(2000)], "doc_id long, toxic int")
    got = toxicity.detect(docs(spark, rows), known, train_rows=300).collect()
    assert np.mean([r.predicted == (r.doc_id % 10 == 1) for r in got if r.held_out]) > 0.98


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.detect(docs(spark, ["a b", None]), none).collect()] == [0, 0]
    assert toxicity.detect(empty(spark), none).count() == 0


# 8


def best_segmentation(model, pieces, word):
    """Score and token count by trying every segmentation's prefix in order."""
    text = tokencounts.MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + n * model.byte_cost, best[end - 1][1] + n)]
        options += [(best[a][0] + pieces[text[a:end]], best[a][1] + 1) for a in range(end) if text[a:end] in pieces]
        best[end] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1]


def test_token_counts_equal_plain_programming(spark):
    names = ["▁", "a", "b", "ab", "▁a", "ba", "abba", "é", "▁ba", "bb"]
    model = tokencounts.Unigram(names)
    node_score = lambda p: -np.log((names.index(p) + 1) * sum(1 / (r + 1) for r in range(len(names))))
    pieces = {p: float(node_score(p)) for p in names}
    counter = tokencounts.Counter(model)
    rng = random.Random(23)
    words = ["".join(rng.choice("abéx漢") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    n_words, n_tokens, scores = counter.count([" ".join(words), None, "", "\tab\x0bab "])
    want = [best_segmentation(model, pieces, w) for w in words]
    assert (n_words[0], n_tokens[0]) == (300, sum(n for _, n in want)) and scores[0] == pytest.approx(sum(s for s, _ in want))
    assert n_words[1:] == [0, 0, 2] and n_tokens[1:3] == [0, 0]


def test_token_counts_query(spark):
    pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r for r in tokencounts.count_tokens(clashing(docs(spark, ["the nation", None, "", "x " * 9000, "the nation"]))).collect()}
    assert got[1].n_tokens == got[5].n_tokens > 0 and got[2].n_tokens == got[3].n_tokens == 0 and got[4].n_words == 9000
    assert tokencounts.count_tokens(empty(spark)).count() == 0


# 9


def one_jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        following = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=30), st.integers(1, 90))
def test_jump_hash(keys, shards):
    a = np.array(keys, np.int64).view(np.uint64)
    got, grown = sharding.jump_hash(a, shards), sharding.jump_hash(a, shards + 1)
    assert got.tolist() == [one_jump(k % (1 << 64), shards) for k in keys]
    assert all(x == y or y == shards for x, y in zip(got, grown))


def test_shards_and_slots(spark):
    rng = random.Random(29)
    texts = [prose(rng, rng.randint(0, 20)) for _ in range(400)] + [None, "", "é" * 9000]
    df = clashing(docs(spark, texts))
    df = df.union(df.filter("doc_id = 3")).union(df.filter("doc_id = 4").withColumn("doc_id", df.doc_id.cast("string").cast("long") * None))
    rows = sharding.assign_shards(df).collect()
    assert len(rows) == len(texts) + 2
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.shard == one_jump(r.doc_id or 0, 40) and r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by = {r.doc_id: r for r in rows}
    assert all((by[i]["size"], by[i].text_crc32) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts, 1))
    assert sharding.assign_shards(empty(spark)).count() == 0


# 10


def brute_hits(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for a in range(len(w) - n + 1):
                ks = windows.get(tuple(w[a : a + n]))
                if ks:
                    hit.update(range(a, a + n))
                    found |= ks
        names = sorted(str(k) for k in found if k is not None)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 21, 400])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(31)
    items = [(k, prose(rng, rng.choice([1, 2, 5, 12, 13, 14, 30]))) for k in range(25)]
    items += [(90, None), (91, ""), (92, items[3][1]), (3, items[3][1]), (None, "Null-item words"), (93, "ba ba ba"), (94, "é1 Ünder")]
    texts = []
    for _ in range(80):
        t = prose(rng, rng.randint(0, 80)).split(" ")
        w = rng.choice(items)[1] or ""
        cut = w.split(" ")[rng.choice([0, 0, 1]) :]
        at = rng.randint(0, len(t))
        texts.append(" ".join(t[:at] + [x.upper() if rng.random() < 0.3 else x for x in cut] + t[at:]))
    long = prose(rng, 200_000)
    assert len(long) > 1 << 20
    texts += [None, "", "--", "ba ba ba ba", "null item WORDS", "É1 ünder", "é1 Ünder", "word " * 3000, long, long[: 1 << 19] + " " + items[6][1] + " " + long[1 << 19 :]]
    items = [(k, t) for k, t in items if not t or len(t.split()) > 2 or k in (90, 91, 94, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(clashing(docs(spark, texts)), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute_hits(list(enumerate(texts, 1)), items)


def test_contamination_edges_and_cutting(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contamination(docs(spark, ["a b"]), none).collect()] == [False]
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    cut = decontaminate.remove_spans(decontaminate.find_contamination(docs(spark, ["é a, b-C d"]), bench, keep=("doc_id", "text")))
    assert cut.first().text == "é a,  d"


def test_scratch_is_cleared(spark):
    from sparkloom.llm import common

    def make():
        return common.materialize(spark.range(5), "on-the-way").filter("id > 2")

    df = common.finished(make, "some")
    assert df.count() == 2 and "on-the-way" not in " ".join(os.listdir(os.path.dirname(df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])))
    df = common.materialize(spark.range(3), "some")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and df.count() == 3
    common.drop_scratch(df)
    assert not os.path.isdir(folder)
    common.materialize(spark.range(3), "other")
    common.clear_scratch(spark)
    assert not os.path.isdir(os.path.dirname(folder))
