"""The audit of sources against plain programming."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import divergence

from .util import clashing, docs, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(lower)))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in read}:
        held = Counter(t for x, _, n in read if x == lang for t in n)
        kept = sorted((t for t, k in held.items() if k >= least), key=str.encode)
        v, groups = len(kept), defaultdict(Counter)
        for x, source, n in read:
            if x == lang:
                groups[source].update(n)

        def share(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + v) for t in kept}

        whole = share(sum(groups.values(), Counter()))
        p = {s: share(n) for s, n in groups.items()}
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top}
    return out


def audit(df, **how):
    got = [tuple(r) for r in divergence.source_divergence(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("chunk_terms", "block_sources", "top"), [(4096, 64, 200), (3, 2, 4)])
def test_audit_equals_plain_programming(spark, chunk_terms, block_sources, top):
    rng = random.Random(top)
    words = ["ab", "Ab", "ça", "Ça", "été", "z", "a", "日本", "x1y", "\U0001f600", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(120):
        source = rng.choice(["hot", "hot", "s1", "s2", "s3", None, "ü"])
        text = rng.choice([" ", "-", " ", ",\n"]).join(rng.choices(words[: rng.randint(3, 30)], k=rng.randint(0, 12)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), source))
    rows += [("only once", "xx", "s"), (None, "xx", "t"), ("!!", "yy", "s"), ("a a a", "zz", "one"), ("a", "zz", "one"), ("a", "zz", "one"), ("", "zz", "empty")]
    rows += rows[:30]
    rows.append(("ab " * 800_000 + "z" * (2 << 20), "de", "hot"))
    got = audit(clashing(docs(spark, rows)).repartition(5), chunk_terms=chunk_terms, block_sources=block_sources, top=top)
    assert got == brute(rows, top=top)


def test_audit_of_an_empty_table(spark):
    assert audit(empty(spark)) == set()


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        n, v = rng.randint(0, 10**13), rng.randint(1, 10**9)
        c = rng.randint(0, n)
        assert divergence.shares(np.array([c]), n, v)[0] == 1 + 10**9 * (c + 1) // (n + v)


def test_audit_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    df = divergence.op12_divergence(spark, d)
    assert {tuple(r) for r in df.collect()} == set(con.execute(f"SELECT {', '.join(df.columns)} FROM ({divergence.OP12_SQL})").fetchall())
