"""The prefix trie against plain programming."""

import hashlib
import random
import zlib

import pytest

from sparkloom.llm import prefixtrie

from .util import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = set()
    for path, members in nodes.items():
        under = [q for q in nodes if q[: len(path)] == path]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == path)
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])),
                 sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(df):
    got = [tuple(r) for r in prefixtrie.prefix_trie(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(rng, n, longest, ids=range(-12, 60)):
    texts, rows = ["", None, "a", "b", "ü", "long " * 9], []
    for c in rng.sample(list(ids), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "user", None, ""]), rng.choice(texts[: rng.choice([1, 3, 6])])))
    return rows


@pytest.mark.parametrize(("bits", "pieces"), [(12, 8), (1, 1)])
def test_trie_equals_plain_programming(spark, monkeypatch, bits, pieces):
    monkeypatch.setattr(prefixtrie, "BLOCK_BITS", bits)
    monkeypatch.setattr(prefixtrie, "PIECE_BITS", pieces)
    rows = conversations(random.Random(bits), 40, 14) + [(None, 0, "user", "nobody's")]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(3)] + rows[:20]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert trie(clashing(df).repartition(7)) == want


def test_trie_of_few_rows(spark):
    for rows in ([(3, 0, "user", "x")], [(5, None, None, None)], [(1, 0, "user", "x"), (6, 0, "user", "x")], [(20, 0, "user", "x" * (3 << 20)), (21, 0, "user", "y")]):
        assert trie(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert trie(spark.createDataFrame([], SCHEMA)) == set()


def test_trie_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    df = prefixtrie.op13_prefix_trie(spark, d)
    assert {tuple(r) for r in df.collect()} == set(con.execute(f"SELECT {', '.join(df.columns)} FROM ({prefixtrie.OP13_SQL})").fetchall())


def test_queries_have_their_sql():
    from sparkloom.llm import queries

    sql = queries.oracle_sql()
    assert set(sql) <= set(queries.queries()) and len(queries.queries()) == 13
    assert all(isinstance(q, str) and "SELECT" in q for q in sql.values())
