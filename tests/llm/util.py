"""Fixtures and brute-force helpers of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=1):
    """A documents table from texts, or (text, lang, source) triples."""
    rows = []
    for i, t in enumerate(texts):
        text, lang, source = t if isinstance(t, tuple) else (t, "en", "s")
        rows.append((first + i, text, lang, source, len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Further columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "draw", "slice", "digest", "bands", "key", "u", "v", "n", "component", "spans", "score", "lang_pred", "weight", "hashes", "kept", "shard", "vector", "copies")
    return df.select("*", *(F.lit("x").alias(n) for n in names if n not in df.columns))


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ba", "ke", "lo", "mi", "su", "ran", "tel")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def components(nodes, links):
    """Least node reachable from each node."""
    low = {x: x for x in nodes}

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def empty(spark):
    return spark.createDataFrame([], DOCS)
