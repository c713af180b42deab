"""The trie of conversation prefixes by smallest-member ownership (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialize, read_table

#: Conversations borrow turns from the one whose id is the multiple of FAMILY at or below theirs, fewer than MOST_BORROWED of them.
FAMILY = 5
MOST_BORROWED = 9
#: Turns of one conversation that meet in a task, and ids that lie in one piece of a list of ids, as powers of two.
BLOCK_BITS, PIECE_BITS = 12, 8

_NODE = ("depth", "a", "b")


def _borrowed(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_BORROWED).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, bytes): each turn's place in its conversation, a digest of role and text, and the text's size; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    # Rows that are equal up to `row` are interchangeable.
    return numbered(rows, [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")], ["conv_id"], "n").select("conv_id", "n", "digest", "bytes")


def _blocks(convs: DataFrame, last: str) -> DataFrame:
    """convs once for each block of its turns 0 .. last, so that a join with turns by (conv_id, block) gets no long conversation whole."""
    return convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(last, BLOCK_BITS))))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the exchange of first turns, from a table of conv_id, turn, role and text.

    Conversations: conv_id, length (0 if no turn is left). Turns: conv_id, depth from 1, digest, bytes, length. Turns are ordered by turn, null first, those of the same turn by a
    digest of role and text. Null roles and texts are empty; rows without a conv_id belong to no conversation. Other columns are ignored.
    """
    turns = materialize(_turns(conversations), "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("n").alias("turns"))
    convs = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "borrows": _borrowed(F.col("conv_id"))})
    lenders = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("lent"))
    convs = convs.join(lenders, "base", "left").withColumn("head", F.least("borrows", F.coalesce("lent", F.lit(0))))
    convs = convs.withColumn("length", F.col("head") + F.greatest(F.col("turns") - F.col("borrows"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "borrows", "head", "turns", "length"), "conversations")
    # At most 2 * FAMILY - 1 conversations borrow the first turns of one.
    lent = turns.filter(F.col("n") < MOST_BORROWED).select(F.col("conv_id").alias("base"), F.col("n").alias("depth"), "digest", "bytes")
    heads = lent.join(convs.filter("head > 0").select("conv_id", "base", "head", "length"), "base").filter("depth <= head")
    own = turns.filter(F.col("n") > _borrowed(F.col("conv_id"))).withColumn("block", F.shiftright("n", BLOCK_BITS))
    tails = own.join(_blocks(convs, "turns").select("conv_id", "block", "borrows", "head", "length"), ["conv_id", "block"])
    tails = tails.withColumn("depth", F.col("n") - F.col("borrows") + F.col("head"))
    names = ("conv_id", "depth", "digest", "bytes", "length")
    return convs.select("conv_id", "length"), heads.select(*names).unionByName(tails.select(*names))


def _prefixes(path: DataFrame) -> DataFrame:
    """Turns with the fingerprint (a, b) of all turns up to them, that of those before them (pa, pb), and the bytes before them.

    A fingerprint is the exclusive or of 128 bits of every (depth, digest); sums run inside blocks of turns, and those of the blocks before a block are added.
    """
    path = path.withColumns({"x": F.xxhash64("depth", "digest"), "y": F.xxhash64("digest", "depth", F.lit(1)), "block": F.shiftright("depth", BLOCK_BITS)})
    run = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = path.withColumns({"a": F.bit_xor("x").over(run), "b": F.bit_xor("y").over(run), "before": F.sum("bytes").over(run) - F.col("bytes")})
    # Only conversations of several blocks have blocks before one.
    totals = path.filter(F.col("length") >= 1 << BLOCK_BITS).groupBy("conv_id", "block").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", F.bit_xor("x").over(earlier).alias("ea"), F.bit_xor("y").over(earlier).alias("eb"), F.sum("bytes").over(earlier).alias("eb_bytes")).filter("block > 0")
    rows = rows.join(totals, ["conv_id", "block"], "left")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({"a": F.col("a").bitwiseXOR(F.coalesce("ea", none)), "b": F.col("b").bitwiseXOR(F.coalesce("eb", none)), "before": F.col("before") + F.coalesce("eb_bytes", none)})
    return rows.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "bytes", "before", "length")


def _first_members(rows: DataFrame) -> DataFrame:
    """rows with `first`: this conversation is the smallest of its slice of the prefix's members; and `goes_on`: a member of the slice has a further turn.

    The members of a prefix are dealt to as many slices as a shuffle has partitions, so no prefix, however common, meets in one task.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = Window.partitionBy(*_NODE, F.pmod(F.xxhash64("conv_id"), F.lit(slices)))
    return rows.withColumns({"first": F.col("conv_id") == F.min("conv_id").over(members), "goes_on": F.max(F.col("length") > F.col("depth")).over(members)})


def _suffixes(marked: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a conversation: owned (the depth from which it owns the nodes of its path; beyond its length if none), unowned (bytes of the
    turns before that), leaf (1 if its last node is owned and has no child), and length."""
    members = Window.partitionBy(*_NODE)
    owners = marked.filter("first").withColumns({"owner": F.min("conv_id").over(members), "goes_on": F.max("goes_on").over(members)}).filter("conv_id = owner")
    suffix = owners.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("top"), F.max((~F.col("goes_on")).cast("int")).alias("leaf"))
    whole = marked.filter("depth = length").select("conv_id", (F.col("before") + F.col("bytes")).alias("all_bytes"))
    return convs.join(suffix, "conv_id", "left").join(whole, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("top.depth", F.col("length") + 1).alias("owned"),
        F.coalesce("top.before", "all_bytes", F.lit(0)).alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node's list; pieces come in order, one after the other, and only one is held."""
    node, state = None, None

    def rows(done: list) -> pa.RecordBatch:
        columns = [pa.array([n[k] for n, _ in done], pa.int64()) for k in range(len(_NODE))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([h for _, h in done], pa.string())], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        done = []
        *keys, pieces = (c.to_pylist() for c in batch.columns)
        for key, piece in zip(zip(*keys), pieces):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(piece.encode())
        yield rows(done)
    if node is not None:
        yield rows([(node, state.hexdigest())])


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): digests of the sorted ids, joined by commas.

    Ids are joined in pieces of near ids first, so what a node's digest reads is a row for each piece of up to 256 ids, streamed in order.
    """
    pieces = rows.groupBy(*_NODE, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*_NODE, "piece", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))
    pieces = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "piece")
    return pieces.select(*_NODE, "ids").mapInArrow(_list_digests, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of first turns and is named by its smallest member and its depth. Each conversation owns the nodes of which
    it is the smallest member, a suffix of its path. So saved tokens, summed over a node's subtree, are the tokens of all occurrences
    of its nodes minus those of the owned ones; with the flags of owned leaves and children they come from one grouping by prefix.

    Null roles and texts are empty turns and count; a null turn stands first; rows without conv_id are left out. Ties in turn and repeated rows are
    turns of their own, ordered by a digest of role and text. A conversation left without turns is a member of the root. Texts are read whole and never moved. An empty table has no root.
    Prefixes are told apart by 128 bits of hash; a common prefix is dealt to slices, a long conversation to blocks of turns.
    """
    spark = conversations.sparkSession
    convs, path = rebuilt(conversations)
    marked = materialize(_first_members(_prefixes(path)), "prefixes")
    suffixes = materialize(_suffixes(marked, convs), "suffixes")
    rows = marked.drop("length").withColumn("block", F.shiftright("depth", BLOCK_BITS)).join(_blocks(suffixes, "length"), ["conv_id", "block"])
    none = F.lit(0).cast("long")
    root = suffixes.select("*", *(none.alias(c) for c in ("depth", "a", "b", "pa", "pb", "before")))
    names = ("conv_id", *_NODE, "pa", "pb", "before", "length", "owned", "unowned", "leaf")
    rows = rows.select(*names).unionByName(root.select(*names))
    further, top = F.col("depth") + 1, F.col("depth") == F.col("owned")
    nodes = rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.sum(((further >= F.col("owned")) & (further <= F.col("length"))).cast("long")).alias("n_children"), F.sum("leaf").cast("long").alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("owned"), F.col("unowned") - F.col("before")).otherwise(0)).alias("saved_tokens"),
        F.max(F.when(top, F.col("pa"))).alias("pa"), F.max(F.when(top, F.col("pb"))).alias("pb"))
    nodes = materialize(nodes, "nodes")
    ends = marked.filter("depth = length").select(*_NODE, "conv_id").unionByName(suffixes.filter("length = 0").select(*(none.alias(c) for c in _NODE), "conv_id"))
    # The owner of a node owns its parent too, but where its suffix begins; below the root that is the smallest of all.
    smallest = suffixes.agg(F.min("conv_id")).first()[0]
    shared = nodes.filter("n_convs > 1 and depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
    begins = F.col("pa").isNotNull() & (F.col("depth") > 1)
    below = nodes.filter(begins).join(shared, ["depth", "pa", "pb"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(smallest)).when(F.col("depth") > 1, F.col("conv_id")).cast("long")
    out = below.withColumn("parent", F.coalesce("parent", "conv_id")).unionByName(nodes.filter(~begins).withColumn("parent", parent))
    return out.join(_ends(ends), list(_NODE), "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


# crc32 by its bits, as SQL has no function for it.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS turns FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h FROM s),
r AS (
  SELECT c.conv_id, t.n AS depth, digest, bytes FROM c JOIN t ON t.conv_id = c.base WHERE t.n <= h
  UNION ALL
  SELECT c.conv_id, t.n - h + least(h, coalesce(b.turns, 0)), digest, bytes FROM c JOIN t USING (conv_id) LEFT JOIN s b ON b.conv_id = c.base WHERE t.n > h),
p AS (
  SELECT conv_id, depth, bytes, list(digest) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path, depth),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (
  SELECT n.path[1:i] AS path, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM n) n LEFT JOIN k ON k.path = n.path GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, a.n_leaves,
       CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN a ON a.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]
"""
