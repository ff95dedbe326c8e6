"""Conversation prefix trie by collapsing whole sequences.

Identical rebuilt conversations become one weighted sequence with the list of those that end
there, so only different sequences are expanded into prefixes: no more rows than there are
turns. A sequence that is a proper prefix of another is dropped by an anti-join; the others
are the leaves. Weighted prefixes are summed into nodes. What is summed over a subtree is
summed along leaves: a node counts on one leaf below it only, each leaf carries the sums from
every depth to its end, and a node adds up those of its leaves.

A prefix is named by its depth and four sums of 32-bit parts of md5(place, turn), so that a
conversation of any length is cut in blocks of turns: each block is a window of its own, and
the blocks' totals are summed after.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.links import small_batches
from gridspark.llm.text import column
from gridspark.operators.index import global_index
from gridspark.runtime import settle, ship_package

BLOCK = 4096
LANES = ("s0", "s1", "s2", "s3")
MOST_LENT = 8
PIECE = 8000
NO_END = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, place: str, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds, for each column of ``sums``, its sum over the rows of a key up to this place.

    Places start at 0 and are at most as many as rows; a block of them is a window of its own.
    """
    blocked = rows.withColumn("_block", F.expr(f"{place} div {block}"))
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    part = blocked.withColumns({out: F.sum(c).over(inside) for c, out in sums.items()})
    totals = blocked.groupBy(key, "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of a key; the blocks of a short sequence are one.
    starts = totals.select(key, "_block", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums])
    placed = part.join(starts, [key, "_block"])
    return placed.withColumns({out: F.col(out) + F.col(f"_t_{c}") for c, out in sums.items()}).drop(
        "_block", *[f"_t_{c}" for c in sums])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_md5, n_bytes) of every turn of a conversation with an id.

    Places count from 0 in the order of turn (null first), then role and text; a null role or
    text is empty. They come from one range partitioning of all rows, so that a conversation
    may have any share of them.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = global_index(rows, ["conv_id", "turn", "role", "text"], "at")
    first = settle(placed.groupBy("conv_id").agg(F.min("at").alias("first")))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return settle(placed.join(first, "conv_id").select(
        "conv_id", (F.col("at") - F.col("first")).alias("pos"), F.md5(whole.cast("binary")).alias("turn_md5"),
        F.octet_length("text").cast("bigint").alias("n_bytes")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ends) after each conversation c borrows the head of conversation c - c % 5.

    Its own first h turns, h = crc32(c) % 9, give way to the first h of that one (all if it
    has fewer). ``ends`` has a row (conv_id, n) for each conversation, with its new length.
    """
    sizes = settle(turns.groupBy("conv_id").agg(F.count("*").alias("own")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    ids = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    lent = F.least("h", F.coalesce("there", F.lit(0)))
    plan = settle(ids.join(bases, "base", "left").withColumn("lent", lent).withColumn(
        "n", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    own = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_md5", "n_bytes")
    heads = turns.where(F.col("pos") < MOST_LENT).withColumnRenamed("conv_id", "base")
    # At most eight turns and nine conversations meet at a base.
    head = heads.join(plan.select("conv_id", "h", "base"), "base").where("pos < h").select(
        "conv_id", "pos", "turn_md5", "n_bytes")
    return own.unionByName(head), plan.select("conv_id", "n")


def _lane(md5, k: int) -> Column:
    return F.conv(F.substring(md5, 8 * k + 1, 8), 16, 10).cast("bigint")


def _name(depth, *lanes) -> Column:
    return F.concat_ws("-", depth, *lanes)


# The name of no turns at all: depth 0 and empty sums.
ROOT = "0-0-0-0-0"


def _pieces(batches):
    """Sorted (seq, conv_id) as (seq, smallest id, ids joined by commas) of bounded size."""
    def out(rows):
        seqs, firsts, texts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [column(seqs, pa.int64()), column(firsts, pa.int64()), column(texts, pa.string())], names=["seq", "first", "ids"])

    open_seq, held, size = None, [], 0
    for batch in batches:
        done = []
        for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (seq != open_seq or size > PIECE):
                done.append((open_seq, held[0], ",".join(map(str, held))))
                held, size = [], 0
            open_seq = seq
            held.append(conv)
            size += len(str(conv)) + 1
        if done:
            yield out(done)
    if held:
        yield out([(open_seq, held[0], ",".join(map(str, held)))])


def _digested(batches):
    """Sorted pieces as (seq, sha256 of all its ids joined); holds one piece at a time."""
    def out(rows):
        return pa.RecordBatch.from_arrays(
            [column([r[0] for r in rows], pa.int64()), column([r[1] for r in rows], pa.string())], names=["seq", "ends_sha256"])

    open_seq, sha = None, None
    for batch in batches:
        done = []
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if seq != open_seq:
                if sha:
                    done.append((open_seq, sha.hexdigest()))
                open_seq, sha = seq, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield out(done)
    if sha:
        yield out([(open_seq, sha.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """(seq, ends_sha256) of a table (seq, conv_id): the digest of each sequence's sorted end list.

    A list of any length is sorted by ranges in many tasks and packed there; one task then
    reads a few long pieces in order.
    """
    pieces = ends.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _pieces, "seq long, first long, ids string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(
        _digested, "seq long, ends_sha256 string")


def collapse(turns: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences.

    ``turns`` (conv_id, pos, turn_md5, n_bytes) holds the turns of each conversation at places
    0, 1, …; ``ends`` (conv_id, n) every conversation and its length, those without turns too.
    A node is a different sequence of first turns: conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: members but one, times the bytes of the node's last text), ends_sha256 (of the
    members that end there). No conversations give no nodes.
    """
    spark = turns.sparkSession
    ship_package(spark)
    with small_batches(spark):
        return _collapse(turns, ends)


def _collapse(turns, ends):
    md5 = F.md5(F.concat_ws(":", "pos", "turn_md5").cast("binary"))
    parts = turns.withColumn("_md5", md5).select(
        "conv_id", "pos", "n_bytes", *[_lane("_md5", k).alias(f"p{k}") for k in range(4)])
    named = settle(running(parts, "conv_id", "pos", {f"p{k}": s for k, s in enumerate(LANES)}).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes", _name(F.col("pos") + 1, *LANES).alias("node"),
        _name("pos", *[F.col(s) - F.col(f"p{k}") for k, s in enumerate(LANES)]).alias("parent")))

    # Identical conversations are one sequence, known by the smallest of them.
    last = named.select("conv_id", F.col("depth").alias("n"), "node")
    whole = ends.join(last, ["conv_id", "n"], "left").select("conv_id", "n", F.coalesce("node", F.lit(ROOT)).alias("node"))
    sequences = settle(whole.groupBy("node").agg(
        F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.first("n").alias("n")))
    listed = whole.join(sequences.select("node", "seq"), "node")
    ended = end_lists(listed).join(sequences.select("seq", "node"), "seq").select("node", "ends_sha256")

    mine = sequences.select(F.col("seq").alias("conv_id"), "weight", "n")
    prefixes = settle(named.join(mine, "conv_id").withColumnRenamed("conv_id", "seq"))
    top = sequences.select(F.lit(ROOT).alias("node"), "seq", "weight", F.lit(0).cast("bigint").alias("depth"),
                           F.lit(0).cast("bigint").alias("n_bytes"), F.lit(None).cast("string").alias("parent"), "n")
    below = prefixes.select("node", "seq", "weight", F.col("depth").cast("bigint").alias("depth"), "n_bytes", "parent", "n")
    every = below.unionByName(top)

    proper = every.where("depth < n").select("node").distinct()
    leaves = settle(sequences.join(proper, "node", "left_anti").select("seq"))
    nodes = settle(every.groupBy("node").agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("depth").alias("depth"),
        F.first("n_bytes").alias("n_bytes"), F.first("parent").alias("parent")))

    # Each node belongs to one leaf; from a depth to its end a leaf sums the nodes it owns.
    on_leaf = settle(every.join(leaves, "seq").select("node", "seq", "depth", "n"))
    owners = on_leaf.groupBy("node").agg(F.min("seq").alias("owner"))
    worth = nodes.join(owners, "node").select(
        "node", "owner", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("worth"))
    own = F.when(F.col("owner") == F.col("seq"), F.col("worth")).otherwise(0)
    upward = on_leaf.join(settle(worth), "node").select(
        "node", "seq", (F.col("n") - F.col("depth")).alias("up"), own.alias("own"))
    sums = running(upward, "seq", "up", {"own": "onward"}).groupBy("node").agg(
        F.sum("onward").alias("saved_tokens"), F.count("*").alias("n_leaves"))

    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    facts = settle(nodes.join(sums, "node").join(children.withColumnRenamed("parent", "node"), "node", "left").join(
        ended, "node", "left"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return facts.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_END)).alias("ends_sha256"))


def op12_conversation_trie(spark, folder):
    """The trie of the rebuilt conversations; rows without a conv_id belong to none."""
    turns, ends = rebuilt(ordered_turns(spark.read.parquet(f"{folder}/conversations.parquet")))
    return collapse(turns, ends)


SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY pos) AS said FROM turns GROUP BY conv_id),
checked AS (
  SELECT conv_id, said, xor(list_reduce(
           list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
           lambda crc, byte: list_reduce(range(8),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
           4294967295), 4294967295) % 9 AS h
  FROM own),
sequences AS (
  SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said
  FROM checked c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, len(said) AS n, unnest(range(len(said) + 1)) AS depth, said FROM sequences),
nodes AS (
  SELECT said[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth) AS ends
  FROM members GROUP BY 1, 2),
facts AS (
  SELECT c.*, p.conv_id AS parent_conv_id,
         CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * octet_length(encode(c.path[c.depth].text)) END AS worth
  FROM nodes c LEFT JOIN nodes p ON p.path = c.path[1:c.depth - 1] AND p.depth = c.depth - 1),
inner_nodes AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM facts WHERE depth > 0 GROUP BY 1),
known AS (
  SELECT f.*, coalesce(i.n_children, 0) AS n_children FROM facts f LEFT JOIN inner_nodes i ON i.path = f.path),
lines AS (SELECT unnest(range(depth + 1)) AS up, path, worth, n_children FROM known),
subtrees AS (
  SELECT path[1:up] AS path, sum(worth) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM lines GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM known JOIN subtrees USING (path)
"""
