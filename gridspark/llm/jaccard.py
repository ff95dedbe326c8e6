"""N-gram Jaccard join by several global token orders.

A document is the set of its five-word shingles. Two sets of a similarity of at least t share
a token among the first n - ceil(t n) + 1 tokens of each, in any common order of all tokens.
A pair is a candidate only if that holds in several orders:

* by document frequency, rarest first. A set whose prefix holds nothing but tokens of its own
  cannot link at all; this drops most documents before any pair is made. Among the rest the
  prefixes are joined by token, with filters by size and by position.
* by two hash orders, tested on the pairs left, before the sets are compared.

Groups of alike documents would give a pair of each two. So sets are first compared with one
centre only of those that share their first token in a hash order, after the same tests by two
other orders, and joined into clusters; the exact join then makes pairs between different
clusters only. What it finds joins the clusters, and nothing that could change a component is
left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.links import components, narrow, release, small_batches
from gridspark.llm.text import Prints, U, chunks, column, inside, lean, mix, spread, words
from gridspark.llm.ties import tied_entries
from gridspark.runtime import settle, ship_package, stored

WIDTH = 5
PERCENT = 75
# Orders whose first tokens choose centres.
STARS = 7
CHECKS = 2


def token_sets(buf, off, width: int = WIDTH):
    """(sorted distinct shingle fingerprints of all texts, how many each text has)."""
    start, end, bounds = words(buf, off)
    prints = Prints(buf, fold=True).of(start, end)
    n_words = np.diff(bounds)
    n_grams = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    owner = spread(n_grams)
    first = bounds[:-1][owner] + inside(n_grams)
    grams = np.zeros(len(first), U)
    reach = np.minimum(n_words, width)[owner]
    for k in range(width):
        within = k < reach
        at = np.minimum(first + k, max(len(prints) - 1, 0))
        grams = np.where(within, mix(grams * U(3) + prints[at] + U(k)), grams)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(off) - 1)


def _name(tokens) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _facts(width):
    def run(batches):
        for batch in batches:
            for first, buf, off in chunks(batch.column(2)):
                tokens, sizes = token_sets(buf, off, width)
                ends = np.cumsum(sizes)
                names = [_name(tokens[e - s:e]).hex() for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(first, len(sizes)) for i in range(2)],
                     column(sizes, pa.int64()), column(names, pa.string())], names=["doc_id", "key", "n", "name"])
    return run


def _entries(width):
    def run(batch):
        for _, buf, off in chunks(batch.column(0)):
            tokens, sizes = token_sets(buf, off, width)
            ends = np.cumsum(sizes)
            owners = np.array([int.from_bytes(_name(tokens[e - s:e])[:8], "big", signed=True)
                               for s, e in zip(sizes, ends)], np.int64)
            yield tokens, np.repeat(owners, sizes), np.zeros(len(tokens), np.int32)
    return run


def _ordered(tokens, k):
    return mix(tokens * U(2 * k + 3) + U(7919 * k + 13))


def _sets(width):
    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for first, buf, off in chunks(batch.column(1)):
                tokens, sizes = token_sets(buf, off, width)
                ends = np.cumsum(sizes)
                own = [tokens[e - s:e] for s, e in zip(sizes, ends)]
                lead = [[int(_ordered(t, k).min()) >> 1 if len(t) else None for t in own]
                        for k in range(STARS)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, len(sizes)), column([_name(t).hex() for t in own], pa.string()),
                     column(sizes, pa.int64()), column([t.tobytes() for t in own], pa.binary()),
                     pa.array(list(zip(*lead)), pa.list_(pa.int64()))],
                    names=["rep", "name", "n", "tokens", "leads"])
    return run


def _exploded(batches):
    for batch in batches:
        n = batch.column(1).to_numpy()
        for at in range(0, len(n), 500):
            cells = batch.column(2).slice(at, 500).to_pylist()
            tokens = np.frombuffer(b"".join(cells), np.int64)
            owner = np.repeat(np.arange(len(cells)), n[at:at + 500])
            yield pa.RecordBatch.from_arrays(
                [column(tokens, pa.int64()), batch.column(0).slice(at, 500).take(column(owner, pa.int64()))],
                names=["token", "node"])


def _linked(percent, checks):
    def first_of(tokens, keep, k):
        ordered = _ordered(tokens, k)
        return np.partition(ordered, keep - 1)[:keep] if keep < len(ordered) else ordered

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for one, two in zip(left, right):
                one, two = np.frombuffer(one, U), np.frombuffer(two, U)
                sizes = len(one), len(two)
                fits = 100 * min(sizes) >= percent * max(sizes)
                # The shared prefix in every other order, before the sets are compared.
                for k in range(100, 100 + checks):
                    if fits:
                        heads = [first_of(t, len(t) - -(-percent * len(t) // 100) + 1, k) for t in (one, two)]
                        fits = len(np.intersect1d(*heads, assume_unique=True)) > 0
                if fits:
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    fits = 100 * common >= percent * (sum(sizes) - common)
                good.append(fits)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that pass the other orders and the exact comparison."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("two"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "one", "two")
    return both.mapInArrow(lean(_linked(percent, CHECKS)), "a long, b long")


def _star_pairs(sets: DataFrame) -> DataFrame:
    """Every set with a centre that shares its first token in some order.

    The centre is the set with the largest part of tokens that others hold too: a copy that
    was changed has tokens of its own, what it was made from has fewer. Centres are settled,
    so that Spark can split the join where a first token is hot.
    """
    keyed = sets.select("node", "own_share", F.posexplode("leads").alias("k", "lead")).where(F.col("lead").isNotNull())
    centres = settle(keyed.groupBy("k", "lead").agg(
        F.min(F.struct("own_share", "node")).alias("a"), F.count("*").alias("c")).where("c > 1").select("k", "lead", "a.node"))
    met = keyed.drop("own_share").join(centres.withColumnRenamed("node", "a"), ["k", "lead"])
    return met.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()


def _crossing_pairs(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different clusters that share a prefix token, rarest tokens first."""
    grams = sets.select("node", "n", "tokens").mapInArrow(lean(_exploded), "token long, node long")
    often = grams.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = grams.join(often, "token")
    # Tokens of one document only come first in its order; they need no rows.
    own = Window.partitionBy("node")
    placed = shared.withColumns({"rank": F.row_number().over(own.orderBy("df", "token")),
                                 "held": F.count("*").over(own)})
    placed = placed.join(settle(sets.select("node", "n").join(clusters, "node")), "node")
    place = F.col("n") - F.col("held") + F.col("rank")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    heads = settle(placed.withColumn("place", place).where(F.col("place") <= prefix).select(
        "token", "node", "n", "place", "root"))
    mixed = heads.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    heads = heads.join(mixed.select("token"), "token", "left_semi")
    left = heads.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "root")])
    right = heads.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "root")])
    left_over = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    enough = left_over * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # The rarest common token comes first in both, so what follows it bounds the overlap.
    cond = (left["token"] == right["token"]) & (F.col("root_a") < F.col("root_b")) & enough & sizes
    return left.join(right, cond).select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, …).

    Words are runs of non-space bytes, A-Z folded. A text of fewer than ``width`` words is one
    shingle, the whole of it; a text without words, or a null one, has none and stays alone.
    The component is the smallest doc_id reachable over links, its own included. Rows with one
    doc_id, or with none, are judged each by its own text; a component without any doc_id is
    null. Equal sets are one node from the start, named by a 128-bit fingerprint.
    """
    rows = jaccard_rows(docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text")), width, percent)
    return rows.select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, group) of every row of ``docs`` (doc_id, text, key).

    ``key`` is a number that rows of different texts do not share, but for chance: one row of
    each set is read again by it. ``group`` is the smallest key of those that the component was
    read by, so it tells components apart where ids are null; rows without shingles have none.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with small_batches(spark):
        return _jaccard_rows(spark, docs.select("doc_id", "key", "text"), width, percent)


def _jaccard_rows(spark, docs, width, percent):
    facts = stored(docs.mapInArrow(lean(_facts(width)), "doc_id long, key long, n long, name string"), "shingles")
    nodes = facts.where("n > 0").groupBy("name").agg(
        F.min("key").alias("rep"), F.min("doc_id").alias("low"), F.max("n").alias("n"))
    tied = tied_entries(docs.select("text"), _entries(width), by_place=False, buckets=4)
    credit = settle(tied.select("owner", F.col("n").alias("shared")))
    del tied
    release(spark)
    half = F.conv(F.substring("name", 1, 16), 16, -10).cast("long")
    open_nodes = settle(nodes.withColumn("owner", half).join(credit, "owner").where(
        100 * F.col("shared") >= percent * F.col("n")).select(
        "name", "rep", "low", F.greatest(1 - F.col("shared") / F.col("n"), F.lit(0.0)).alias("own_share")))

    reps = open_nodes.select(F.col("rep").alias("key")).distinct()
    # An inner join: a semi-join would be pushed below the filter of ``narrow``.
    found = narrow(docs.select("key", "text"), reps, "key").join(reps.hint("merge"), "key").mapInArrow(
        lean(_sets(width)), "rep long, name string, n long, tokens binary, leads array<long>")
    # A key that several rows share brings sets nobody asked for; equal sets come once.
    sets = stored(found.join(open_nodes, ["name", "rep"]).dropDuplicates(["name"]).withColumn(
        "node", F.monotonically_increasing_id()), "sets")

    release(spark)
    roots = sets.select("node", F.col("node").alias("root"))
    roots = _joined(roots, components(_verified(_star_pairs(sets), sets, percent)))
    pairs = settle(_crossing_pairs(sets, roots, percent))
    release(spark)
    # Links between clusters are few; they join roots, not nodes.
    links = _verified(pairs, sets, percent)
    between = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    tops = components(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    of_set = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select(
        "node", F.coalesce("_top", "root").alias("top"))
    named = settle(sets.select("node", "name", "rep", "low").join(of_set, "node"))
    lowest = settle(named.groupBy("top").agg(F.min("low").alias("component"), F.min("rep").alias("group")))
    linked = named.join(lowest, "top").select("name", "component", "group")
    # Copies outside any link still form a group: their common set's smallest document.
    # Settled, so that the join below is a plain one, which Spark splits where a set is hot.
    groups = settle(nodes.join(linked, "name", "left").select(
        "name", F.coalesce("component", "low").alias("component"), F.coalesce("group", "rep").alias("group")))
    out = facts.join(groups, "name", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "group")


def _joined(roots: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, root) with the roots of those nodes that were joined with others."""
    return settle(roots.select("node").join(tops, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def op1_jaccard_join(spark, folder):
    return jaccard_groups(spark.read.parquet(f"{folder}/documents.parquet"))
