"""Conflict-constrained best-fit packing of documents into bins of a fixed size.

Documents longer than a bin give full bins and a rest. The pieces are dealt evenly, by hash,
into groups of a bounded number of words and pieces; each group is packed on its own, largest piece
first. Open bins are ordered by what room they have left; the search starts at the tightest
bin the piece fits and goes on to the next until one is compatible. A bin carries bitmaps of
the duplicate clusters and sources in it: no cluster twice, and no source more often than
allowed. Equal pieces (same size, source and cluster) are placed in one sweep, so a cluster
with a third of all rows costs one pass over the bins and not one per copy.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.mixing import word_count
from gridspark.llm.text import column
from gridspark.runtime import settle, ship_package

CAPACITY = 2048
MAX_PER_SOURCE = 4
GROUP_WORDS = 4_000_000
GROUP_PIECES = 200_000
# Bits of a bin's bitmaps, keys in a block of an order, and bins closed before an order is made.
BITS = 256
BLOCK = 512
MANY = 256
# An order's keys are a bin's room and, in the lower bits, its number.
NUMBER = (1 << 32) - 1


class Order:
    """Different integers in order, in blocks, so that adding or removing one moves few others."""

    def __init__(self, items=()):
        items = sorted(items)
        self.blocks = [items[i:i + BLOCK] for i in range(0, len(items), BLOCK)]
        self.tops = [b[-1] for b in self.blocks]

    def __iter__(self):
        return (v for b in self.blocks for v in b)

    def add(self, value: int) -> None:
        at = bisect_left(self.tops, value)
        if at == len(self.blocks):
            if not self.blocks:
                self.blocks, self.tops = [[value]], [value]
                return
            at -= 1
        block = self.blocks[at]
        insort(block, value)
        if len(block) > 2 * BLOCK:
            self.blocks[at:at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[at:at + 1] = [block[BLOCK - 1], block[-1]]
        else:
            self.tops[at] = block[-1]

    def remove(self, value: int) -> None:
        at = bisect_left(self.tops, value)
        block = self.blocks[at]
        del block[bisect_left(block, value)]
        if block:
            self.tops[at] = block[-1]
        else:
            del self.blocks[at], self.tops[at]

    def successor(self, value: int) -> int | None:
        """The smallest member that is not below ``value``."""
        at = bisect_left(self.tops, value)
        if at == len(self.blocks):
            return None
        block = self.blocks[at]
        return block[bisect_left(block, value)]


class Bins:
    """Open bins in the order of room left, then number.

    A bin carries bitmaps of ``BITS`` bits: clusters in it, and sources that are in it as often
    as allowed. A bit that is not set clears the piece; one that is set is confirmed by the
    bin's own clusters or counts, since several share it. A source that fills many bins gets an
    order of its own without them, and so does the cluster whose pieces are being placed, so a
    search does not walk past all the bins that are closed to it.
    """

    def __init__(self, capacity: int, per_source: int, many: int = MANY):
        self.capacity, self.per_source, self.many = capacity, per_source, many
        self.open = Order()
        self.of_source: dict[int, Order] = {}
        self.filled: dict[int, int] = {}
        self.cluster, self.holding, self.without = None, 0, None
        self.cluster_bits: list[int] = []
        self.source_bits: list[int] = []
        self.clusters: list[list[int]] = []
        self.counts: list[dict[int, int]] = []
        self.used: list[int] = []

    def closed(self, at: int, source: int) -> bool:
        return bool(self.source_bits[at] >> source % BITS & 1) and self.counts[at].get(source, 0) >= self.per_source

    def holds(self, at: int, cluster: int) -> bool:
        return bool(self.cluster_bits[at] >> cluster % BITS & 1) and cluster in self.clusters[at]

    def key(self, at: int) -> int:
        return self.capacity - self.used[at] << 32 | at

    def put(self, at: int, size: int, source: int, cluster: int) -> int:
        start, old, counts = self.used[at], self.key(at), self.counts[at]
        orders = [self.open, *(o for s, o in self.of_source.items() if not self.closed(at, s))]
        if start:
            for order in orders if self.without is None else [*orders, self.without]:
                order.remove(old)
        self.used[at] += size
        self.cluster_bits[at] |= 1 << cluster % BITS
        self.clusters[at].append(cluster)
        counts[source] = counts.get(source, 0) + 1
        now_closed = counts[source] >= self.per_source
        if now_closed:
            self.source_bits[at] |= 1 << source % BITS
            self.filled[source] = self.filled.get(source, 0) + 1
        if self.used[at] < self.capacity:
            new = self.key(at)
            for order in orders:
                if not (now_closed and order is self.of_source.get(source)):
                    order.add(new)
        if now_closed and self.filled[source] == self.many:
            self.of_source[source] = Order(k for k in self.open if not self.closed(k & NUMBER, source))
        self.holding += 1
        if self.holding == self.many:
            self.without = Order(k for k in self.open if not self.holds(k & NUMBER, cluster))
        return start

    def new(self) -> int:
        self.cluster_bits.append(0)
        self.source_bits.append(0)
        self.clusters.append([])
        self.counts.append({})
        self.used.append(0)
        return len(self.used) - 1

    def sweep(self, size: int, source: int, cluster: int, count: int):
        """(bin, start) for each of ``count`` equal pieces, tightest compatible bins first."""
        if cluster != self.cluster:
            self.cluster, self.holding, self.without = cluster, 0, None
        placed, at = [], size << 32
        while len(placed) < count:
            order = self.without if self.without is not None else self.of_source.get(source, self.open)
            found = order.successor(at)
            if found is None:
                b = self.new()
            else:
                # Bins filled here hold the cluster: the search never has to go back.
                b, at = found & NUMBER, found + 1
                if self.holds(b, cluster) or self.closed(b, source):
                    continue
            placed.append((b, self.put(b, size, source, cluster)))
        return placed


def pack(pieces, capacity: int = CAPACITY, per_source: int = MAX_PER_SOURCE, many: int = MANY):
    """(bin, start) of each (size, source, cluster) in the order given: equal ones adjoin."""
    bins, out = Bins(capacity, per_source, many), []
    at = 0
    while at < len(pieces):
        end = at
        while end < len(pieces) and pieces[end] == pieces[at]:
            end += 1
        out += bins.sweep(*pieces[at], end - at)
        at = end
    return out


def _pack_group(capacity, per_source):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("size").to_pylist(), table.column("source").to_pylist(),
                        table.column("cluster").to_pylist(), table.column("doc_id").to_pylist(),
                        table.column("piece").to_pylist(), range(table.num_rows)))
        missing = lambda v: (v is None, v)
        rows.sort(key=lambda r: (-r[0], missing(r[2]), missing(r[1]), missing(r[3]), r[4]))
        sources: dict = {}
        clusters: dict = {}
        pieces = [(r[0], sources.setdefault(r[1], len(sources)), clusters.setdefault(r[2], len(clusters)))
                  for r in rows]
        placed = pack(pieces, capacity, per_source)
        order = [r[5] for r in rows]
        group = table.column("grp")[0].as_py()
        out = table.select(["doc_id", "piece", "size", "source"]).take(column(order, pa.int64()))
        return out.append_column("bin_id", column([group << 32 | b for b, _ in placed], pa.int64())).append_column(
            "start", column([s for _, s in placed], pa.int32()))
    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = MAX_PER_SOURCE,
                   group_words: int = GROUP_WORDS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, piece, size, source, bin_id, start) of every piece of every document.

    ``docs`` has doc_id, source, size (words) and cluster (equal for duplicates). The pieces of
    a document cover it in order; full ones fill a bin alone. A document of size 0 is one empty
    piece in bin -1; a null size is 0. A null source or cluster is a value of its own, shared by
    the rows that have it. Rows that share a doc_id are packed one by one. The rests are
    at most ``capacity`` - 1 words, and a group is about ``group_words`` of them or
    ``group_pieces`` rests, whichever is less, so a task's memory does not grow with the data;
    rows are dealt by the hash of a running number,
    so equal rows spread over all groups.
    """
    ship_package(docs.sparkSession)
    size = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    rows = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"),
                              F.col("cluster").cast("string").alias("cluster"),
                              F.monotonically_increasing_id().alias("row")))
    left = F.pmod("size", F.lit(capacity))
    words, rests = rows.agg(F.sum(left), F.count_if(left > 0)).first()
    groups = max(1, -(-(words or 0) // group_words), -(-rests // group_pieces))
    kind = dict(rows.dtypes)["doc_id"]
    full = rows.where(F.col("size") >= capacity).select(
        "doc_id", "source", F.explode(F.sequence(F.lit(0), (F.floor(F.col("size") / capacity) - 1).cast("int"))).alias("piece"))
    # Bins of one piece get the negative numbers below -1; the rows are settled, so they stay.
    full = full.select("doc_id", "piece", F.lit(capacity).cast("bigint").alias("size"), "source",
                       (-2 - F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).alias("start"))
    rest = rows.withColumns({"piece": F.floor(F.col("size") / capacity).cast("int"),
                             "size": F.pmod("size", F.lit(capacity))})
    empty = rest.where((F.col("size") == 0) & (F.col("piece") == 0)).select(
        "doc_id", "piece", F.col("size"), "source", F.lit(-1).cast("long").alias("bin_id"), F.lit(0).alias("start"))
    rest = rest.where(F.col("size") > 0).withColumn(
        "grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = rest.groupBy("grp").applyInArrow(
        _pack_group(capacity, per_source),
        f"doc_id {kind}, piece int, size long, source string, bin_id long, start int")
    return packed.unionByName(full).unionByName(empty)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the cluster of exact copies of a text."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), F.md5("text").alias("cluster"))


def op8_best_fit_packing(spark, folder):
    return pack_documents(sized(spark.read.parquet(f"{folder}/documents.parquet")))
