"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut in balanced parts with few edges
between them, and a small classifier learns a vector's part. Every vector of the table is
indexed in the part the classifier finds most probable; a query goes to as many of its most
probable parts as the sample needed for the recall asked for, and what lies there is ranked by
the exact inner product. Parts are split in blocks of bounded size, so that none of them,
however large, is one task; equal vectors are one from the start, with the smallest ids that
a result can need. A table too small for two parts of ``PER_PART`` vectors is one part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.text import column
from gridspark.runtime import settle, ship_package

SAMPLE = 6000
# Parts grow with the square root of the table, a part's rows likewise; beyond MAX_PARTS only
# the blocks of a part do. The sample grows with the parts, to MAX_PARTS * PER_PART vectors.
PART_RATIO = 12
MAX_PARTS = 512
PER_PART = 40
NEIGHBOURS = 16
RECALL = 0.95
BLOCK = 4096
HIDDEN = 64


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest others of each row by inner product, in blocks."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        near = x[at:at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 512] = np.argpartition(-near, out.shape[1] - 1, 1)[:, :out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for every node: balanced to a tenth, neighbours together as far as that allows.

    Starts from spherical k-means and moves nodes to the part most of their neighbours are
    in, those that gain most first, while parts stay within their size.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    most = int(np.ceil(n / parts * 1.1))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = x @ centres.T
        own = near.argmax(1)
        centres = np.stack([x[own == p].mean(0) if (own == p).any() else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near = x @ centres.T
    size = np.zeros(parts, int)
    part = np.full(n, -1)
    for i in np.argsort(-near.max(1), kind="stable"):
        for p in np.argsort(-near[i], kind="stable"):
            if size[p] < most:
                part[i] = p
                size[p] += 1
                break
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < most:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer; the logits of the parts of a vector."""

    def __init__(self, dims: int, parts: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.params = [rng.normal(0, np.sqrt(2 / dims), (dims, hidden)), np.zeros(hidden),
                       rng.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def fit(self, x: np.ndarray, wanted: np.ndarray, epochs: int = 40, seed: int = 9) -> None:
        """Adam on the cross entropy with the shares of a vector's neighbours over the parts."""
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at:at + 128]
                w1, b1, w2, b2 = self.params
                hidden = np.maximum(x[rows] @ w1 + b1, 0)
                z = hidden @ w2 + b2
                z = np.exp(z - z.max(1, keepdims=True))
                error = (z / z.sum(1, keepdims=True) - wanted[rows]) / len(rows)
                back = (error @ w2.T) * (hidden > 0)
                grads = [x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
                step += 1
                for p, g, m, v in zip(self.params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def ranked(self, x: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-self.logits(x), 1, kind="stable")[:, :count]


def parts_for(rows: int, ratio: int = PART_RATIO, max_parts: int = MAX_PARTS) -> int:
    return int(min(max_parts, max(2, rows**0.5 // ratio)))


def learn(sample: np.ndarray, rows: int, wanted_recall: float = RECALL, ratio: int = PART_RATIO,
          max_parts: int = MAX_PARTS, top: int = 20):
    """(router, parts, probes) for a table of ``rows`` vectors, from a sample of them.

    A tenth of the sample, which the router does not learn from, sets how many parts a query
    visits: as few as find ``wanted_recall`` of its nearest in the sample; all, if none do.
    """
    parts = min(parts_for(rows, ratio, max_parts), len(sample) // PER_PART)
    if parts < 2:
        return None, 1, 1
    held = len(sample) // 10
    rest = sample[held:]
    graph = neighbour_graph(rest)
    part = balanced_parts(rest, graph, parts)
    shares = np.zeros((len(rest), parts))
    np.add.at(shares, (np.repeat(np.arange(len(rest)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    shares = 0.75 * shares
    shares[np.arange(len(rest)), part] += 0.25
    router = Router(sample.shape[1], parts)
    router.fit(rest, shares)
    indexed = router.ranked(rest, 1)[:, 0]
    order = router.ranked(sample[:held], parts)
    near = np.concatenate([np.argsort(-(sample[at:min(at + 256, held)] @ rest.T), 1, kind="stable")[:, :top]
                           for at in range(0, held, 256)])
    place = np.argsort(order, 1)[np.arange(held)[:, None], indexed[near]]
    found = np.bincount(place.ravel(), minlength=parts).cumsum() / place.size
    return router, parts, int(np.searchsorted(found, wanted_recall) + 1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>) of the rows with a key and a finite vector that is not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(key).alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def _routed(router, parts, count, blocks, copies):
    """Adds a row per part a vector goes to; the block is drawn, or all blocks get a copy."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.array(batch.column("v").flatten()).reshape(n, -1)
            to = router.ranked(x, count) if router else np.zeros((n, 1), np.int64)
            row = np.repeat(np.arange(n), to.shape[1])
            part = to.ravel()
            if copies:
                per = np.array([blocks.get(int(p), 1) for p in part])
                row, part = np.repeat(row, per), np.repeat(part, per)
                ends = np.cumsum(per)
                block = np.arange(len(row)) - np.repeat(ends - per, per)
            else:
                spread = np.array([blocks.get(int(p), 1) for p in part])
                block = batch.column("h").to_numpy()[row] % spread
            out = batch.take(column(row, pa.int64()))
            yield out.append_column("part", column(part, pa.int32())).append_column("block", column(block, pa.int32()))
    return run


def _nearest(top):
    """For one block of a part: the best distinct vectors of every query, ties by id."""
    def run(key, queries, base):
        names = ["query", "near", "vec_id", "ids", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not queries.num_rows or not base.num_rows:
            return pa.table([pa.nulls(0, k) for k in kinds], names=names)
        q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(queries.num_rows, -1)
        b = base.column("v").combine_chunks().flatten().to_numpy().reshape(base.num_rows, -1)
        ids = base.column("vec_id").to_numpy()
        keep = min(top + 1, len(b))
        out = [[], [], []]
        for at in range(0, len(q), 256):
            some = q[at:at + 256]
            rough = some @ b.T
            edge = np.partition(rough, len(b) - keep, 1)[:, len(b) - keep]
            # Sums in matrix order differ in the last bits: near the edge all are kept.
            row, col = np.nonzero(rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
            score = np.einsum("ij,ij->i", some[row], b[col])
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.searchsorted(row, np.arange(len(some)))
            use = np.arange(len(row)) - first[row] < keep
            for o, v in zip(out, (at + row[use], col[use], score[use])):
                o.append(v)
        row, col, score = (np.concatenate(o) for o in out)
        col = column(col, pa.int64())
        return pa.table([queries.column("name").take(column(row, pa.int64())),
                         *(base.column(c).take(col) for c in ("name", "vec_id", "ids")),
                         column(score, pa.float64())], names=names)
    return run


_INDEXED = "name long, vec_id long, v array<double>, ids array<long>, h long, part int, block int"


def search(rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = 20,
           sample: int = SAMPLE, recall: float = RECALL, ratio: int = PART_RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row ``is_query`` selects.

    Every other row is a candidate. Nearness is the inner product in double precision, ties go
    to the smaller id. Vectors that are null, zero, or hold null or non-finite parts take no
    part, nor do null keys. A shorter vector counts as ending in zeros. Rows that share a key
    are rows of their own: each is a candidate, of the others too, and each that is a query has
    its own ranks under the shared id. With fewer candidates all are given. Index: learnt from
    the ``sample`` vectors smallest by hash, or ``PER_PART`` a part if that is more; every row
    is indexed.
    """
    spark = rows.sparkSession
    ship_package(spark)
    known = usable(rows, key, vector)
    width = known.agg(F.max(F.size("v"))).first()[0] or 1
    whole = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    known = known.select("vec_id", whole.alias("v"))
    known = settle(known.withColumns({"digest": F.xxhash64("v"), "row": F.monotonically_increasing_id()}))
    # Of equal vectors only as many ids as a result can hold matter, its own included.
    place = F.row_number().over(Window.partitionBy("digest", "v").orderBy("vec_id"))
    few = known.withColumn("place", place).where(F.col("place") <= top + 1)
    base = few.groupBy("digest", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    base = settle(base.select(F.monotonically_increasing_id().alias("name"), F.element_at("ids", 1).alias("vec_id"),
                              "digest", "v", "ids", F.shiftrightunsigned("digest", 1).alias("h")))
    queries = known.where(is_query(F.col("vec_id"))).select("row", F.col("vec_id").alias("query_id"), "digest", "v")
    alike = settle(queries.join(base.select("digest", "v", F.col("name").alias("query")), ["digest", "v"]).select(
        "row", "query_id", "query"))
    asked = settle(base.join(alike.select(F.col("query").alias("name")).distinct(), "name").select("name", "v"))

    total = base.count()
    most = max(sample, PER_PART * parts_for(total, ratio))
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id", "digest").limit(most).select("v").toArrow().column(0)
    points = drawn.combine_chunks().flatten().to_numpy().reshape(len(drawn), -1) if total else np.zeros((0, 1))
    router, parts, probes = learn(points, total, recall, ratio, top=top)

    indexable = base.select("name", "vec_id", "v", "ids", "h")
    counts = indexable.mapInArrow(_routed(router, parts, 1, {}, False),
                                  _INDEXED).groupBy("part").count().collect()
    blocks = {r["part"]: -(-r["count"] // BLOCK) for r in counts}
    indexed = indexable.mapInArrow(_routed(router, parts, 1, blocks, False), _INDEXED)
    sent = asked.mapInArrow(
        _routed(router, parts, probes, blocks, True), "name long, v array<double>, part int, block int")
    # Queries of a part are dealt in slices too, so that neither side of a group grows.
    slices = max(1, -(-asked.count() * probes // (max(parts, 1) * BLOCK)))
    sent = sent.withColumn("slice", F.pmod(F.xxhash64("name"), F.lit(slices)).cast("int"))
    indexed = indexed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    group = ["part", "block", "slice"]
    found = sent.groupBy(*group).cogroup(indexed.groupBy(*group)).applyInArrow(
        _nearest(top), "query long, near long, vec_id long, ids array<long>, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "near")
    short = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1)

    # Rows of equal vectors share what was found. Each leaves out one row, its own: the first
    # of its id among the rows of its vector.
    listed = short.select("query", "near", "score", "ids", F.posexplode("ids").alias("at", "vec_id"))
    own = (F.col("near") == F.col("query")) & (F.array_position("ids", F.col("vec_id")) == F.col("at") + 1)
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "near", "at")
    listed = settle(listed.withColumns({"own": own, "r": F.row_number().over(nearest)}).where(
        F.col("r") <= top + 1).select("query", "vec_id", "score", "own", "r"))
    each = alike.join(listed, "query").where(~(F.col("own") & (F.col("vec_id") == F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("r"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")


def op10_neighbours(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return search(rows, lambda i: F.pmod(i, F.lit(20)) == 0)
