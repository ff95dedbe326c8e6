"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms, each with a level for every step its
count reaches. Documents of like size share a block, stored by slices: row i of a block is
bit i of all its documents. The rows of a term, combined by AND, are a bitmap of the documents
that may hold it so often: never too few. With the document's own length this bounds what the
term can add to a score from above, and the sums over an item's terms bound whole scores.

A search goes twice over the blocks. First the documents of the highest bounds are rescored
exactly, which gives a score that the last place of each item certainly reaches. Then every
document whose bound reaches it for some item is rescored exactly; all others are excluded by
proof. Each task keeps the best of what it has seen, so no item gathers all documents.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.links import narrow, small_batches
from gridspark.llm.text import Prints, U, chunks, column, inside, mix, runs, spread, words
from gridspark.runtime import scratch_path, settle, ship_package

TOP = 20
HASHES = 4
BITS = 8  # of a signature for each of its entries, at least
# A block has so many cells (slices times documents) at most; a signature so many slices, and
# a text of more entries a fuller filter, whose bounds are looser but still bounds.
CELLS = 1 << 23
MOST_SLICES = 1 << 20
MOST_DOCS, LEAST_DOCS = 1024, 8
# Terms of the items searched for at once, and numbers a task works on at once.
PASS_TERMS = 16_384
WORK = 4_000_000
FLUSH = 500_000

IS_TERM = np.ones(256, bool)
IS_TERM[[b for b in range(128) if not chr(b).isalnum()]] = False


def level_starts(most: int) -> np.ndarray:
    """Counts at which a term gains a level: 1, 2, 3, 4, 6, 8, 12, 16, … up to ``most``."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] + max(1, 1 << max(0, out[-1].bit_length() - 2)))
    return np.array([x for x in out if x <= most] or [1], np.int64)


def counted(buf, off):
    """(terms, their counts, how many different ones each text has, how many with repeats)."""
    start, end, bounds = words(buf, off, IS_TERM)
    prints = Prints(buf, fold=True).of(start, end)
    n = np.diff(bounds)
    owner = spread(n)
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    new = np.ones(len(prints), bool)
    new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return prints[at], np.diff(np.r_[at, len(prints)]), np.bincount(owner[at], minlength=len(n)), n


def _spots(terms, levels, n_slices: int) -> np.ndarray:
    """The slices of each (term, level): one row of ``HASHES`` numbers."""
    one = mix(terms + mix(levels.astype(U) + U(1)))
    two = mix(one) | U(1)
    return ((one[:, None] + np.arange(HASHES, dtype=U) * two[:, None]) & U(n_slices - 1)).astype(np.int64)


def _slices_for(n_entries):
    """A power of two of ``BITS`` to twice ``BITS`` slices per entry, within bounds."""
    need = np.maximum(n_entries * BITS, 64)
    return np.minimum(1 << np.ceil(np.log2(need)).astype(np.int64), MOST_SLICES)


def _block(n_slices, held):
    """A row of the index: (slices, documents, lengths, keys, slices' bytes)."""
    cells = np.zeros((n_slices, -(-len(held) // 8) * 8), bool)
    for i, (_, _, terms, levels) in enumerate(held):
        for at in range(0, len(terms), FLUSH):
            cells[_spots(terms[at:at + FLUSH], levels[at:at + FLUSH], n_slices).ravel(), i] = True
    return (int(n_slices), len(held), np.array([h[1] for h in held], np.int64).tobytes(),
            np.array([h[0] for h in held], np.int64).tobytes(), np.packbits(cells, axis=1).tobytes())


INDEX = "kind string, slices long, docs long, terms long, lengths binary, keys binary, bits binary"


def _indexed(batches):
    """(key, text) as blocks of signatures, and counts of documents by term (kind df)."""
    held, df, n_df = {}, [], 0

    def row(kind, slices=None, docs=None, terms=None, lengths=None, keys=None, bits=None):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [column([v], k) for v, k in zip((kind, slices, docs, terms, lengths, keys, bits), kinds)],
            names=["kind", "slices", "docs", "terms", "lengths", "keys", "bits"])

    def block(n_slices):
        docs = held.pop(n_slices)
        slices, n, lengths, keys, bits = _block(n_slices, docs)
        return row("block", slices, n, int(sum(d[1] for d in docs)), lengths, keys, bits)

    def frequencies():
        terms, counts = (np.concatenate(c) for c in zip(*df))
        order, starts, _ = runs(terms)
        return terms[order][starts], np.add.reduceat(counts[order], starts)

    for batch in batches:
        keys = batch.column(0).to_numpy()
        for first, buf, off in chunks(batch.column(1)):
            terms, counts, different, n = counted(buf, off)
            if len(terms):
                seen, here = np.unique(terms, return_counts=True)
                df.append((seen, here))
                n_df += len(seen)
            # The entries of a term: one for each level it reaches.
            starts = level_starts(int(counts.max()) if len(counts) else 1)
            reach = np.searchsorted(starts, counts, "right")
            terms, levels = np.repeat(terms, reach), inside(reach)
            ends = np.cumsum(different)
            cut = np.r_[0, np.cumsum(reach)][np.r_[0, ends]]
            sizes = _slices_for(np.diff(cut))
            for i in np.flatnonzero(n):
                size = int(sizes[i])
                docs = held.setdefault(size, [])
                docs.append((int(keys[first + i]), int(n[i]), terms[cut[i]:cut[i + 1]].copy(), levels[cut[i]:cut[i + 1]].copy()))
                if len(docs) >= max(LEAST_DOCS, min(MOST_DOCS, CELLS // size)):
                    yield block(size)
        if n_df >= FLUSH:
            df = [frequencies()]
            n_df = len(df[0][0])
            if n_df >= FLUSH:
                yield row("df", keys=df[0][0].tobytes(), lengths=df[0][1].astype(np.int64).tobytes())
                df, n_df = [], 0
    for size in sorted(held):
        yield block(size)
    if df:
        terms, counts = frequencies()
        yield row("df", keys=terms.tobytes(), lengths=counts.astype(np.int64).tobytes())


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the signatures of ``docs`` (key long, text) below ``path`` and reads them back.

    The key need not be unique. Texts without a term, and null ones, have no signature. Rows of
    kind ``block`` hold documents, rows of kind ``df`` the number of documents by term in what
    one task has read. A task holds one open block for each size of signature.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with small_batches(spark):
        docs.select("key", "text").mapInArrow(_indexed, INDEX).write.partitionBy("kind").parquet(path)
    return spark.read.schema("slices long, docs long, terms long, lengths binary, keys binary, bits binary, kind string").parquet(path)


def _df_rows(wanted):
    """Of rows (terms, counts) those of the sorted wanted terms."""
    def run(batches):
        for batch in batches:
            for cell, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, counts = np.frombuffer(cell, U), np.frombuffer(count, np.int64)
                at = np.searchsorted(wanted, terms)
                hit = wanted[np.minimum(at, len(wanted) - 1)] == terms
                yield pa.RecordBatch.from_arrays([column(at[hit], pa.int64()), column(counts[hit], pa.int64())], names=["at", "df"])
    return run


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Pass:
    """The items searched for at once: their terms in order, weights, and items as lists of both."""

    def __init__(self, items, n_docs, n_terms):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.terms = np.unique(np.concatenate([t for _, t, _ in items]))
        self.items = [(item, np.searchsorted(self.terms, terms), times) for item, terms, times in items]
        self.weights = np.zeros(len(self.terms), np.int64)

    def lengths(self, n):
        """The integer m of documents of n terms."""
        return 75 + (25 * n * self.n_docs) // self.n_terms

    def sums(self, gains, active):
        """Per item, the sums over its terms of the gains (active term x document)."""
        where = np.full(len(self.terms), -1)
        where[active] = np.arange(len(active))
        gains = gains * self.weights[active][:, None]
        for item, at, times in self.items:
            rows = where[at]
            held = rows >= 0
            yield item, (gains[rows[held]] * times[held][:, None]).sum(0) if held.any() else None


def _gain(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _bounds(search: Pass, n_slices, n_docs, lengths, bits):
    """Per piece of a block: its columns and (item, upper bounds of the scores) of each item."""
    table = np.frombuffer(bits, np.uint8).reshape(n_slices, -1)
    width = max(8, WORK // max(len(search.terms), 1) // 8 * 8)
    for first in range(0, n_docs, width):
        cols = slice(first // 8, -(-min(first + width, n_docs) // 8))
        n = lengths[first:first + width]
        m = search.lengths(n)
        piece = table[:, cols]
        active, level = np.arange(len(search.terms)), 0
        steps = level_starts(int(n.max()))
        gains = rows = None
        alive = None
        while len(active) and level < len(steps):
            spots = _spots(search.terms[active], np.full(len(active), level), n_slices)
            may = np.unpackbits(np.bitwise_and.reduce(piece[spots], axis=1), axis=1)[:, :len(n)].astype(bool)
            if alive is not None:
                may &= alive
            some = may.any(1)
            active, may = active[some], may[some]
            # A count that has this level and not the next is below the next one's start.
            most = np.minimum(steps[level + 1] - 1, n) if level + 1 < len(steps) else n
            gain = np.where(may, _gain(most, m), 0)
            if level == 0:
                rows, gains = active, gain
            else:
                at = np.searchsorted(rows, active)
                gains[at] = np.maximum(gains[at], gain)
            alive, level = may, level + 1
        if rows is not None and len(rows):
            yield slice(first, first + len(n)), search.sums(gains, rows)


class Best:
    """The highest ``top`` (score, id) of each item; ties go to the smaller id, null last."""

    def __init__(self, top):
        self.top, self.held = top, {}

    def add(self, item, scores, ids, nulls):
        use = np.flatnonzero(scores > 0)
        if not len(use):
            return
        scores, ids, nulls = scores[use], ids[use], nulls[use]
        if item in self.held:
            old = self.held[item]
            scores, ids, nulls = (np.concatenate(c) for c in zip(old, (scores, ids, nulls)))
        if len(scores) > self.top:
            edge = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            near = scores >= edge
            scores, ids, nulls = scores[near], ids[near], nulls[near]
            order = np.lexsort((ids, nulls, -scores))[:self.top]
            scores, ids, nulls = scores[order], ids[order], nulls[order]
        self.held[item] = scores, ids, nulls

    def batch(self):
        held = [(item, int(s), None if none else int(i)) for item, rows in self.held.items() for s, i, none in zip(*rows)]
        return pa.RecordBatch.from_arrays(
            [column([h[k] for h in held], pa.int64()) for k in range(3)], names=["item", "score", "doc_id"])


def _blocks(batch):
    for n_slices, n_docs, lengths, keys, bits in zip(*[batch.column(i).to_pylist() for i in range(5)]):
        yield n_slices, n_docs, np.frombuffer(lengths, np.int64), np.frombuffer(keys, np.int64), bits


def _hopeful(search: Pass, top):
    """Of each item, the keys of the highest upper bounds a task has seen."""
    def run(batches):
        best = Best(top)
        for batch in batches:
            for n_slices, n_docs, lengths, keys, bits in _blocks(batch):
                for cols, sums in _bounds(search, n_slices, n_docs, lengths, bits):
                    for item, bound in sums:
                        if bound is not None:
                            best.add(item, bound, keys[cols], np.zeros(len(bound), bool))
        yield best.batch()
    return run


def _possible(search: Pass, least):
    """The keys of documents whose upper bound reaches what some item's last place has."""
    def run(batches):
        for batch in batches:
            for n_slices, n_docs, lengths, keys, bits in _blocks(batch):
                for cols, sums in _bounds(search, n_slices, n_docs, lengths, bits):
                    may = np.zeros(len(keys[cols]), bool)
                    for item, bound in sums:
                        if bound is not None:
                            may |= bound >= max(least.get(item, 1), 1)
                    yield pa.RecordBatch.from_arrays([column(np.unique(keys[cols][may]), pa.int64())], names=["key"])
    return run


def _rescored(search: Pass, top):
    """The exact best of each item among the (doc_id, text) rows a task reads."""
    def run(batches):
        best = Best(top)
        for batch in batches:
            ids = batch.column(0)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for first, buf, off in chunks(batch.column(1)):
                terms, counts, different, n = counted(buf, off)
                at = np.searchsorted(search.terms, terms)
                known = search.terms[np.minimum(at, len(search.terms) - 1)] == terms
                owner, at, counts = spread(different)[known], at[known], counts[known]
                active, row = np.unique(at, return_inverse=True)
                width = max(1, WORK // max(len(active), 1))
                for low in range(0, len(n), width):
                    here = (owner >= low) & (owner < low + width)
                    some = min(width, len(n) - low)
                    gains = np.zeros((len(active), some), np.int64)
                    gains[row[here], owner[here] - low] = _gain(counts[here], search.lengths(n[owner[here]]))
                    for item, score in search.sums(gains, active):
                        if score is not None:
                            best.add(item, score, ids[first + low:first + low + some], nulls[first + low:first + low + some])
        yield best.batch()
    return run


FOUND = "item long, score long, doc_id long"


def _leading(found: DataFrame, top: int) -> DataFrame:
    """The best of each item among what the tasks kept of it: at most ``top`` rows a task."""
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def _items(batches):
    """(item_row, text) as (item_row, terms, times) with the different terms of each item."""
    for batch in batches:
        for first, buf, off in chunks(batch.column(1)):
            terms, counts, different, _ = counted(buf, off)
            ends = np.cumsum(different)
            cells = [(terms[e - d:e].tobytes(), counts[e - d:e].astype(np.int64).tobytes()) for d, e in zip(different, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(cells)), column(different, pa.int64()),
                 column([c[0] for c in cells], pa.binary()), column([c[1] for c in cells], pa.binary())],
                names=["item", "size", "terms", "times"])


def _passes(items: DataFrame, most: int):
    """The items in groups of at most ``most`` terms (one larger item is a group of its own).

    Only one group is with the driver at a time.
    """
    total = items.agg(F.sum("size").alias("t"), F.count("*").alias("n")).first()
    parts = max(1, -(-(total.t or 0) // max(most // 2, 1)))
    for part in range(parts):
        group = items.where((F.pmod(F.xxhash64("item"), F.lit(parts)) == part) & (F.col("size") > 0))
        held, size = [], 0
        for r in group.orderBy("item").toLocalIterator():
            if held and size + r.size > most:
                yield held
                held, size = [], 0
            held.append((r.item, np.frombuffer(r.terms, U), np.frombuffer(r.times, np.int64)))
            size += r.size
        if held:
            yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms are runs of ASCII letters and digits and of all other characters above 127, A-Z
    folded, told apart by 64-bit fingerprints. A score sums over the item's terms, repeats
    included. Only scores above 0 count; ties go to the smaller doc_id, null last. Each row of
    ``docs`` is a document of its own, also where ids or texts repeat; each row of ``items`` a
    search of its own. Texts without a term, and null ones, are found by nothing and find
    nothing; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("key", F.xxhash64("text"))
    index = build_index(keyed.where(F.col("text").isNotNull()), scratch_path(spark, "signatures"))
    blocks = index.where("kind = 'block'").select("slices", "docs", "lengths", "keys", "bits")
    asked = settle(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    with small_batches(spark):
        terms = settle(asked.select("item", "text").mapInArrow(_items, "item long, size long, terms binary, times binary"))
    size = index.where("kind = 'block'").agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    found = spark.createDataFrame([], FOUND + ", rank int")
    for group in _passes(terms, pass_terms) if size.n else ():
        found = found.unionByName(_searched(keyed, index, blocks, Pass(group, size.n, size.l), top))
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _searched(keyed, index, blocks, search: Pass, top):
    spark = keyed.sparkSession
    counts = index.where("kind = 'df'").select("keys", "lengths").mapInArrow(_df_rows(search.terms), "at long, df long")
    # At most one row for each term of the pass.
    for r in counts.groupBy("at").agg(F.sum("df").alias("df")).toLocalIterator():
        search.weights[r["at"]] = weight(search.n_docs, r["df"])

    def exact(keys):
        rows = narrow(keyed, keys, "key").select("doc_id", "text")
        return _leading(rows.mapInArrow(_rescored(search, top), FOUND), top)

    # A block row may hold a MB, so few rows make a batch.
    with small_batches(spark, 8):
        hopeful = settle(_leading(blocks.mapInArrow(_hopeful(search, top), FOUND), top).select(F.col("doc_id").alias("key")).distinct())
    with small_batches(spark):
        first = exact(hopeful).groupBy("item").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= top)
        least = {r["item"]: r["score"] for r in first.collect()}
    with small_batches(spark, 8):
        possible = settle(blocks.mapInArrow(_possible(search, least), "key long").distinct())
    with small_batches(spark):
        return settle(exact(possible))


def op13_lexical_search(spark, folder):
    return search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
counts AS (SELECT doc, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc, sum(tf)::BIGINT AS n FROM counts GROUP BY doc),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term),
asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY ALL),
scores AS (
  SELECT item, item_id, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc), totals
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""
