"""Which of many fingerprints occur more than once, with their owners, in bounded memory.

Entries (key, owner, place) of all rows are dealt by key as packed numbers, several buckets
per shuffle partition, and one bucket at a time is sorted. Before that, a task resolves what
it can see itself: a key that several of its owners hold is settled at once and shipped on
without them, so a key held by a third of all rows is one number per task and flush. What is
found goes to its owners in a second exchange of packed numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.text import U, column, dealt, joined, lean, mix, packed, packed_runs, runs, unpacked, unpacked_runs

FLUSH = 400_000
ENTRIES = ["part", "keys", "owners", "places", "hot", "told_owners", "told_places"]
FOUND = ["part", "owners", "places"]


def _kept(keys, owners, places, hot, by_place):
    """(entries without repeats, which of their keys are held by several, those keys)."""
    n = len(keys)
    order, starts, sizes = runs(np.concatenate([keys, hot]))
    if not len(order):
        return order, np.zeros(0, bool), keys[:0]
    who = owners.astype(U)
    if by_place:
        who = mix(who + mix(places.astype(U) + U(1)))
    known = order >= n
    ids = np.concatenate([who, np.zeros(len(hot), U)])[order]
    low = np.minimum.reduceat(np.where(known, U(2**64 - 1), ids), starts)
    high = np.maximum.reduceat(np.where(known, U(0), ids), starts)
    several = np.logical_or.reduceat(known, starts) | (low != high)
    # An untied key has one holder; its first entry stands for its repeats.
    use = np.repeat(several, sizes)
    tied = use.copy()
    use[starts] = True
    use &= ~known
    return order[use], tied[use], np.concatenate([keys, hot])[order[starts[several]]]


def _told(owners, places, by_place):
    """Tied entries without repeats, ordered by owner; without places, a count per owner."""
    if not by_place:
        return np.unique(owners, return_counts=True)
    order = np.lexsort((places, owners))
    owners, places = owners[order], places[order]
    new = np.ones(len(owners), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (places[1:] != places[:-1])
    return owners[new], places[new]


def _spot(numbers, salt, n):
    return (mix(numbers ^ U(salt)) % U(n)).astype(np.int64)


def _map(entries_of, key_type, n, by_place, salt):
    def deal(batches):
        held, count = [], 0

        def flush():
            keys, owners, places = (np.concatenate(c) for c in zip(*held))
            entries, tied, hot = _kept(keys, owners, places, keys[:0], by_place)
            told = _told(owners[entries[tied]], places[entries[tied]], by_place)
            lone = np.sort(entries[~tied])
            # The bucket is drawn from other bits than the key that is sorted inside it.
            short = (lambda k: (k >> U(32)).astype(key_type)) if key_type != U else (lambda k: k)
            rows = dict(dealt(_spot(keys[lone], salt, n), n, [
                short(keys[lone]), owners[lone], places[lone].astype(np.int32)], [np.ndarray.tobytes, packed_runs, packed]))
            marks = dict(dealt(_spot(hot, salt, n), n, [short(hot)]))
            # Settled entries spread by owner and place: one owner in many tasks is no hot spot.
            at = told[0].astype(U) + (mix(told[1].astype(U)) if by_place else U(0))
            known = dict(dealt(_spot(at, salt + 1, n), n, [told[0], told[1].astype(np.int32)], [packed_runs, packed]))
            parts = sorted(rows.keys() | marks.keys() | known.keys())
            cells = [[*rows.get(p, [None] * 3), *marks.get(p, [None]), *known.get(p, [None] * 2)] for p in parts]
            yield pa.RecordBatch.from_arrays(
                [column(parts, pa.int32()), *[column([c[i] for c in cells], pa.binary()) for i in range(6)]],
                names=ENTRIES)

        for batch in batches:
            for entries in entries_of(batch):
                # A very long text comes in pieces: what is held at once stays bounded.
                for start in range(0, len(entries[0]), FLUSH):
                    held.append([e[start:start + FLUSH] for e in entries])
                    count += len(held[-1][0])
                    if count >= FLUSH:
                        yield from flush()
                        held, count = [], 0
        if count:
            yield from flush()
    return deal


def _sort(key_type, n_owner_parts, by_place, salt):
    def sort(batches):
        held = {}
        for batch in batches:
            cells = [batch.column(i).to_pylist() for i in range(7)]
            for row in zip(*cells):
                held.setdefault(row[0], []).append(row[1:])
        for part in sorted(held):
            keys, owners, places, hot, told_owners, told_places = zip(*held.pop(part))
            owners, places = unpacked_runs(owners), unpacked(places, np.int32)
            entries, tied, _ = _kept(joined(keys, key_type), owners, places, joined(hot, key_type), by_place)
            found = entries[tied]
            owners, places = _told(owners[found], places[found], by_place)
            owners = np.concatenate([owners, unpacked_runs(told_owners)])
            places = np.concatenate([places, unpacked(told_places, np.int32)])
            if by_place:
                owners, places = _told(owners, places, True)
            rows = list(dealt(_spot(owners.astype(U), salt + 2, n_owner_parts), n_owner_parts,
                              [owners, places.astype(np.int32)], [packed_runs, packed]))
            yield pa.RecordBatch.from_arrays(
                [column([p for p, _ in rows], pa.int32()),
                 *[column([c[i] for _, c in rows], pa.binary()) for i in range(2)]], names=FOUND)
    return sort


def _gather(by_place):
    def gather(batches):
        held = {}
        for batch in batches:
            for part, owners, places in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                held.setdefault(part, []).append((owners, places))
        for part in sorted(held):
            owners, places = zip(*held.pop(part))
            owners, places = unpacked_runs(owners), unpacked(places, np.int32)
            if by_place:
                owners, places = _told(owners, places, True)
            else:
                owners, row = np.unique(owners, return_inverse=True)
                places = np.bincount(row, places, len(owners)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(owners)].astype(np.int64)
            cells = [packed(places[s:e]) for s, e in zip(starts, ends)] if by_place else [None] * len(starts)
            yield pa.RecordBatch.from_arrays(
                [column(owners[starts], pa.int64()), column(ends - starts if by_place else places, pa.int64()),
                 column(cells, pa.binary())], names=["owner", "n", "places"])
    return gather


def tied_entries(rows: DataFrame, entries: Callable, by_place: bool, short: bool = False,
                 salt: int = 0x51ED2701, buckets: int = 2) -> DataFrame:
    """(owner, n, places): for every owner with tied entries, how many, and where.

    An entry is tied if another entry holds its key. ``entries`` turns an Arrow batch into
    arrays (keys uint64, owners int64, places int32). With ``by_place`` another place of the
    same owner counts as another entry, and ``places`` packs the tied ones in order; an owner
    and place that several rows hold is one entry. Without it only other owners count, there
    are no places, and n is never too low, but too high where several rows hold one owner.
    ``short`` ships 32 bits of a key instead of 64: some keys then look tied that are not,
    for callers that test again. The more ``buckets`` a partition has, the less its task holds
    at once, and the fewer entries of one owner are packed together.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = parts * buckets
    kind = np.uint32 if short else U
    spot = F.pmod("part", F.lit(parts)).cast("int")
    # What is found goes back in whole partitions: buckets there would only make more rows.
    dealt_out = rows.mapInArrow(
        lean(_map(entries, kind, n, by_place, salt)),
        "part int, keys binary, owners binary, places binary, hot binary, told_owners binary, told_places binary")
    found = dealt_out.repartitionById(parts, spot).mapInArrow(
        lean(_sort(kind, parts, by_place, salt)), "part int, owners binary, places binary")
    return found.repartitionById(parts, spot).mapInArrow(lean(_gather(by_place)), "owner long, n long, places binary")
