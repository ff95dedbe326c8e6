"""Repeated byte strings removed, by a difference cover and buckets of suffixes.

A string of ``length`` bytes that starts at two places is found without sorting all suffixes.
Places whose residue modulo v lies in a difference cover form the cover sample: for any two
places there is a shift below v that brings both into it. Sample suffixes are compared on
``length`` - v + 1 bytes; the rank of a unique one settles that nothing near it repeats. Only
the suffixes before tied samples are left, and these are dealt into buckets, each sorted on
its own in one task's bounded memory; long ties, up to the full length, are decided by
fingerprints of ``length`` bytes (64 bits, and as many more as there are buckets). Equal texts
are one owner from the start, and a string held by many owners leaves a task as one number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.links import narrow, parted, release, small_batches
from gridspark.llm.text import Prints, chunks, column, inside, lean, spread, unpacked
from gridspark.llm.ties import tied_entries
from gridspark.runtime import discard, scratch_path, settle, ship_package

LENGTH = 400
# A perfect difference set: every residue but 0 is a difference of two of them exactly once.
MODULUS = 133
COVER = (1, 8, 9, 11, 25, 37, 69, 88, 94, 99, 103, 121)
# Such a set for strings too short to wait 133 bytes for a sample.
SHORT_MODULUS = 57
SHORT_COVER = (0, 1, 3, 13, 32, 36, 43, 52)
# Buckets a partition of samples, and one of suffixes, is sorted in, one at a time.
BUCKETS = (1, 2)


def cover_mask(modulus: int = MODULUS, cover=COVER) -> np.ndarray:
    mask = np.zeros(modulus, bool)
    mask[list(cover)] = True
    return mask


def _sample(length, modulus, cover):
    """Entries of the cover sample of (owner, text) rows, compared on the bytes all ties share.

    Their places are numbers within the sample; see ``_places``.
    """
    short = length - modulus + 1
    mask = cover_mask(modulus, cover)

    def run(batch):
        owners = batch.column(0).to_numpy()
        for first, buf, off in chunks(batch.column(1)):
            sizes = np.diff(off)
            place = inside(sizes)
            room = np.repeat(sizes - short, sizes)
            at = np.flatnonzero(mask[place % modulus] & (place <= room))
            if len(at):
                row = np.searchsorted(off, at, "right") - 1
                number = np.arange(len(at)) - np.searchsorted(at, off[:-1])[row]
                yield Prints(buf).of(at, at + short), owners[first + row], number.astype(np.int32)
    return run


def _places(cell, modulus, cover):
    """The places in a text that a packed list of sample numbers stands for."""
    number = unpacked([cell], np.int32).astype(np.int64)
    return number // len(cover) * modulus + np.array(sorted(cover))[number % len(cover)]


def _open(places, sizes, off, length, modulus):
    """Marks the starts of strings that hold a tied sample within the first ``modulus`` bytes."""
    edge = np.zeros(int(off[-1]) + 1, np.int32)
    counts = np.array([len(p) for p in places], np.int64)
    row = spread(counts)
    at = np.concatenate(places) if len(places) else np.zeros(0, np.int64)
    low = np.maximum(at - modulus + 1, 0)
    high = np.minimum(at, sizes[row] - length)
    use = low <= high
    np.add.at(edge, off[:-1][row[use]] + low[use], 1)
    np.add.at(edge, off[:-1][row[use]] + high[use] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _suffixes(length, modulus, cover):
    """Entries of all strings of (owner, text, places) rows that may repeat."""
    def run(batch):
        owners = batch.column(0).to_numpy()
        for first, buf, off in chunks(batch.column(1)):
            sizes = np.diff(off)
            places = [_places(c, modulus, cover) for c in batch.column(2).slice(first, len(sizes)).to_pylist()]
            at = np.flatnonzero(_open(places, sizes, off, length, modulus))
            if len(at):
                row = np.searchsorted(off, at, "right") - 1
                yield (Prints(buf).of(at, at + length), owners[first + row], (at - off[:-1][row]).astype(np.int32))
    return run


def _cut(length):
    def run(batches):
        for batch in batches:
            owners, cells = batch.column(0), batch.column(2)
            for first, buf, off in chunks(batch.column(1)):
                n = len(off) - 1
                out = []
                for i, found in enumerate(cells.slice(first, n).to_pylist()):
                    text = buf[off[i]:off[i + 1]]
                    edge = np.zeros(len(text) + 1, np.int32)
                    at = unpacked([found], np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = text[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays(
                    [owners.slice(first, n), *[column([o[k] for o in out], t) for k, t in enumerate(
                        (pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                    names=["owner", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _owner(sha):
    """A signed 64-bit owner from the first hex digits of a text's sha256."""
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, modulus: int = MODULUS, cover=COVER, buckets=BUCKETS):
    """Two tables: the facts of every row of ``docs``, and the texts that lose a part.

    Facts: doc_id, n_bytes, n_removed, n_spans, kept_sha256, sha (of the whole text) of each
    row, a null text being empty. Every byte of a string of ``length`` bytes that starts anywhere else too goes,
    the same text included; matches never cross rows. Texts shorter than that stay. A text that
    occurs in several rows goes whole if it is long enough. Rows with one doc_id, or with none,
    are judged each by its own text.

    Cut texts: doc_id, sha (of the whole text), kept (bytes) of each text of one row that loses a
    part; texts removed whole as copies are not among them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with small_batches(spark):
        return _repeated_bytes(spark, docs, length, modulus, cover, buckets)


def _repeated_bytes(spark, docs, length, modulus, cover, buckets):
    # The key finds one row of a text again; ids may be null or repeat.
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "sha", F.sha2("text", 256))
    facts = settle(rows.select("doc_id", "key", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    whole = facts.where(F.col("n_bytes") >= length).groupBy("sha").agg(
        F.min("key").alias("key"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")).withColumn("owner", _owner("sha"))

    texts = rows.where(F.octet_length("text") >= length).withColumn("owner", _owner("sha"))
    sample = settle(tied_entries(texts.select("owner", "text"), _sample(length, modulus, cover), by_place=True,
                                 short=True, buckets=buckets[0]))
    release(spark)
    asked = whole.join(sample, "owner").select("owner", "key", "places")
    path = scratch_path(spark, "tied")
    narrow(texts, asked, "key").select("key", "owner", "text").join(asked.hint("merge"), ["key", "owner"]).drop("key").dropDuplicates(
        ["owner"]).write.parquet(path)
    tied = spark.read.parquet(path)

    release(spark)
    again = tied_entries(tied.select("owner", "text", "places"), _suffixes(length, modulus, cover), by_place=True,
                         salt=0x2F0B5A11, buckets=buckets[1])
    cut = tied.select("owner", "text").join(again.select("owner", "places"), "owner").select("owner", "text", "places")
    cut = settle(cut.mapInArrow(lean(_cut(length)), "owner long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    del again  # or it would hold on to the shuffle of all suffixes
    discard(spark, path)
    release(spark)

    known = whole.select("sha", "owner", "copies").join(cut.drop("kept"), "owner", "left").drop("owner")
    out = facts.join(known, "sha", "left")
    empty = hashlib.sha256(b"").hexdigest()
    copied = F.col("copies") > 1
    facts = out.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), "sha")
    single = whole.where("copies = 1").join(cut.select("owner", "kept"), "owner")
    return facts, single.select(F.col("rep").alias("doc_id"), "sha", "kept")


def drop_repeats(docs: DataFrame, length: int = LENGTH, modulus: int = MODULUS, cover=COVER, buckets=BUCKETS) -> DataFrame:
    """``docs`` without the repeated bytes; rows of which nothing is left go, unless they were empty.

    A character cut in two by the edge of a removed string goes with it. ``n_chars``, if
    there, is counted anew for the rows that lost something.
    """
    facts, cut = repeated_bytes(docs, length, modulus, cover, buckets)
    lost = settle(facts.where(F.col("n_removed") > 0).select(F.col("doc_id").alias("_id"), F.col("sha").alias("_cut")).distinct())
    changed = lost.join(cut.select(F.col("sha").alias("_cut"), "kept"), "_cut", "left")
    known = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    # Most texts keep every byte and need not move.
    known, same = parted(known, lost.select(F.col("_cut").alias("_sha")), "_sha")
    rows = known.join(changed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_cut")), "left")
    plain = F.col("_cut").isNull()
    kept = F.col("kept").cast("string")
    text = F.when(plain, F.col("text")).otherwise(
        F.coalesce(F.try_validate_utf8(kept), F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", "")))
    rows = rows.withColumn("text", text).where(plain | (F.octet_length("text") > 0))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(plain, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return rows.select(*docs.columns).unionByName(same.select(*docs.columns))


def op3_suffix_dedup(spark, folder):
    return repeated_bytes(spark.read.parquet(f"{folder}/documents.parquet"))[0].drop("sha")
