"""Train / validation / test splits, mini-batches and random controls.

All of them are arithmetic on an exact position column (see ``index``), so they need no
shuffle of their own apart from the mini-batch ranking.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import hash_normal, shuffle_key
from gridspark.operators.index import shuffle_rank
from gridspark.runtime import attach, settle


def split_sizes(n: int, test_frac: float, val_frac: float) -> tuple[int, int, int]:
    """(train, val, test) row counts; fractions round down and train takes the rest."""
    n_test, n_val = math.floor(n * test_frac), math.floor(n * val_frac)
    return n - n_test - n_val, n_val, n_test


def split_counts(df: DataFrame, test_frac: float, val_frac: float) -> DataFrame:
    """The same counts for a table, as one row."""
    n = F.col("total_samples")
    sizes = df.agg(F.count("*").alias("total_samples")).select(
        "total_samples",
        F.floor(n * F.lit(test_frac)).alias("num_test_samples"),
        F.floor(n * F.lit(val_frac)).alias("num_val_samples"))
    rest = n - F.col("num_test_samples") - F.col("num_val_samples")
    return sizes.withColumn("num_train_samples", rest)


def chunked_split(df: DataFrame, n: int, test_frac: float, val_frac: float, batch_size: int,
                  exact: bool = False, skip_labels: bool = False,
                  targets=("gwfu", "gwfv"), pos="pos") -> DataFrame:
    """Label rows by the chunk they fall in; a chunk goes whole to the split it starts in.

    ``exact`` cuts at the sizes instead of at chunk edges. ``skip_labels`` empties the
    targets of train and validation rows; test rows always keep theirs.
    """
    n_train, n_val, n_test = split_sizes(n, test_frac, val_frac)
    chunk = min(size for size in (n_test, n_val, batch_size) if size)
    start = F.col(pos) if exact else F.col(pos) - F.col(pos) % chunk
    label = (F.when(start < n_train, "train").when(start < n_train + n_val, "val")
             .otherwise("test"))
    out = df.where(F.col(pos) < math.ceil(n / chunk) * chunk).withColumn("split", label)
    if skip_labels:
        out = out.withColumns({t: F.when(F.col("split") == "test", F.col(t)) for t in targets})
    return out


def tail_split(df: DataFrame, n: int, val_frac: float, pos="pos") -> DataFrame:
    """The last ``val_frac`` of the rows validate."""
    cut = int(n * (1.0 - val_frac))
    return df.withColumn("split", F.when(F.col(pos) < cut, "train").otherwise("val"))


def row_range(df: DataFrame, start: int, stop: int, pos="pos") -> DataFrame:
    return df.where((F.col(pos) >= start) & (F.col(pos) < stop))


def attribution_split(df: DataFrame, background: int = 4500, test: int = 5000, pos="pos") -> DataFrame:
    """The first rows explain against, the next rows are explained."""
    role = F.when(F.col(pos) < background, "background").otherwise("test")
    return row_range(df, 0, background + test, pos).withColumn("role", role)


def eval_subsample(df: DataFrame, n: int, chunk: int = 100_000, pos="pos") -> DataFrame:
    """Exactly n rows if n is below a chunk, else whole chunks until n is covered."""
    return row_range(df, 0, n if n < chunk else math.ceil(n / chunk) * chunk, pos)


def batches_per_epoch(n: int, batch_size: int) -> int:
    return int(n / batch_size)


def minibatches(df: DataFrame, batch_size: int, chunk_size: int, seed, steps: int | None = None,
                source="source", key="sample_id") -> DataFrame:
    """Balanced batches: each takes batch_size / n_sources rows from every source.

    A source is read in seeded order, chunk by chunk; rows are shuffled inside a chunk,
    and the short rest of a chunk is dropped. With ``steps``, a source that runs out
    starts again until every batch up to ``steps`` is filled; without, one pass is given.
    """
    # Source sizes, one row each, fix how many full batches every chunk gives.
    sizes = settle(df.groupBy(source).agg(F.count("*").alias("_rows")))
    per_source = batch_size // max(sizes.count(), 1)
    full = chunk_size // per_source
    rest = F.floor(F.col("_rows") % chunk_size / per_source)
    sizes = sizes.withColumn("_batches", F.floor(F.col("_rows") / chunk_size) * full + rest)

    # Only the keys are ranked; the rows are joined to their batch once, at the end.
    narrow = df.select(source, key)
    placed = attach(shuffle_rank(narrow, seed, key, "_pos", by=(source,)), sizes, [source], settled=True)
    chunked = placed.withColumns({"_chunk": F.floor(F.col("_pos") / chunk_size),
                                  "_mix": shuffle_key(f"{seed}/mix", key)})
    mixed = Window.partitionBy(source, "_chunk").orderBy("_mix", key)
    ranked = chunked.withColumn("_rank", F.row_number().over(mixed) - 1)
    chunk_rows = F.least(F.lit(chunk_size), F.col("_rows") - F.col("_chunk") * chunk_size)
    kept = ranked.where(F.col("_rank") < F.floor(chunk_rows / per_source) * per_source)
    batched = kept.withColumn("batch_id", F.col("_chunk") * full + F.floor(F.col("_rank") / per_source))
    if steps is not None:
        again = F.sequence(F.col("batch_id"), F.lit(steps - 1).cast("bigint"), F.col("_batches"))
        batched = batched.where(F.col("batch_id") < steps).withColumn("batch_id", F.explode(again))
    placed = batched.select(F.col(source).alias("_source"), F.col(key).alias("_key"), "batch_id")
    return df.join(placed, F.col(source).eqNullSafe(F.col("_source")) & (F.col(key) == F.col("_key"))).drop(
        "_source", "_key")


def random_control(df: DataFrame, seed, width: int, key="sample_id", out="features") -> DataFrame:
    """Replace the features by N(0, 1) draws fixed by seed and sample id."""
    return df.withColumn(out, hash_normal(seed, key, width))
