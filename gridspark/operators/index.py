"""Exact row positions, seeded shuffles and samples without a single-task sort.

Hash keys are uniform, so their leading digits are ready-made, evenly filled range
buckets: one cheap count per bucket gives the offsets, and rows are ranked inside
buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import key_bucket, shuffle_key
from gridspark.runtime import attach, stored

DIGITS = 4  # 65,536 buckets: about 15 million rows each at 10^12 rows


def global_index(df: DataFrame, order_cols, out: str = "pos") -> DataFrame:
    """Exact position of every row in the given order; a row hash breaks ties.

    Rows are range-partitioned (ties too, so one frequent value is not one task) and
    numbered inside their partition. The result is written once, so that partition numbers
    and offsets agree after any lost executor; counting reads the numbers alone.
    """
    order = [*order_cols, F.xxhash64(*df.columns)]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("_id", 33)  # partition number sits above the 33-bit row number
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so this window is as small as the partition count.
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(out, F.col("_start") + local).drop("_part", "_id", "_start")


def _bucket_starts(keyed: DataFrame, by) -> DataFrame:
    """Rows before each key bucket, per group: at most 16^DIGITS rows per group."""
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _keyed(df: DataFrame, seed, key: str) -> DataFrame:
    keyed = df.withColumn("_key", shuffle_key(seed, key))
    return keyed.withColumn("_bucket", key_bucket("_key", DIGITS))


def shuffle_rank(df: DataFrame, seed, key: str = "sample_id", out: str = "pos", by=()) -> DataFrame:
    """Position in a seeded random permutation, over all rows or inside each group."""
    by = list(by)
    keyed = _keyed(df, seed, key)
    starts = _bucket_starts(_keyed(df.select(*by, key), seed, key), by).drop("_n")
    placed = attach(keyed, starts, [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", key)
    rank = F.col("_start") + F.row_number().over(inside) - 1
    return placed.withColumn(out, rank).drop("_key", "_bucket", "_start")


def sample_exact(df: DataFrame, n: int | None, seed, key: str = "sample_id") -> DataFrame:
    """Exactly ``n`` rows, uniformly and without replacement; all of them if n is None.

    Buckets below the cut are taken whole by a filter; only the cut bucket is sorted.
    """
    if n is None:
        return df
    starts = _bucket_starts(_keyed(df.select(key), seed, key), [])
    cut = starts.where(F.col("_start") < n).orderBy(F.col("_bucket").desc()).limit(1).select(
        F.struct("_bucket", "_start")).scalar()
    keyed = _keyed(df, seed, key)
    whole = keyed.where(F.col("_bucket") < cut.getField("_bucket"))
    last = keyed.where(F.col("_bucket") == cut.getField("_bucket"))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", key))
    last = last.withColumn("_nth", nth).where(F.col("_nth") <= F.lit(n) - cut.getField("_start"))
    return whole.unionByName(last.drop("_nth")).drop("_key", "_bucket")


def sample_by_ids(df: DataFrame, ids: DataFrame, n: int | None, seed, key: str = "sample_id") -> DataFrame:
    """Rows whose id is among ``n`` drawn from the distinct ``ids``.

    Gives the ids of :func:`sample_exact`, but ``df`` is only filtered, by the largest
    hash key drawn; it may have several rows per id and is read once.
    """
    if n is None:
        return df
    last = sample_exact(ids.select(key), n, seed, key).agg(
        F.max(shuffle_key(seed, key)).alias("last")).scalar()
    return df.where(shuffle_key(seed, key) <= last)
