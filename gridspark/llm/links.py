"""Connected components of a table of links, and a cheap filter before a join by id."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridspark.runtime import settle

BITS = 24
WORD_BITS = 32_768


def counted(df: DataFrame, condition=None) -> tuple[DataFrame, int]:
    """The settled table and how many of its rows meet a condition, counted as they are made."""
    seen = Observation()
    what = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return settle(df.observe(seen, what.alias("n"))), seen.get["n"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the smallest node it is joined with.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by
    pointer doubling, and contracts the links. Nodes that still differ are local minima, at
    most half of them, so rounds grow with the logarithm. A star is done after one round.
    Null ends and self links say nothing; no links give no rows.
    """
    edges, left = counted(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while left:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = settle(both.groupBy("node").agg(F.min("other").alias("m")).select(
            "node", F.least("node", "m").alias("root")))
        moved = 1
        while moved:
            ahead = hooks.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
            jumped, moved = counted(hooks.join(ahead, F.col("root") == F.col("_at")).select(
                "node", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("moved")), F.col("moved"))
            hooks = jumped.select("node", "root")
        if roots is None:
            roots = hooks
        else:
            at = hooks.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
            roots = settle(roots.join(at, F.col("root") == F.col("_at"), "left").select(
                "node", F.coalesce("_next", "root").alias("root")))
        of_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges, left = counted(edges.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _marked(rows: DataFrame, ids: DataFrame, key: str, bits: int) -> DataFrame:
    """``rows`` with ``_asked``: whether the key may be among ``ids``, by a broadcast bitmap."""
    spot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    marks = ids.where(F.col(key).isNotNull()).select(spot.alias("_h")).groupBy(
        F.expr(f"_h div {WORD_BITS}").alias("_word")).agg(
        F.expr(f"bitmap_construct_agg(_h % {WORD_BITS})").alias("_map"))
    byte = F.expr(f"cast(conv(hex(substring(_map, cast((_h % {WORD_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
    held = rows.withColumn("_h", spot).withColumn("_word", F.expr(f"_h div {WORD_BITS}")).join(
        F.broadcast(marks), "_word", "left")
    return held.withColumn("_asked", F.coalesce(F.getbit(byte, F.expr("cast(_h % 8 as int)")) == 1, F.lit(False)))


def narrow(rows: DataFrame, ids: DataFrame, key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """The rows whose key may be among ``ids``: all that are, and few others.

    A bitmap of 2**bits hashed keys (2 MB, whatever the data) is broadcast, so wide rows
    nobody asks for do not enter the shuffle of the exact join that must follow. When ids
    outgrow the bitmap it lets more rows through; the join stays right. A null key is dropped.
    """
    return _marked(rows.where(F.col(key).isNotNull()), ids, key, bits).where("_asked").select(*rows.columns)


def parted(rows: DataFrame, ids: DataFrame, key: str, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among ``ids``, and those whose key certainly is not."""
    marked = _marked(rows, ids, key, bits)
    return marked.where("_asked").select(*rows.columns), marked.where("not _asked").select(*rows.columns)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished, settled steps before the next large one.

    Spark removes them once the driver has collected what referred to them, which a quiet
    driver may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of whole texts of at most so many rows, for what is computed inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
