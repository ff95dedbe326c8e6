"""Session, shared scratch space, and joins of data with small per-group state."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables up to this many rows may be broadcast; larger ones are joined by a plain shuffle.
BROADCAST_ROWS = 200_000


def local_session(cpus: str = "8") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a local session, once per application.

    A cluster has it installed, or gets it with the job (--py-files).
    """
    context = spark.sparkContext
    if context.master.startswith("local") and context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="gridspark-code-"), "gridspark")
        context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), "gridspark"))
        _SHIPPED.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gridspark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/gridspark/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once into the reliable checkpoint folder and cut the lineage there."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once below the shared folder and read back, column by column where asked."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def is_small(state: DataFrame) -> bool:
    return state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(state: DataFrame) -> DataFrame:
    """A dimension table with a broadcast hint, if its row count allows one."""
    return F.broadcast(state) if is_small(state) else state


def attach(df: DataFrame, state: DataFrame, on=(), settled: bool = False,
           few: bool | None = None) -> DataFrame:
    """Add the columns of ``state`` (one row per group) to every row of its group.

    Every row stays: a row whose group has no state gets nulls, and a null key matches a
    null key. A single-row state becomes a scalar subquery. A keyed state is computed once
    and counted; up to ``BROADCAST_ROWS`` rows it is broadcast, and beyond that the same
    equality is a shuffle join, which adaptive execution splits where a group is hot. ``few``
    saves the count where the caller has made it for the same groups.
    """
    on = list(on)
    if not on:
        packed = state.select(F.struct("*")).scalar()
        return df.withColumns({c: packed.getField(c) for c in state.columns})
    if few is None:
        state = state if settled else settle(state)
        few = is_small(state)
    keys = {k: f"_on_{k}" for k in on}
    match = [F.col(k).eqNullSafe(F.col(other)) for k, other in keys.items()]
    right = state.withColumnsRenamed(keys)
    return df.join(F.broadcast(right) if few else right, match, "left").drop(*keys.values())
