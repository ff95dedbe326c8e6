"""Numbered versions of a small table, each complete or not there, and only the last few kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEEP = 3  # versions that stay: the newest, its predecessor, and one being read


def published(spark: SparkSession, path: str):
    """(file system, {number: folder}) of the versions below ``path`` that are complete."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    folders = {int(p.getName().removeprefix("batch=")): p for p in found if p.getName().startswith("batch=")}
    return files, {n: p for n, p in folders.items() if files.exists(hadoop(p, "_SUCCESS"))}


def publish(df: DataFrame, path: str, number: int, keep: int = KEEP) -> None:
    """Write version ``number`` and remove complete ones that are ``keep`` or more behind it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")
    files, done = published(df.sparkSession, path)
    for old, folder in done.items():
        if old <= number - keep:
            files.delete(folder, True)


def latest_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (below ``before`` if given); None if there is none."""
    _, done = published(spark, path)
    numbers = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={max(numbers)}") if numbers else None
