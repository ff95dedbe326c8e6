"""Tables kept in buckets of their sample id, so that they are joined where they lie.

A table is shuffled once, when it is written: rows of one id hash to one bucket, and a bucket is
one sorted file. Tables of equally many buckets then join bucket by bucket without an exchange,
in every epoch and every evaluation that reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.operators.reshape import paste_features

BUCKET_ROWS = 2_000_000


def buckets_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """A power of two that keeps buckets at ``per_bucket`` rows or fewer."""
    return 1 << max(0, -(-rows // per_bucket) - 1).bit_length()


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "sample_id",
                   mode: str = "overwrite") -> None:
    """Write ``df`` below ``path`` in ``buckets`` of ``key`` and name it ``table``.

    Sample ids are unique, so buckets are evenly filled; rows without an id share one bucket and
    join nothing. ``mode="append"`` adds a file to each bucket that gets rows; the number of
    buckets of a table cannot change, only a new table can have another.
    """
    df.repartition(buckets, key).write.mode(mode).option("path", path).option("compression", "zstd").bucketBy(
        buckets, key).sortBy(key).saveAsTable(table)


def paste_bucketed(spark: SparkSession, tables, key: str = "sample_id") -> DataFrame:
    """Bucketed tables side by side by id, as a merge join that moves no rows.

    Ids absent from any table drop out. Tables of unlike numbers of buckets still join rightly:
    Spark then shuffles the one with fewer.
    """
    return paste_features([spark.table(t).hint("merge") for t in tables], key)
