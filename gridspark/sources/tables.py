"""Cubes, vectors, scores, summaries and metadata in Spark's own formats.

Writers overwrite by default; pass mode="append" to add.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: features that have one number per column instead of one per level.
SINGLE_LEVEL = ("slp", "lat", "lon")


def write_cube(df: DataFrame, path: str, by: str = "year", mode: str = "overwrite",
               regroup: bool = False) -> None:
    """Compressed Parquet, a folder per ``by`` value, sorted for level and time pruning.

    Tasks write what they hold, without a shuffle, which suits loads by time range.
    ``regroup`` first gathers rows of a time step where they are scattered; rows are
    spread by value and time, so one large year is not one task.
    """
    order = [c for c in ("plevel", "time") if c in df.columns]
    rows = df.repartition(by, "time") if regroup else df
    rows.sortWithinPartitions(by, *order).write.mode(mode).partitionBy(by).option(
        "compression", "zstd").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several folders as one table, tagged with their ``source``."""
    tagged = [spark.read.parquet(p).withColumn("source", F.lit(name)) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, tagged)


def tagged(parts) -> DataFrame:
    """Tables of one shape as one, numbered in their order by ``source``."""
    return reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(f"{i:06d}")) for i, p in enumerate(parts)])


def write_vectors_csv(df: DataFrame, path: str, col: str, width: int, header: bool = False,
                      key: str | None = "sample_id", mode: str = "overwrite") -> None:
    """A vector column as ``width`` CSV columns named 0 … width-1, after the key."""
    values = [F.get(col, F.lit(i)).alias(str(i)) for i in range(width)]
    df.select(*([key] if key else []), *values).write.mode(mode).option("header", header).csv(path)


def read_vectors_csv(spark: SparkSession, path: str, width: int, header: bool = False,
                     key: str | None = "sample_id", out: str = "features") -> DataFrame:
    names = [str(i) for i in range(width)]
    fields = ([f"{key} BIGINT"] if key else []) + [f"`{n}` DOUBLE" for n in names]
    rows = spark.read.schema(", ".join(fields)).option("header", header).csv(path)
    return rows.select(*([key] if key else []), F.array(*[F.col(f"`{n}`") for n in names]).alias(out))


def write_scored(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Targets and predictions as they are, arrays kept."""
    scored.write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).parquet(path)


def write_summary_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def input_width(features, plevels: int) -> int:
    """Length of the feature vector of one column."""
    single = sum(f in SINGLE_LEVEL for f in features)
    return (len(features) - single) * plevels + single


def dataset_metadata(columns: DataFrame, features, plevels: int, output_levels: int,
                     version: int = 0) -> DataFrame:
    """(key, value, version): sample count and vector widths."""
    facts = columns.agg(F.count("*").alias("total_samples")).select(F.explode(F.create_map(
        F.lit("total_samples"), F.col("total_samples"),
        F.lit("input_shape"), F.lit(input_width(features, plevels)).cast("bigint"),
        F.lit("output_shape"), F.lit(output_levels).cast("bigint"))))
    return facts.select("key", "value", F.lit(version).alias("version"))


def metadata_of(row: DataFrame, version: int) -> DataFrame:
    """A one-row table as (key, value, version) rows."""
    pairs = F.create_map(*[x for c in row.columns for x in (F.lit(c), F.col(c).cast("bigint"))])
    return row.select(F.explode(pairs)).select("key", "value", F.lit(version).alias("version"))


def merge_metadata(previous: DataFrame, new: DataFrame) -> DataFrame:
    """All keys of both; the newer version of a key wins."""
    newest = Window.partitionBy("key").orderBy(F.col("version").desc())
    both = previous.unionByName(new).withColumn("_nth", F.row_number().over(newest))
    return both.where(F.col("_nth") == 1).drop("_nth")
