"""Standard scaling with mergeable state: one row (idx, n, mean, m2) per vector element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import scale_vector, unscale_vector
from gridspark.runtime import attach


def scaler_fit(df: DataFrame, col: str) -> DataFrame:
    """Count, mean and squared deviations of every element; NaN and nulls ignored.

    An element without any number keeps its row, with count 0. Tasks combine before the
    shuffle, so each sends one row per element at most.
    """
    elements = df.select(F.posexplode(col).alias("idx", "v"))
    v = F.when(~F.isnan("v"), F.col("v").cast("double"))
    n = F.count(v)
    return elements.groupBy("idx").agg(
        n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2"))


def scaler_merge(state: DataFrame, new_state: DataFrame) -> DataFrame:
    """State of the union of two disjoint row sets; either may lack an element."""
    a, b = state.alias("a"), new_state.alias("b")
    zero = F.lit(0)
    na, nb = F.coalesce("a.n", zero), F.coalesce("b.n", zero)
    ma, mb = F.coalesce("a.mean", F.lit(0.0)), F.coalesce("b.mean", F.lit(0.0))
    n, gap = na + nb, mb - ma
    between = gap * gap * F.try_divide(na * nb, n)
    return a.join(b, F.col("a.idx") == F.col("b.idx"), "full").select(
        F.coalesce("a.idx", "b.idx").alias("idx"),
        n.alias("n"),
        (ma + gap * F.try_divide(nb, n)).alias("mean"),
        (F.coalesce("a.m2", F.lit(0.0)) + F.coalesce("b.m2", F.lit(0.0)) + between).alias("m2"))


def scaler_arrays(state: DataFrame) -> DataFrame:
    """The state as one row of arrays by element; one without spread has scale 1.

    Elements are placed by their index, so one that no row ever had leaves a null mean
    there and moves no other.
    """
    spread = F.sqrt(F.try_divide("m2", "n"))
    scale = F.when(spread > 0, spread).otherwise(1.0)
    held = state.agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct("mean", scale.alias("scale"))))).alias("s"),
                     F.max("idx").alias("last"))
    at = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("s")[i])
    return held.select(F.transform(at, lambda e: e["mean"]).alias("_mean"),
                       F.transform(at, lambda e: F.coalesce(e["scale"], F.lit(1.0))).alias("_scale"))


def _with_state(df: DataFrame, state: DataFrame, value, out: str) -> DataFrame:
    # One row with two arrays of the vector's width: attached as a scalar subquery.
    return attach(df, scaler_arrays(state)).withColumn(out, value).drop("_mean", "_scale")


def scaler_transform(df: DataFrame, state: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return _with_state(df, state, scale_vector(col, "_mean", "_scale"), out or col)


def scaler_inverse(df: DataFrame, state: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return _with_state(df, state, unscale_vector(col, "_mean", "_scale"), out or col)


def save_scaler(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
