"""Errors of parts that add up: co-moments of prediction and target, merged without the pairs.

A part is a chunk of samples, a year or a batch. Its state holds counts, means, summed squares
and products about those means, and summed errors; states of any parts merge to the state of all
of them, so a new part is read alone. Squares are taken about the mean, never as a difference of
large sums, so small spreads on large values keep their digits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.metrics import error, regression_of
from gridspark.runtime import attach
from gridspark.sources.versions import publish, published


def error_state(pairs: DataFrame, by=("plevel",)) -> DataFrame:
    """One row per group: rows, n, means, m2_x, m2_y, c_xy, sum_abs, sum_sq.

    x is the prediction, y the target. ``rows`` counts all rows, the rest only pairs with both
    sides; a group without one has n 0, null means, and zero sums.
    """
    whole = F.col("prediction").isNotNull() & F.col("target").isNotNull()
    x, y = F.when(whole, F.col("prediction")), F.when(whole, F.col("target"))
    n = F.count(x)
    sums = {"m2_x": F.var_pop(x) * n, "m2_y": F.var_pop(y) * n, "c_xy": F.covar_pop(x, y) * n,
            "sum_abs": F.sum(F.abs(error())), "sum_sq": F.sum(error() * error())}
    return pairs.groupBy(*by).agg(
        F.count("*").alias("rows"), n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sums.items()])


def merge_states(states: DataFrame, by=("plevel",)) -> DataFrame:
    """The states of all parts as one per group, of the same shape; merging again is allowed."""
    total = F.sum("n")
    means = states.groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.col("mean_x")), total).alias("_x"),
                                    F.try_divide(F.sum(F.col("n") * F.col("mean_y")), total).alias("_y"))
    dx, dy = F.col("mean_x") - F.col("_x"), F.col("mean_y") - F.col("_y")
    between = {"m2_x": dx * dx, "m2_y": dy * dy, "c_xy": dx * dy}
    return attach(states, means, by).groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.first("_x").alias("mean_x"), F.first("_y").alias("mean_y"),
        *[F.sum(F.col(k) + F.coalesce(F.col("n") * d, F.lit(0.0))).alias(k) for k, d in between.items()],
        *[F.sum(k).alias(k) for k in ("sum_abs", "sum_sq")])


def metrics_of(state: DataFrame, by=("plevel",)) -> DataFrame:
    """n, mae, rmse and r_squared, as one pass over the pairs gives them."""
    return state.select(
        *by, F.col("rows").alias("n"), F.try_divide("sum_abs", "n").alias("mae"),
        F.sqrt(F.try_divide("sum_sq", "n")).alias("rmse"),
        F.coalesce(F.try_divide(F.col("c_xy") * F.col("c_xy"), F.col("m2_x") * F.col("m2_y")),
                   F.lit(0.0)).alias("r_squared"))


def lines_of(state: DataFrame, by=("plevel",)) -> DataFrame:
    """Regression line, r, its probability and slope error from a state."""
    over = lambda c: F.try_divide(c, "n")
    moments = state.select(*by, "n", F.col("mean_x").alias("mx"), F.col("mean_y").alias("my"),
                           over("m2_x").alias("vx"), over("m2_y").alias("vy"), over("c_xy").alias("cov"))
    return regression_of(moments, by)


def keep_part(state: DataFrame, path: str, number: int) -> None:
    """Store the state of part ``number``; a repeated part replaces itself, so none counts twice."""
    publish(state, path, number, keep=math.inf)


def all_parts(spark: SparkSession, path: str, by=("plevel",)) -> DataFrame | None:
    """The merged state of the complete parts below ``path``; None if there is none."""
    _, done = published(spark, path)
    parts = [spark.read.parquet(f"{path}/batch={n}") for n in sorted(done)]
    return merge_states(reduce(DataFrame.unionByName, parts), by) if parts else None
