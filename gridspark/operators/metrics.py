"""Error and correlation by pressure level, losses, and per-sample statistics.

Every by-level metric is one hash aggregate over mergeable moments: tasks combine before
the shuffle, so a level holding most of the rows costs one small buffer per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import (
    log_cosh, t_two_sided, vector_mean, vector_median, vector_std,
)
from gridspark.operators.quantiles import exact_quantiles
from gridspark.operators.reshape import with_pressure
from gridspark.runtime import attach

def error() -> Column:
    return F.col("target") - F.col("prediction")


def r_squared(x="prediction", y="target") -> Column:
    """Squared Pearson correlation as an aggregate; 0 when either side is constant."""
    cov = F.covar_pop(x, y)
    return F.coalesce(F.try_divide(cov * cov, F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def level_metrics(pairs: DataFrame, by="plevel") -> DataFrame:
    return pairs.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error())).alias("mae"),
        F.sqrt(F.avg(error() * error())).alias("rmse"),
        r_squared().alias("r_squared"),
    )


def level_r2(pairs: DataFrame, by="plevel") -> DataFrame:
    return pairs.groupBy(by).agg(r_squared().alias("r_squared"))


def level_regression(pairs: DataFrame, by="plevel") -> DataFrame:
    """Least-squares line target ~ prediction: slope, intercept, r, p-value and slope error."""
    moments = pairs.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg("prediction").alias("mx"),
        F.avg("target").alias("my"),
        F.var_pop("prediction").alias("vx"),
        F.var_pop("target").alias("vy"),
        F.covar_pop("prediction", "target").alias("cov"),
    )
    return regression_of(moments, [by])


def regression_of(moments: DataFrame, by) -> DataFrame:
    """The line from n, means (mx, my), population variances (vx, vy) and covariance (cov)."""
    slope = F.try_divide("cov", "vx")
    r = F.coalesce(F.try_divide(F.col("cov"), F.sqrt("vx") * F.sqrt("vy")), F.lit(0.0))
    unexplained = F.greatest(F.lit(0.0), (1 - r * r) * F.try_divide("vy", "vx"))
    free = F.col("n") - 2
    lines = moments.select(
        *by, "n",
        slope.alias("slope"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
        r.alias("r_value"),
        F.when(free > 0, F.sqrt(F.try_divide(unexplained, free))).alias("stderr"),
    )
    tiny = 1e-20  # keeps the statistic finite for a perfect fit
    r = F.col("r_value")
    t = r * F.sqrt(free / ((1 - r + tiny) * (1 + r + tiny)))
    return lines.withColumn("p_value", F.when(free > 0, t_two_sided(F.when(free > 0, t), free)))


def sample_stats(scored: DataFrame, vector="target") -> DataFrame:
    """Spread and centre of each sample's target over its levels."""
    return scored.select(
        "sample_id",
        vector_std(vector).alias("std"),
        F.array_min(vector).alias("min"),
        F.array_max(vector).alias("max"),
        vector_mean(vector).alias("mean"),
        vector_median(vector).alias("median"),
    )


def level_stats(pairs: DataFrame, value="target", by="plevel") -> DataFrame:
    """The same statistics over samples, one row per level."""
    spread = pairs.groupBy(by).agg(
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
    )
    middle = exact_quantiles(pairs, value, [0.5], (by,))
    return attach(spread, middle.select(by, F.col("quantiles")[0].alias("median")), [by])


def level_panels(pairs: DataFrame, levels: DataFrame, chosen: dict) -> DataFrame:
    """R² rounded to 3 at the chosen levels, {level: label}; only their rows are read."""
    picked = pairs.where(F.col("plevel").isin(list(chosen)))
    labels = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    return with_pressure(level_r2(picked), levels).withColumns({
        "r_squared": F.round("r_squared", 3), "label": labels[F.col("plevel")]})


def r2_profile(pairs: DataFrame, levels: DataFrame, reverse=False) -> DataFrame:
    profile = with_pressure(level_r2(pairs), levels)
    return profile.orderBy(F.col("plevel").desc() if reverse else F.col("plevel"))


def losses(pairs: DataFrame, by="plevel") -> DataFrame:
    return pairs.groupBy(by).agg(
        F.avg(log_cosh(error())).alias("log_cosh"),
        F.avg(error() * error()).alias("mse"),
        F.avg(F.abs(error())).alias("mae"),
        F.sqrt(F.avg(error() * error())).alias("rmse"),
    )


def total_losses(pairs: DataFrame, by="plevel") -> DataFrame:
    """Losses of a multi-output model: the sum over its outputs."""
    per_output = losses(pairs, by)
    return per_output.agg(*[F.sum(c).alias(c) for c in ("log_cosh", "mse", "mae", "rmse")])


def composite_loss(pairs: DataFrame, switch_level: int = 13) -> DataFrame:
    """Mean square error below ``switch_level``, mean absolute error from it on."""
    loss = F.when(F.col("plevel") < switch_level, error() * error()).otherwise(F.abs(error()))
    return pairs.groupBy("plevel").agg(F.avg(loss).alias("loss"))
