"""Variable summaries, box statistics, axis limits and joint samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import is_number, minmax_norm, scientific
from gridspark.operators.histogram import histogram
from gridspark.operators.index import sample_exact
from gridspark.operators.quantiles import exact_quantiles
from gridspark.runtime import attach, settle, small


def feature_summary(cells: DataFrame, variables, meta: DataFrame | None = None,
                    axes=("time", "plevel", "lat", "lon")) -> DataFrame:
    """One row per variable: shape, mean, population deviation, extremes; plus text forms.

    All variables are summarised in one scan by one aggregate.
    """
    extent = [(F.max(a) + 1).cast("string") for a in axes]
    shape = F.concat(F.lit("("), F.concat_ws(", ", *extent), F.lit(")"))
    stats = [F.struct(
        F.lit(v).alias("name"), shape.alias("shape"), F.count(v).alias("n"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.max(v).cast("double").alias("max"), F.min(v).cast("double").alias("min"),
    ).alias(v) for v in variables]
    rows = cells.agg(*stats).select(F.inline(F.array(*variables)))
    texts = {f"{c}_text": scientific(c) for c in ("mean", "std", "max", "min")}
    summary = rows.withColumns(texts)
    if meta is not None:
        described = meta.where(F.col("name").isin(list(variables))).dropDuplicates(["name"])
        summary = summary.join(small(described), "name", "left")
    return summary


def box_stats(df: DataFrame, col: str, by=()) -> DataFrame:
    """Quartiles, whiskers at the furthest points within 1.5 IQR, and the points beyond."""
    by = list(by)
    quartiles = exact_quantiles(df, col, [0.25, 0.5, 0.75], by).select(
        *by, F.col("n"), *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))])
    quartiles = settle(quartiles)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col(col).cast("double")
    known = attach(df.select(*by, value.alias("_v")).where(is_number("_v")), quartiles, by, settled=True)
    above = F.col("_v") >= F.col("q1") - reach
    under = F.col("_v") <= F.col("q3") + reach
    keep = [*by, "n", "q1", "median", "q3"]
    # A whisker never ends inside the box: without a point beyond, it is the box's edge.
    lowest, highest = F.min(F.when(above, F.col("_v"))), F.max(F.when(under, F.col("_v")))
    return known.groupBy(*keep).agg(
        F.least(lowest, F.col("q1")).alias("whisker_lo"),
        F.greatest(highest, F.col("q3")).alias("whisker_hi"),
        F.count_if(~(above & under)).alias("fliers"))


def value_limits(df: DataFrame, cols, symmetric: bool = False, pad: float = 1.0, by=()) -> DataFrame:
    """Common limits of several columns; symmetric ones reach ±pad times the largest size."""
    lows = [F.min(c) for c in cols]
    highs = [F.max(c) for c in cols]
    lo = F.least(*lows) if len(lows) > 1 else lows[0]
    hi = F.greatest(*highs) if len(highs) > 1 else highs[0]
    if symmetric:
        hi = F.greatest(F.abs(lo), hi) * pad
        lo = -hi
    return df.groupBy(*by).agg(lo.alias("vmin"), hi.alias("vmax"))


def minmax_scaled(df: DataFrame, col: str, out: str = "norm") -> DataFrame:
    """Min-max norm of a column over the whole table."""
    limits = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return attach(df, limits).withColumn(out, minmax_norm(col, "_lo", "_hi")).drop("_lo", "_hi")


def joint_scatter(df: DataFrame, x: str, y: str, n: int | None, seed, key: str, bins: int = 100):
    """A joint sample of two variables and the histogram of each over that sample."""
    points = sample_exact(df.select(key, x, y), n, seed, key)
    axes = F.array(
        F.struct(F.lit("x").alias("axis"), F.col(x).cast("double").alias("value")),
        F.struct(F.lit("y").alias("axis"), F.col(y).cast("double").alias("value")))
    marginals = histogram(points.select(F.inline(axes)), "value", bins, ["axis"])
    return points, marginals
