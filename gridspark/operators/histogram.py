"""Equal-width histograms over the whole range of each group.

Two aggregates: the range per group, then counts per bin. Both combine before the
shuffle, so what moves is bins, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import is_number, minmax_norm
from gridspark.operators.scaler import scaler_transform
from gridspark.runtime import attach, settle


def histogram(df: DataFrame, col: str, bins: int = 100, by=(), density: bool = True) -> DataFrame:
    """(by…, bin, lo, hi, count[, density]) with empty bins; the last bin is closed."""
    by = list(by)
    values = df.select(*by, F.col(col).cast("double").alias("_v")).where(is_number("_v"))
    ranges = values.groupBy(*by).agg(
        F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_n"))
    flat = F.col("_min") == F.col("_max")
    ranges = settle(ranges.where("_n > 0").select(
        *by, "_n",
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_min"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_max"),
    ).withColumn("_width", (F.col("_max") - F.col("_min")) / bins))
    placed = attach(values, ranges, by, settled=True)
    slot = F.floor((F.col("_v") - F.col("_min")) / F.col("_width"))
    filled = placed.select(*by, F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"), F.lit(1).alias("c"))
    spine = ranges.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).alias("c"))
    counts = filled.unionByName(spine).groupBy(*by, "bin").agg(F.sum("c").alias("count"))
    full = attach(counts, ranges, by, settled=True)
    out = [*by, "bin",
           (F.col("_min") + F.col("bin") * F.col("_width")).alias("lo"),
           (F.col("_min") + (F.col("bin") + 1) * F.col("_width")).alias("hi"),
           "count"]
    if density:
        out.append((F.col("count") / (F.col("_n") * F.col("_width"))).alias("density"))
    return full.select(*out)


def normalise_histogram(hist: DataFrame, by=(), value="density") -> DataFrame:
    """Bin height as a fraction of the highest bin, and that fraction's min-max norm."""
    # A histogram has a fixed number of bins per group, so these windows stay small.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    fraction = hist.withColumn("fraction", F.try_divide(value, F.max(value).over(group)))
    lo, hi = F.min("fraction").over(group), F.max("fraction").over(group)
    return fraction.withColumn("norm", minmax_norm("fraction", lo, hi))


def histogram_pair(pairs: DataFrame, bins: int = 1000, by=("plevel",), density: bool = True) -> DataFrame:
    """Predictions and targets, each over its own range."""
    series = F.array(
        F.struct(F.lit("prediction").alias("series"), F.col("prediction").alias("value")),
        F.struct(F.lit("target").alias("series"), F.col("target").alias("value")))
    stacked = pairs.select(*by, F.inline(series))
    return histogram(stacked, "value", bins, [*by, "series"], density)


def scaled_histogram(targets: DataFrame, state: DataFrame, col: str, bins: int = 1000,
                     n: int = 100_000, pos="pos") -> DataFrame:
    """Counts of the scaled targets of the first n rows, per level, deepest level first."""
    scaled = scaler_transform(targets.where(F.col(pos) < n), state, col, "_scaled")
    levels = scaled.select(F.posexplode("_scaled").alias("plevel", "value"))
    return histogram(levels, "value", bins, ["plevel"], density=False).orderBy(
        F.col("plevel").desc(), "bin")
