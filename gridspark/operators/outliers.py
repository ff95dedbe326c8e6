"""Robust outlier flags from the median absolute deviation (MAD).

A value is an outlier when 0.6745 * |x - median| > threshold * MAD. The product form
needs no division and flags every off-median value when MAD is 0. Medians are exact and
distributed (see ``quantiles``); only one row per group is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import is_number
from gridspark.operators.quantiles import exact_quantiles
from gridspark.runtime import attach, is_small, settle

THRESHOLD = 3.5
MAD_TO_SIGMA = 0.6745


def _median(df: DataFrame, col, by, out: str) -> DataFrame:
    found = exact_quantiles(df, col, [0.5], by)
    return settle(found.select(*by, F.col("quantiles")[0].alias(out)))


def _beyond(dev: Column, mad, thresh: float) -> Column:
    """Never null: a value or group without a number is no outlier."""
    return F.coalesce(is_number(dev) & (dev * MAD_TO_SIGMA > F.col(mad) * thresh), F.lit(False))


def outlier_limits(df: DataFrame, col: str, by=()) -> DataFrame:
    """(by…, _med, _mad): median and median absolute deviation, one row per group."""
    by = list(by)
    medians = _median(df, col, by, "_med")
    few = is_small(medians)
    centred = attach(df.select(*by, col), medians, by, few=few)
    spread = _median(centred, F.abs(F.col(col) - F.col("_med")), by, "_mad")
    return attach(medians, spread, by, few=few)


def flag_outliers(df: DataFrame, col: str, by=(), thresh: float = THRESHOLD) -> DataFrame:
    """Add ``is_outlier``, judged over all rows or inside each group."""
    by = list(by)
    judged = attach(df, outlier_limits(df, col, by), by, settled=True)
    flag = _beyond(F.abs(F.col(col) - F.col("_med")), "_mad", thresh)
    return judged.withColumn("is_outlier", flag).drop("_med", "_mad")


def flag_vector_outliers(df: DataFrame, col: str, thresh: float = THRESHOLD) -> DataFrame:
    """Judge vectors by their Euclidean distance from the per-element median.

    Elements without any number have no median and are left out of every distance; a
    vector with another element missing has no distance and is no outlier.
    """
    elements = df.select(F.posexplode(col).alias("idx", "v"))
    medians = _median(elements, "v", ["idx"], "m")
    centre = settle(medians.agg(F.map_from_entries(F.collect_list(F.struct("idx", "m"))).alias("_centre")))
    gaps = F.transform(F.col(col), lambda x, i: F.when(
        F.map_contains_key("_centre", i), (x - F.col("_centre")[i]) * (x - F.col("_centre")[i])).otherwise(0.0))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g))
    measured = attach(df, centre).withColumn("_dev", distance)
    judged = attach(measured, _median(measured, "_dev", [], "_mad"), [], settled=True)
    return judged.withColumn("is_outlier", _beyond(F.col("_dev"), "_mad", thresh)).drop("_centre", "_dev", "_mad")


def remove_outliers(df: DataFrame, col: str, by=(), thresh: float = THRESHOLD) -> DataFrame:
    flagged = flag_outliers(df, col, by, thresh)
    return flagged.where(~F.col("is_outlier")).drop("is_outlier")


def remove_paired_outliers(pairs: DataFrame, thresh: float = THRESHOLD, by=("plevel",)) -> DataFrame:
    """Drop target outliers, then outlying predictions among the rows that are left.

    Each stage is a small table of limits per group, so the data is only filtered.
    """
    return remove_outliers(remove_outliers(pairs, "target", by, thresh), "prediction", by, thresh)
