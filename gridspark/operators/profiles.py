"""Climate profiles: windowed zonal means, height-longitude frames, several years in line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.reshape import difference
from gridspark.runtime import attach

WINDOW_STEPS = 60  # 15 days of 6-hour steps
FRAME_STEPS = 15
STEPS_PER_YEAR = 1440


def _slot(time, steps: int):
    return F.floor(F.col(time) / steps).cast("int")


def zonal_mean(cells: DataFrame, col: str, lat: int, window: int = WINDOW_STEPS,
               drop_last: bool = True, lo: int = 0, hi: int | None = None, by=()) -> DataFrame:
    """Mean over time per level and longitude, then over longitude, per window.

    By default the last step of every window is left out. The month axis counts two
    windows per month.
    """
    rows = cells.where((F.col("lat") == lat) & (F.col("plevel") >= lo))
    if hi is not None:
        rows = rows.where(F.col("plevel") < hi)
    if drop_last:
        rows = rows.where(F.col("time") % window < window - 1)
    per_lon = rows.groupBy(*by, _slot("time", window).alias("window"), "plevel", "lon").agg(
        F.avg(col).alias("_mean"))
    return per_lon.groupBy(*by, "window", "plevel").agg(F.avg("_mean").alias("mean")).withColumn(
        "month", F.col("window") / 2)


def concat_years(years, steps_per_year: int = STEPS_PER_YEAR) -> DataFrame:
    """Years end to end on the time axis, in the order given."""
    moved = [df.withColumn("time", F.col("time") + F.lit(i * steps_per_year))
             for i, df in enumerate(years)]
    return reduce(DataFrame.unionByName, moved)


def years_in_line(df: DataFrame, year: str = "year", steps_per_year: int = STEPS_PER_YEAR) -> DataFrame:
    """One table of several years on one time axis, from its first year on, in one scan of the table.

    The first year is found from the year column alone; a year without rows keeps its span. Rows
    without a year get no time.
    """
    first = df.agg(F.min(year).alias("_first"))
    after = F.col(year) - F.col("_first")
    return attach(df, first).withColumn("time", F.col("time") + after * steps_per_year).drop("_first")


def sources_in_line(cells: DataFrame, source: str = "source") -> DataFrame:
    """Tagged sources end to end on the time axis, in the order of their names."""
    ends = cells.groupBy(source).agg((F.max("time") + 1).alias("_steps"))
    # One row per source; the window runs over those rows only.
    earlier = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(source, F.coalesce(F.sum("_steps").over(earlier), F.lit(0)).alias("_start"))
    moved = (F.col("time") + F.col("_start")).cast("int")
    return attach(cells, starts, [source]).withColumn("time", moved).drop("_start")


def profile_difference(truth: DataFrame, prediction: DataFrame, **zonal_mean_args) -> DataFrame:
    """Zonal means of both fields and their difference on one (window, level) grid."""
    return difference(zonal_mean(truth, **zonal_mean_args),
                      zonal_mean(prediction, **zonal_mean_args), ["window", "plevel"], "mean")


def data_availability(predictions: dict[str, DataFrame], truth: DataFrame, **zonal_mean_args) -> DataFrame:
    """Profiles of several experiments and the truth, tagged and in one pass."""
    tagged = [df.withColumn("experiment", F.lit(name)) for name, df in predictions.items()]
    tagged.append(truth.withColumn("experiment", F.lit("truth")))
    return zonal_mean(reduce(DataFrame.unionByName, tagged), by=["experiment"], **zonal_mean_args)


def tendency_frames(cells: DataFrame, col: str, lat: int, duration: int = FRAME_STEPS,
                    lo: int = 12, hi: int = 28, total: int | None = None) -> DataFrame:
    """Mean of each run of ``duration`` steps per level and longitude at one latitude.

    A last frame with fewer steps is dropped; ``total`` is the number of time steps.
    """
    if total is None:
        steps = cells.agg((F.max("time") + 1).alias("n")).scalar()
    else:
        steps = F.lit(total)
    rows = cells.where((F.col("lat") == lat) & (F.col("plevel") >= lo) & (F.col("plevel") < hi))
    frame = _slot("time", duration)
    whole = rows.where(frame < F.floor(steps / duration))
    return whole.groupBy(frame.alias("frame"), "plevel", "lon").agg(F.avg(col).alias("mean"))
