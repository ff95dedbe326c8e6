"""Queries for zonal means, frames, several years and lag stacks."""

from pyspark.sql import functions as F

from gridspark.operators import lags, reshape
from gridspark.operators import profiles as pf
from gridspark.operators import stats
from gridspark.plans import fixtures as fx
from gridspark.plans.evaluation import rounded
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.registry import query

ZONAL = """SELECT win, plevel, avg(m) AS mean FROM (
    SELECT time // 10 AS win, plevel, lon, avg(ucomp) AS m FROM {t} WHERE lat = 2 AND time % 10 < 9
    GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(sql(f"""SELECT CAST(win AS INT) AS "window", plevel, round(mean, 8) AS mean, win / 2.0::DOUBLE AS month
    FROM ({ZONAL.format(t='cells')})"""))
def zonal_mean(spark, folder):
    return rounded(pf.zonal_mean(fx.cells(spark, folder), "ucomp", 2, window=10), 8, "mean")


@query(sql("""SELECT (year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM lineitem)) * 366 + dayofyear(l_shipdate) - 1 AS time, l_linenumber - 1 AS plevel,
    count(*) AS n, round(sum(l_extendedprice), 4) AS gwfu FROM lineitem GROUP BY 1, 2"""))
def concat_years(spark, folder):
    """Yearly tables, each with its own day axis, put end to end."""
    days = fx.table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("year"), (F.dayofyear("l_shipdate") - 1).alias("time"),
        (F.col("l_linenumber") - 1).alias("plevel"), F.col("l_extendedprice").alias("gwfu"))
    line = pf.years_in_line(days, "year", 366)
    daily = line.groupBy(F.col("time").cast("bigint").alias("time"), "plevel").agg(
        F.count("*").alias("n"), F.sum("gwfu").alias("gwfu"))
    return rounded(daily, 4, "gwfu")


@query(sql(f"""SELECT CAST(win AS INT) AS "window", plevel, round(t.mean, 8) AS target, round(p.mean, 8) AS prediction,
    round(t.mean - p.mean, 8) AS difference
    FROM ({ZONAL.format(t='cells')}) t JOIN ({ZONAL.format(t='forecast')}) p USING (win, plevel)"""))
def qbo_difference(spark, folder):
    both = pf.profile_difference(fx.cells(spark, folder), fx.forecast(spark, folder),
                                 col="ucomp", lat=2, window=10)
    return rounded(both, 8, "target", "prediction", "difference")


@query(sql(f"""SELECT 'full' AS experiment, CAST(win AS INT) AS "window", plevel, round(mean, 8) AS mean
      FROM ({ZONAL.format(t='forecast')})
    UNION ALL SELECT 'half', CAST(win AS INT), plevel, round(mean, 8)
      FROM ({ZONAL.format(t='(SELECT time, plevel, lat, lon, ucomp * 0.5::DOUBLE AS ucomp FROM cells)')})
    UNION ALL SELECT 'truth', CAST(win AS INT), plevel, round(mean, 8) FROM ({ZONAL.format(t='cells')})"""))
def data_availability(spark, folder):
    truth = fx.cells(spark, folder).drop("temp")
    predictions = {"half": truth.withColumn("ucomp", F.col("ucomp") * 0.5),
                   "full": fx.forecast(spark, folder).drop("temp")}
    out = pf.data_availability(predictions, truth, col="ucomp", lat=2, window=10)
    return rounded(out.drop("month"), 8, "mean")


FRAMES = """SELECT CAST(time // 15 AS INT) AS frame, plevel, lon, avg(ucomp) AS mean FROM cells
    WHERE lat = 2 AND plevel >= 2 AND plevel < 6 AND time // 15 < (SELECT (max(time) + 1) // 15 FROM cells)
    GROUP BY 1, 2, 3"""


@query(sql(f"SELECT frame, plevel, lon, round(mean, 8) AS mean FROM ({FRAMES})"))
def tendency_frames(spark, folder):
    return rounded(pf.tendency_frames(fx.cells(spark, folder), "ucomp", 2, lo=2, hi=6), 8, "mean")


@query(sql(f"""SELECT frame, round(-max(abs(mean)), 8) AS vmin, round(max(abs(mean)), 8) AS vmax FROM ({FRAMES})
    GROUP BY frame"""))
def frame_limits(spark, folder):
    frames = pf.tendency_frames(fx.cells(spark, folder), "ucomp", 2, lo=2, hi=6)
    return rounded(stats.value_limits(frames, ["mean"], True, by=["frame"]), 8, "vmin", "vmax")


@query(sql("""SELECT c.time AS time, c.lat AS lat, c.lon AS lon, CAST(k AS INT) AS k, p.plevel AS pos, p.ucomp AS ucomp
    FROM (SELECT DISTINCT time, lat, lon FROM cells) c, (SELECT range AS k FROM range(4)) s
    JOIN cells p ON p.time = c.time - 2 - k * 3 AND p.lat = c.lat AND p.lon = c.lon
    WHERE c.time >= 11"""))
def lag_stack(spark, folder):
    columns = reshape.to_columns(fx.cells(spark, folder), ["ucomp"])
    stacked = lags.lag_stack(columns, "ucomp", step_size=3, start_time=2, num_steps=4)
    by_step = stacked.select("time", "lat", "lon", F.posexplode("lags").alias("k", "past"))
    return by_step.select("time", "lat", "lon", "k", F.posexplode("past").alias("pos", "ucomp"))
