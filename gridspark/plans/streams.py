"""Queries that run a stream over the given tables to its end."""

from pyspark.sql import functions as F

from gridspark.operators import reshape, scaler
from gridspark.plans import climate  # noqa: F401  its SQL is used here
from gridspark.plans import fixtures as fx
from gridspark.plans.evaluation import PAIRED_SQL, rounded
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.modelling import LINEAR_SCORE, linear_weights
from gridspark.plans.registry import ORACLE, query
from gridspark.plans.storage import export_netcdf
from gridspark.plans.sampling import FITTED, rounded_state
from gridspark.runtime import discard, scratch_path
from gridspark.sources import grid
from gridspark.streaming import jobs, robust

PARTS = 4               # parts of a stream, at least
PART_ROWS = 20_000_000  # a larger part is cut
FILE_ROWS = 100_000     # rows that each file of a part has at least, where it has several
MOST_FILES = 32


def arriving(spark, df, order: str):
    """The table as a stream in several parts, in the order of a numeric column."""
    return arriving_at(spark, df, order)[0]


def arriving_at(spark, df, order: str):
    """The same, and the folder it comes from.

    A batch is one part: all rows of a stretch of ``order``, however large the table is. Files
    come by their time of writing, so parts are written one after the other, in equally many
    files each, and a batch takes that many.
    """
    path = scratch_path(spark, "arriving")
    whole = f"{path}-whole"
    df.write.parquet(whole)
    rows = spark.read.parquet(whole)
    last, count = rows.agg(F.max(order), F.count("*")).first()
    n_parts = max(PARTS, -(-count // PART_ROWS))
    span = (last or 0) // n_parts + 1
    inside = rows.where((F.col(order) >= 0) & (F.col(order) < n_parts * span))
    number = F.floor(F.col(order) / span).alias("_part")
    sizes = dict(inside.groupBy(number).count().collect())
    files = max(1, min([MOST_FILES, *[n // FILE_ROWS for n in sizes.values()]]))
    # Dealt by part once: a part is then read without the others, however many there are.
    inside.select("*", number).write.partitionBy("_part").parquet(f"{path}-parts")
    discard(spark, whole)
    for i in sorted(sizes):
        part = spark.read.schema(df.schema).parquet(f"{path}-parts/_part={i}")
        part.repartition(files).write.mode("append").parquet(path)
    if not sizes:
        spark.createDataFrame([], df.schema).write.parquet(path)
    discard(spark, f"{path}-parts")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path), path


def finish(started):
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


@query(sql(f"SELECT idx, n, round(mean, 8) AS mean, round(m2, 8) AS m2 FROM ({FITTED})"))
def stream_scaler(spark, folder):
    stream = arriving(spark, fx.vectors(spark, folder).select("sample_id", "features"), "sample_id")
    path = scratch_path(spark, "stream-scaler")
    finish(jobs.stream_scaler(stream, "features", f"{path}/state", f"{path}/checkpoint"))
    return rounded_state(jobs.latest_state(spark, f"{path}/state"))


@query(sql(LINEAR_SCORE))
def stream_score(spark, folder):
    rows = fx.vectors(spark, folder).select("sample_id", "features", "gwfu")
    path = scratch_path(spark, "stream-score")
    finish(jobs.stream_score(
        arriving(spark, rows, "sample_id"), linear_weights(spark), scaler.scaler_fit(rows, "features"),
        scaler.scaler_fit(rows, "gwfu"), f"{path}/sink", f"{path}/checkpoint"))
    scored = spark.read.parquet(f"{path}/sink").select(
        "sample_id", F.posexplode(F.arrays_zip("target", "prediction")).alias("plevel", "z"))
    return rounded(scored.select("sample_id", "plevel", "z.target", "z.prediction"), 8, "target", "prediction")


@query(sql("""SELECT CAST(time // 15 AS INT) AS frame, plevel, lon, round(avg(ucomp), 8) AS mean, count(*) AS rows
    FROM cells WHERE lat = 2 AND (time // 15 + 1) * 15 <= (SELECT max(time) - 1 FROM cells) GROUP BY 1, 2, 3"""))
def stream_window_mean(spark, folder):
    """Append mode: windows that ended a step before the newest row are final."""
    stream = arriving(spark, fx.cells(spark, folder).where(F.col("lat") == 2), "time")
    path = scratch_path(spark, "stream-window")
    means = jobs.stream_window_mean(stream, "ucomp", 15)
    writer = means.writeStream.outputMode("append").format("parquet").option("path", f"{path}/sink")
    finish(jobs.start(writer, f"{path}/checkpoint"))
    return rounded(spark.read.schema(means.schema).parquet(f"{path}/sink"), 8, "mean")


@query(sql("""SELECT plevel, count(*) AS n, round(avg(abs(target - prediction)), 4) AS mae,
    round(sqrt(avg(power(target - prediction, 2))), 4) AS rmse,
    round(power(corr(prediction, target), 2), 6) AS r_squared FROM pairs GROUP BY plevel"""))
def stream_level_metrics(spark, folder):
    stream = arriving(spark, fx.pairs(spark, folder), "sample_id")
    path = scratch_path(spark, "stream-metrics")
    finish(jobs.keep_latest(jobs.stream_level_metrics(stream), f"{path}/sink", f"{path}/checkpoint"))
    return rounded(rounded(jobs.latest_state(spark, f"{path}/sink"), 4, "mae", "rmse"), 6, "r_squared")


def marked_end(spark, df, order: str, end: dict):
    """The same stream with one more file at its end: a row without a key that moves the watermark on."""
    stream, path = arriving_at(spark, df, order)
    row = spark.range(1).select(*[F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    row.write.mode("append").parquet(path)
    return stream


@query(sql(PAIRED_SQL + """SELECT plevel, count(*) AS n, round(avg(abs(target - prediction)), 4) AS mae,
    round(sqrt(avg(power(target - prediction, 2))), 4) AS rmse,
    round(power(corr(prediction, target), 2), 6) AS r_squared FROM kept GROUP BY plevel"""))
def stream_robust_metrics(spark, folder):
    """Sketches kept on the stream; the exact metrics of what arrived, from their brackets."""
    pairs = fx.pairs(spark, folder)
    path = scratch_path(spark, "stream-robust")
    running = robust.stream_robust_metrics(arriving(spark, pairs, "sample_id"), thresh=1.5, capacity=512)
    finish(jobs.keep_robust(running, f"{path}/state", f"{path}/checkpoint"))
    found = robust.exact_metrics(pairs, jobs.latest_state(spark, f"{path}/state"), thresh=1.5)
    return rounded(rounded(found, 4, "mae", "rmse"), 6, "r_squared")


@query(sql("""SELECT f.time AS time, f.plevel AS plevel, f.lat AS lat, f.lon AS lon, round(f.ucomp, 8) AS prediction,
    round(CASE WHEN (f.time + 7 * f.plevel + 3 * f.lat + f.lon) % 12 <= 8 THEN c.ucomp END, 8) AS target
    FROM forecast f JOIN cells c ON c.time = f.time AND c.plevel = f.plevel AND c.lat = f.lat AND c.lon = f.lon"""))
def stream_late_truth(spark, folder):
    """Forecasts meet what was observed up to eight steps later; the rest has no truth."""
    cell = ["time", "plevel", "lat", "lon"]
    lag = (F.col("time") + 7 * F.col("plevel") + 3 * F.col("lat") + F.col("lon")) % 12

    def at(step):  # a watermark starts at the epoch, and what is not after it is late
        return F.timestamp_seconds((step.cast("bigint") + 1) * (jobs.STEP_HOURS * 3600))

    scores = fx.forecast(spark, folder).select(*cell, F.col("ucomp").alias("prediction"), at(F.col("time")).alias("scored_at"))
    truth = fx.cells(spark, folder).select(*cell, F.col("ucomp").alias("target"), at(F.col("time") + lag).alias("seen_at"),
                                           (F.col("time") + lag).alias("arrival"))
    late = {"scored_at": "2200-01-01", "seen_at": "2200-01-01"}
    both = jobs.scores_with_truth(
        marked_end(spark, scores, "time", late), marked_end(spark, truth, "arrival", late).drop("arrival"),
        f"{8 * jobs.STEP_HOURS} hours", "0 hours", "0 hours", key=cell)
    path = scratch_path(spark, "late-truth")
    writer = both.writeStream.outputMode("append").format("parquet").option("path", f"{path}/sink")
    finish(jobs.start(writer, f"{path}/checkpoint"))
    found = spark.read.schema(both.schema).parquet(f"{path}/sink").where(F.col("time").isNotNull())
    return rounded(found.select(*cell, "prediction", "target"), 8, "prediction", "target")


@query(ORACLE["lag_stack"])
def stream_lag_stack(spark, folder):
    """Lags of columns as they arrive, from a ring of past steps per grid point."""
    columns = reshape.to_columns(fx.cells(spark, folder), ["ucomp"])
    path = scratch_path(spark, "stream-lags")
    stacked = jobs.stream_lag_stack(arriving(spark, columns, "time"), "ucomp", step_size=3, start_time=2, num_steps=4)
    writer = stacked.writeStream.outputMode("append").format("parquet").option("path", f"{path}/sink")
    with jobs.keyed_state(spark):
        finish(jobs.start(writer, f"{path}/checkpoint"))
    by_step = spark.read.schema(stacked.schema).parquet(f"{path}/sink").select(
        "time", "lat", "lon", F.posexplode("lags").alias("k", "past"))
    return by_step.select("time", "lat", "lon", "k", F.posexplode("past").alias("pos", "ucomp"))


@query(sql("""SELECT plevel AS idx, count(ucomp) AS n, round(avg(ucomp), 8) AS mean, round(var_pop(ucomp) * count(ucomp), 6) AS m2
    FROM cells GROUP BY plevel"""))
def stream_grid_scaler(spark, folder):
    """The scaler of model output that arrives as files: the first runs, then all the others."""
    path = scratch_path(spark, "grid-stream")
    cells, step = fx.cells(spark, folder), F.col("time")
    for part in (step < 20, step >= 20):
        export_netcdf(cells.where(part), f"{path}/files", ["ucomp"], 10)
        stream = grid.stream_columns(spark, f"{path}/files/*.nc", ["ucomp"], steps=4, in_line=True)
        finish(jobs.stream_scaler(stream, "ucomp", f"{path}/state", f"{path}/checkpoint"))
    return rounded(rounded(jobs.latest_state(spark, f"{path}/state"), 8, "mean"), 6, "m2")
