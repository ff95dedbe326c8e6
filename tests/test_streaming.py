"""Streams: equal to batch, repeatable, and strict about late rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import metrics, scaler
from gridspark.streaming import jobs

XS = np.random.default_rng(6).normal(size=(90, 3))
SCHEMA = "sample_id INT, features ARRAY<DOUBLE>"


def arrive(spark, path, xs, start=0):
    rows = [(start + i, x.tolist()) for i, x in enumerate(xs)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def fit(spark, root, initial=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = jobs.stream_scaler(stream, "features", f"{root}/state", f"{root}/checkpoint", initial)
    query.awaitTermination()
    return {r.idx: (r.n, r.mean, r.m2) for r in jobs.latest_state(spark, f"{root}/state").collect()}


def test_scaler_goes_on_after_a_restart(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/in", XS[:30])
    arrive(spark, f"{root}/in", XS[30:40], 30)
    assert fit(spark, root)[0][0] == 40
    arrive(spark, f"{root}/in", XS[40:], 40)
    got = fit(spark, root)
    for i in range(3):
        assert np.allclose(got[i], (90, XS[:, i].mean(), XS[:, i].var() * 90))


def test_old_states_go_and_unfinished_ones_do_not_count(spark, tmp_path):
    root = str(tmp_path)
    for i in range(6):
        arrive(spark, f"{root}/in", XS[10 * i:10 * i + 10], 10 * i)
    assert fit(spark, root)[0][0] == 60
    kept = sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("batch="))
    assert kept == ["batch=3", "batch=4", "batch=5"]
    (tmp_path / "state" / "batch=6").mkdir()
    assert {r.n for r in jobs.latest_state(spark, f"{root}/state").collect()} == {60}


def test_scaler_starts_from_a_loaded_state(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/first", XS[:30])
    initial = scaler.scaler_fit(spark.read.parquet(f"{root}/first"), "features")
    arrive(spark, f"{root}/in", XS[30:], 30)
    assert np.allclose(fit(spark, root, initial)[2], (90, XS[:, 2].mean(), XS[:, 2].var() * 90))


def test_late_rows_are_left_out_and_open_windows_wait(spark, tmp_path):
    schema = "time INT, plevel INT, lon INT, u DOUBLE"
    path = str(tmp_path / "in")

    def put(times, value):
        spark.createDataFrame([(t, 0, 0, value) for t in times], schema).coalesce(1).write.mode(
            "append").parquet(path)

    put(range(0, 12), 1.0)     # window 0, and two steps of window 1
    put(range(12, 25), 1.0)    # the watermark passes window 1
    put([25], 1.0)             # windows 0 and 1 are final after this batch
    put([3], 1000.0)           # late
    put([26], 1.0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    means = jobs.stream_window_mean(stream, "u", 10, "12 hours")
    writer = means.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
    jobs.start(writer, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.schema(means.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.frame, r["mean"], r.rows) for r in got) == [(0, 1.0, 10), (1, 1.0, 10)]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_metrics_equal_batch_metrics(spark, tmp_path, files):
    pairs = spark.range(600).selectExpr("id as sample_id", "cast(id % 4 as int) as plevel",
                                        "sin(id) as target", "sin(id) * 0.9 + cos(id * 7) * 0.1 as prediction")
    pairs.repartition(files).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.keep_latest(jobs.stream_level_metrics(stream), out, str(tmp_path / "checkpoint")).awaitTermination()
    got, want = (np.array(sorted(map(tuple, d.select("plevel", "n", "mae", "rmse", "r_squared").collect())))
                 for d in (jobs.latest_state(spark, out), metrics.level_metrics(pairs)))
    assert np.allclose(got, want)


def test_window_frames_match_integer_division(spark):
    rows = spark.range(100).select(F.col("id").cast("int").alias("time"), F.lit(0).alias("plevel"),
                                   F.lit(0).alias("lon"), F.col("id").cast("double").alias("u"))
    got = {r.frame: r["mean"] for r in jobs.stream_window_mean(rows, "u", 60).collect()}
    assert got == {0: 29.5, 1: 79.5}
