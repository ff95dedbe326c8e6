"""Streams with keyed state: robust metrics, late truth, lags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import metrics, outliers
from gridspark.streaming import jobs, robust

RNG = np.random.default_rng(11)


def pairs_of(n, levels=2, seed=3):
    rng = np.random.default_rng(seed)
    t = np.where(rng.random(n) < 0.05, rng.normal(0, 40, n), rng.normal(0, 1, n))
    p = t + np.where(rng.random(n) < 0.05, rng.normal(0, 40, n), rng.normal(0, 0.5, n))
    return [(int(i % levels), float(a), float(b)) for i, (a, b) in enumerate(zip(t, p))]


SCHEMA = "plevel INT, target DOUBLE, prediction DOUBLE"


@pytest.mark.parametrize("n, capacity", [(5, 8), (1000, 512), (20_000, 64), (20_001, 512)])
def test_sketch_ranks_are_within_the_stated_error(n, capacity):
    values = RNG.normal(size=(n, 2))
    whole = robust.PairSketch(capacity)
    for part in np.array_split(values, 7):
        one = robust.PairSketch(capacity)
        one.add(part)
        whole.merge(robust.PairSketch.load(one.dump()))
    pairs, weights = whole.weighted()
    assert whole.n == n == weights.sum() and len(pairs) <= 2 * capacity * len(whole.buffers)
    order = np.sort(values[:, 0])
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        found = robust.at_ranks(pairs[:, 0], weights, [q * (n - 1)])[0]
        assert abs(np.searchsorted(order, found) - int(q * (n - 1))) <= whole.error
    assert whole.error == 0 if n < 2 * capacity else whole.error < n * 0.2 * (64 / capacity) ** 0.5


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, root, schema=SCHEMA, **how):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.keep_robust(robust.stream_robust_metrics(stream, **how), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return jobs.latest_state(spark, f"{root}/out")


def test_robust_metrics_go_on_after_a_restart_and_are_exact_while_small(spark, tmp_path):
    root, rows = str(tmp_path), pairs_of(3000)
    put(spark, f"{root}/in", rows[:1500])
    run(spark, root)
    put(spark, f"{root}/in", rows[1500:] + [(0, None, 1.0), (1, float("nan"), 2.0)])
    state = run(spark, root)
    batch = spark.createDataFrame(rows, SCHEMA)
    want = metrics.level_metrics(outliers.remove_paired_outliers(batch)).orderBy("plevel").collect()
    for got, right in zip(state.orderBy("plevel").collect(), want, strict=True):
        assert got.n == 1500 and got.kept == right.n and got.rank_error == 0
        assert np.allclose([got.mae, got.rmse, got.r_squared], [right.mae, right.rmse, right.r_squared])


def test_bounded_state_is_near_and_its_brackets_give_the_exact_result(spark, tmp_path):
    root, rows = str(tmp_path), pairs_of(24_000)
    for part in range(3):
        put(spark, f"{root}/in", rows[part * 8000:(part + 1) * 8000])
    state = run(spark, root, capacity=256)
    batch = spark.createDataFrame(rows, SCHEMA)
    limits = outliers.outlier_limits(batch, "target", ["plevel"]).orderBy("plevel").collect()
    for got, right in zip(state.orderBy("plevel").collect(), limits, strict=True):
        mine = np.sort([t for k, t, _ in rows if k == got.plevel])
        off = abs(np.searchsorted(mine, got.target_median) - np.searchsorted(mine, right._med))
        assert 0 < got.rank_error < 0.05 and off <= got.rank_error * got.n + 1 and len(got.sketch) < 120_000
    exact = robust.exact_metrics(batch, state).orderBy("plevel").collect()
    want = metrics.level_metrics(outliers.remove_paired_outliers(batch)).orderBy("plevel").collect()
    assert [r.n for r in exact] == [r.n for r in want]
    assert np.allclose([[r.mae, r.rmse, r.r_squared] for r in exact], [[r.mae, r.rmse, r.r_squared] for r in want])


def test_frames_answer_once_and_late_rows_are_left_out(spark, tmp_path):
    schema = f"time INT, {SCHEMA}"
    root = str(tmp_path)
    put(spark, f"{root}/in", [(t, 0, float(t), float(t)) for t in range(12)], schema)
    put(spark, f"{root}/in", [(t, 0, float(t), float(t)) for t in range(12, 25)], schema)
    put(spark, f"{root}/in", [(3, 0, 1e6, 0.0), (26, 0, 1.0, 1.0)], schema)   # late for frame 0
    put(spark, f"{root}/in", [(40, 0, 1.0, 1.0)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    frames = robust.stream_robust_metrics(stream, frame_steps=10)
    seen = []
    query = frames.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect()))
    with jobs.keyed_state(spark):
        jobs.start(query, f"{root}/checkpoint").awaitTermination()
    assert sorted((r.frame, r.n, r.target_median) for r in seen) == [(0, 10, 4.5), (1, 10, 14.5), (2, 6, 21.5)]


def test_quiet_levels_are_forgotten(spark, tmp_path):
    import time
    root, rows = str(tmp_path), pairs_of(40)
    put(spark, f"{root}/in", rows)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    seen = []
    writer = robust.stream_robust_metrics(stream, ttl_ms=2000).writeStream.outputMode("update")
    with jobs.keyed_state(spark):
        query = jobs.start(writer.foreachBatch(lambda b, _: seen.extend(b.collect())), f"{root}/checkpoint", "1 second")
        try:
            deadline = time.time() + 60
            while len(seen) < 2 and time.time() < deadline:
                time.sleep(0.5)
            time.sleep(4)
            put(spark, f"{root}/in", rows)
            while len(seen) < 4 and time.time() < deadline:
                time.sleep(0.5)
        finally:
            query.stop()
    assert [r.n for r in seen[:4]] == [20] * 4  # and not 40: what was there had gone
    with pytest.raises(ValueError, match="choose one"):
        robust.stream_robust_metrics(stream, ttl_ms=1, frame_steps=2)


SCORES = "sample_id INT, scored_at TIMESTAMP, prediction DOUBLE"
TRUTH = "sample_id INT, seen_at TIMESTAMP, target DOUBLE"


def hour(h):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)


def test_scores_meet_late_missing_and_repeated_truth(spark, tmp_path):
    root = str(tmp_path)

    def scores(*rows):
        put(spark, f"{root}/scores", [(i, hour(h), float(i or 0)) for i, h in rows], SCORES)

    def truth(*rows):
        put(spark, f"{root}/truth", [(i, hour(h), v) for i, h, v in rows], TRUTH)

    scores((1, 0), (2, 0), (3, 1), (4, 2))
    truth((1, 1, 10.0), (1, 1, 10.0))                   # in time, and repeated at once
    scores((5, 9), (None, 9))
    truth((1, 2, 11.0), (2, 9, 20.0), (3, 6, 30.0))     # again for 1, too late for 2, in time for 3
    scores((6, 40))
    truth((9, 40, 90.0))                                # of no score
    scores((7, 80))
    truth((7, 80, 70.0))
    read = {n: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{root}/{n}") for n, s in (("scores", SCORES), ("truth", TRUTH))}
    both = jobs.scores_with_truth(read["scores"], read["truth"], "6 hours", "1 hour", "1 hour", key=("sample_id",))
    writer = both.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
    jobs.start(writer, f"{root}/checkpoint").awaitTermination()
    got = spark.read.schema(both.schema).parquet(f"{root}/out").collect()
    assert sorted((r.sample_id or 0, r.target) for r in got if r.target is not None) == [(1, 10.0), (3, 30.0), (7, 70.0)]
    assert sorted(r.sample_id or 0 for r in got if r.target is None) == [0, 2, 4, 5, 6]


@pytest.mark.parametrize("vector", [False, True])
def test_stream_lags_equal_batch_lags(spark, tmp_path, vector):
    from gridspark.operators.lags import lag_stack
    root = str(tmp_path)
    cells = spark.range(2 * 40).select(
        (F.col("id") % 40).cast("int").alias("time"), F.floor(F.col("id") / 40).cast("int").alias("lat"),
        F.lit(0).alias("lon"), (F.sin("id") if not vector else F.array(F.sin("id"), F.cos("id"))).alias("u")).where("time <> 17")
    for lo in range(0, 40, 9):
        cells.where((F.col("time") >= lo) & (F.col("time") < lo + 9)).coalesce(2).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(cells.schema).parquet(f"{root}/in")
        out = jobs.stream_lag_stack(stream, "u", step_size=2, start_time=1, num_steps=3)
        writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
        with jobs.keyed_state(spark):
            jobs.start(writer, f"{root}/checkpoint").awaitTermination()
    got = sorted((r.time, r.lat, str(r.lags)) for r in spark.read.schema(out.schema).parquet(f"{root}/out").collect())
    want = sorted((r.time, r.lat, str(r.lags)) for r in lag_stack(cells, "u", 2, 1, 3).collect())
    assert got == want and len(got) > 20


def test_a_batch_holds_all_rows_of_its_stretch(spark, tmp_path, monkeypatch):
    from gridspark.plans import streams
    monkeypatch.setattr(streams, "FILE_ROWS", 100, raising=False)
    # Enough partitions that a part is several files; what a file lacks comes in the same batch.
    table = spark.range(4000).selectExpr("cast(id % 1000 AS INT) AS time", "id DIV 1000 AS k").repartition(6, "time", "k")
    seen = {}

    def take(batch, number):
        seen[number] = (batch.count(), *batch.selectExpr("min(time)", "max(time)").first())

    out = streams.arriving(spark, table, "time").writeStream.foreachBatch(take)
    streams.finish(jobs.start(out, str(tmp_path / "checkpoint")))
    assert [seen[k] for k in sorted(seen)] == [(1000, 250 * k, 250 * k + 249) for k in range(4)]


def test_many_parts_are_read_one_by_one(spark, tmp_path, monkeypatch):
    from gridspark.plans import streams
    monkeypatch.setattr(streams, "PART_ROWS", 100)
    table = spark.range(1000).selectExpr("CASE WHEN id < 990 THEN id * 2 END AS at", "id").repartition(5)
    seen, read = {}, []
    whole = spark.read.__class__.parquet
    monkeypatch.setattr(spark.read.__class__, "parquet", lambda self, *paths, **how: read.extend(paths) or whole(self, *paths, **how))

    def take(batch, number):
        seen[number] = (batch.count(), *batch.selectExpr("min(at)", "max(at)").first())

    out = streams.arriving(spark, table, "at").writeStream.foreachBatch(take)
    streams.finish(jobs.start(out, str(tmp_path / "checkpoint")))
    # Rows without a place are left out; 990 have one, 1,000 were counted.
    assert sum(n for n, *_ in seen.values()) == 990 and len(seen) == 10
    assert all(198 * k <= low <= high < 198 * (k + 1) for k, (_, low, high) in seen.items())
    assert len([p for p in read if "_part=" in p]) == 10


def test_state_is_cut_in_no_more_parts_than_tasks_run_at_once(spark, tmp_path):
    root, name = str(tmp_path), "spark.sql.shuffle.partitions"
    put(spark, f"{root}/in", pairs_of(40))
    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        query = jobs.keep_robust(robust.stream_robust_metrics(stream), f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    parts = {o.numShufflePartitions for p in query.recentProgress for o in p.stateOperators}
    assert parts == {min(40, spark.sparkContext.defaultParallelism)}
    assert sorted(r.n for r in jobs.latest_state(spark, f"{root}/out").collect()) == [20, 20]


def test_a_stream_of_an_empty_table_ends(spark, tmp_path):
    from gridspark.plans import streams
    seen = []
    out = streams.arriving(spark, spark.range(0), "id").writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
    streams.finish(jobs.start(out, str(tmp_path / "checkpoint")))
    assert sum(seen) == 0
