"""Scaler state, scores, window means and level metrics kept current on a stream.

Batches are written under their own number, so a batch repeated after a failure replaces
itself. A batch counts once its success mark is there; readers take the newest such batch, and
all but the last few are removed (``sources.versions``). All paths must lie in storage the whole cluster shares.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from gridspark.operators.metrics import level_metrics
from gridspark.operators.scaler import scaler_fit, scaler_merge
from gridspark.operators.scoring import batch_score, share
from gridspark.runtime import settle
from gridspark.sources.versions import latest_state, publish

STEP_HOURS = 6


def start(writer, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run on what is there now and end, or go on at an interval such as "1 minute"."""
    writer = writer.option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


@contextmanager
def keyed_state(spark: SparkSession, parts: int | None = None):
    """Queries started inside keep the state of their keys in RocksDB, as custom state needs it.

    The state is cut in ``parts``, as many as tasks run at once and no more than a shuffle has. A
    part without any key costs each batch a store and a call of Python too. A query that starts
    again from its checkpoint keeps the parts it has.
    """
    shuffle = "spark.sql.shuffle.partitions"
    parts = min(parts or spark.sparkContext.defaultParallelism, int(spark.conf.get(shuffle)))
    inside = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        shuffle: str(parts),
    }
    before = {name: spark.conf.get(name) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stream_scaler(stream: DataFrame, col: str, state_path: str, checkpoint: str,
                  initial: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Merge each batch into the scaler state; state n is state n-1 plus batch n."""
    def merge(batch: DataFrame, number: int):
        spark = batch.sparkSession
        before = spark.read.parquet(f"{state_path}/batch={number - 1}") if number else initial
        state = scaler_fit(batch, col)
        if before is not None:
            state = scaler_merge(before, state)
        publish(state, state_path, number)

    return start(stream.writeStream.foreachBatch(merge), checkpoint, every)


def stream_score(stream: DataFrame, weights: DataFrame, x_state: DataFrame, y_state: DataFrame,
                 sink: str, checkpoint: str, target: str = "gwfu", every: str | None = None) -> StreamingQuery:
    """Score columns as they arrive; each batch is one folder of the sink.

    The scaler states are computed and the model is sent once, before the stream starts.
    """
    weights, x_state, y_state = share(weights), settle(x_state), settle(y_state)

    def score(batch: DataFrame, number: int):
        scored = batch_score(batch, weights, x_state, y_state, target)
        scored.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return start(stream.writeStream.foreachBatch(score), checkpoint, every)


def stream_window_mean(stream: DataFrame, col: str, window: int, delay: str = "6 hours",
                       keys=("plevel", "lon"), time="time") -> DataFrame:
    """Tumbling means of ``window`` 6-hour steps; rows later than ``delay`` are left out.

    Time starts at the epoch, so windows match time div ``window``. ``rows`` counts what a
    mean holds, to tell whole windows from incomplete ones.
    """
    at = F.timestamp_seconds(F.col(time).cast("bigint") * (STEP_HOURS * 3600))
    span = F.window("ts", f"{window * STEP_HOURS} hours")
    means = stream.withColumn("ts", at).withWatermark("ts", delay).groupBy(span, *keys).agg(
        F.avg(col).alias("mean"), F.count(col).alias("rows"))
    start = F.unix_timestamp("window.start")
    number = F.call_function("div", start, F.lit(window * STEP_HOURS * 3600)).cast("int")
    return means.select(number.alias("frame"), *keys, "mean", "rows")


def stream_level_metrics(stream: DataFrame) -> DataFrame:
    """Running error metrics by level; state is a few moments per level."""
    return level_metrics(stream)


def keep_latest(result: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Publish the whole (small) aggregate after each batch; read it by ``latest_state``."""
    def replace(batch: DataFrame, number: int):
        publish(batch, path, number)

    return start(result.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, every)


def keep_robust(result: DataFrame, path: str, checkpoint: str, by=("plevel",), every: str | None = None) -> StreamingQuery:
    """Publish the newest row of every key after each batch; read it by ``latest_state``."""
    def replace(batch: DataFrame, number: int):
        spark = batch.sparkSession
        batch = settle(batch)
        before = latest_state(spark, path, number)
        if before is not None:
            batch = batch.unionByName(before.join(batch.select(*by), list(by), "left_anti"))
        publish(batch, path, number)

    with keyed_state(result.sparkSession):
        return start(result.writeStream.outputMode("update").foreachBatch(replace), checkpoint, every)


def scores_with_truth(scores: DataFrame, truth: DataFrame, within: str, score_delay: str, truth_delay: str,
                      key=("sample_id",), scored_at: str = "scored_at", seen_at: str = "seen_at") -> DataFrame:
    """Each score with the first truth of its key seen from its own time to ``within`` after.

    Both streams have their own watermark, so the state holds no more than ``within`` and the
    delays. Truth that comes again within its delay is left out. A score whose truth is
    missing or too late leaves once that is certain, with a null target; a null key has no truth.
    """
    left = scores.withWatermark(scored_at, score_delay).alias("s")
    right = truth.withWatermark(seen_at, truth_delay).dropDuplicatesWithinWatermark(list(key)).alias("t")
    match = (F.col(f"t.{seen_at}") >= F.col(f"s.{scored_at}")) & (
        F.col(f"t.{seen_at}") <= F.col(f"s.{scored_at}") + F.expr(f"INTERVAL {within}"))
    for k in key:
        match = match & (F.col(f"s.{k}") == F.col(f"t.{k}"))
    own = [c for c in truth.columns if c not in key]
    return left.join(right, match, "left_outer").select("s.*", *[f"t.{c}" for c in own])


class Past(StatefulProcessor):
    """The newest steps of one grid point, as far back as its lags reach."""

    def __init__(self, key, col, step_size, start_time, num_steps, ttl_ms):
        self.key, self.col, self.ttl_ms = key, col, ttl_ms
        self.offsets = start_time + step_size * np.arange(num_steps)

    def init(self, handle):
        self.state = handle.getValueState("past", "times BINARY, numbers BINARY", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("time", kind="stable").drop_duplicates("time")
        times = np.zeros(0, np.int64)
        if self.state.exists():
            times, numbers = (np.frombuffer(b, t) for b, t in zip(self.state.get(), (np.int64, np.float64)))
        vector = len(new) and isinstance(new[self.col].iloc[0], (list, np.ndarray))
        if len(times):
            new = new[new["time"] > times[-1]]
        if not len(new):
            return
        values = np.stack(new[self.col]) if vector else new[self.col].to_numpy(float)[:, None]
        if len(times):
            values = np.concatenate([numbers.reshape(len(times), -1), values])
        fresh = new["time"].to_numpy(np.int64)
        times = np.concatenate([times, fresh])
        wanted = fresh[:, None] - self.offsets
        at = np.minimum(np.searchsorted(times, wanted), len(times) - 1)
        whole = (times[at] == wanted).all(axis=1)
        lags = values[at[whole]]
        keep = times > times[-1] - self.offsets[-1]
        self.state.update((times[keep].tobytes(), np.ascontiguousarray(values[keep], np.float64).tobytes()))
        if not whole.any():
            return
        out = new[whole].copy()
        out["lags"] = [v.tolist() if vector else v[:, 0].tolist() for v in lags]
        yield out[["time", *self.key, self.col, "lags"]]

    def close(self):
        pass


def stream_lag_stack(stream: DataFrame, col: str, step_size: int = 1, start_time: int = 1, num_steps: int = 64,
                     key=("lat", "lon"), ttl_ms: int | None = None) -> DataFrame:
    """(time, key…, col, lags) as ``lags.lag_stack`` gives them, of columns as they arrive.

    State is a ring of the steps the lags can reach, per grid point. The steps of a point come
    in order, several in a batch in any order; one that is not newer than the newest seen is
    left out, and so is a step without its full history. A point quiet for ``ttl_ms``
    (processing time) is forgotten.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("time", *key, col)] + [f"lags array<{kinds[col]}>"])
    return stream.select("time", *key, col).groupBy(*key).transformWithStateInPandas(
        Past(list(key), col, step_size, start_time, num_steps, ttl_ms), schema, "Append",
        "ProcessingTime" if ttl_ms else "None")
