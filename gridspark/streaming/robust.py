"""Level metrics without outliers, kept current on a stream by a mergeable sketch per level.

The sketch holds (target, prediction) pairs with weights that are powers of two. A full buffer
is sorted by target and every other pair moves up with twice the weight, so a sketch stays
small and two of them merge. Tasks sketch what they read before the shuffle; a level that has
most of the rows is one small row per task. How many ranks a target can be off is counted
exactly. From the state the limits are known up to that error; :func:`exact_metrics` uses it
as brackets and finds the exact ones by counting alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridspark.functions import is_number
from gridspark.operators.metrics import level_metrics
from gridspark.operators.outliers import MAD_TO_SIGMA, THRESHOLD
from gridspark.operators.quantiles import exact_quantiles
from gridspark.runtime import attach, settle
from gridspark.streaming.jobs import STEP_HOURS

CAPACITY = 4096
STEP_MS = STEP_HOURS * 3_600_000


class PairSketch:
    """Weighted pairs of one group; a target's rank is off by ``error`` rows at most."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.n, self.error = capacity, 0, 0
        self.buffers, self.turns = [np.zeros((0, 2))], [0]
        self.low, self.high = np.full(2, np.inf), np.full(2, -np.inf)

    def add(self, pairs: np.ndarray) -> None:
        if len(pairs):
            self.n += len(pairs)
            self.low, self.high = np.minimum(self.low, pairs.min(0)), np.maximum(self.high, pairs.max(0))
            for first in range(0, len(pairs), self.capacity):
                self._put(0, pairs[first:first + self.capacity])

    def merge(self, other: "PairSketch") -> None:
        self.n, self.error = self.n + other.n, self.error + other.error
        self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        for height, pairs in enumerate(other.buffers):
            self._put(height, pairs)

    def _put(self, height: int, pairs: np.ndarray) -> None:
        while len(self.buffers) <= height:
            self.buffers.append(np.zeros((0, 2)))
            self.turns.append(0)
        held = np.concatenate([self.buffers[height], pairs])
        if len(held) < 2 * self.capacity:
            self.buffers[height] = held
            return
        # An odd pair out stays, so that weights always add up to n.
        even = len(held) // 2 * 2
        held, self.buffers[height] = held[:even], held[even:]
        held = held[np.lexsort((held[:, 1], held[:, 0]))]
        self.turns[height] ^= 1
        self.error += 1 << height
        self._put(height + 1, held[self.turns[height]::2])

    def weighted(self):
        return np.concatenate(self.buffers), np.concatenate(
            [np.full(len(b), 1 << h, np.int64) for h, b in enumerate(self.buffers)])

    def dump(self) -> bytes:
        head = [self.capacity, self.n, self.error, len(self.buffers), *map(len, self.buffers), *self.turns]
        return np.array(head, np.int64).tobytes() + np.concatenate([self.low, self.high, *[b.ravel() for b in self.buffers]]).tobytes()

    @classmethod
    def load(cls, blob: bytes) -> "PairSketch":
        capacity, n, error, heights = (int(x) for x in np.frombuffer(blob, np.int64, 4))
        sizes = np.frombuffer(blob, np.int64, 2 * heights, 32)
        numbers = np.frombuffer(blob, np.float64, -1, 32 + 16 * heights)
        out = cls(capacity)
        out.n, out.error, out.turns = n, error, [int(t) for t in sizes[heights:]]
        out.low, out.high = numbers[:2].copy(), numbers[2:4].copy()
        cuts = np.cumsum(2 * sizes[:heights])[:-1]
        out.buffers = [b.reshape(-1, 2) for b in np.split(numbers[4:], cuts)]
        return out


def at_ranks(values: np.ndarray, weights: np.ndarray, ranks) -> np.ndarray:
    """The values at the given ranks (from 0) of the weighted values in order."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    places = np.searchsorted(upto, np.clip(np.floor(ranks), 0, upto[-1] - 1), "right")
    return values[order][places]


def _median(values, weights):
    spot = (weights.sum() - 1) / 2
    return float(at_ranks(values, weights, [np.floor(spot), np.ceil(spot)]).mean())


def _survivors(values, weights, thresh):
    """(median, MAD, which values are no outliers)"""
    middle = _median(values, weights)
    spread = _median(np.abs(values - middle), weights)
    return middle, spread, ~(np.abs(values - middle) * MAD_TO_SIGMA > spread * thresh)


ROW = ("n BIGINT, kept BIGINT, target_median DOUBLE, target_mad DOUBLE, prediction_median DOUBLE, prediction_mad DOUBLE, "
       "mae DOUBLE, rmse DOUBLE, r_squared DOUBLE, rank_error DOUBLE, sketch BINARY")


def robust_row(sketch: PairSketch, thresh: float) -> tuple:
    """The fields of ``ROW``: limits of both stages, and the metrics of what both leave."""
    pairs, weights = sketch.weighted()
    t_mid, t_mad, stay = _survivors(pairs[:, 0], weights, thresh)
    pairs, weights = pairs[stay], weights[stay]
    p_mid, p_mad, stay = _survivors(pairs[:, 1], weights, thresh)
    pairs, weights = pairs[stay], weights[stay]
    kept = weights.sum()
    gaps = pairs[:, 0] - pairs[:, 1]
    t, p = (pairs - np.average(pairs, axis=0, weights=weights)).T
    cov, var = np.average(t * p, weights=weights), np.average(t * t, weights=weights) * np.average(p * p, weights=weights)
    return (sketch.n, int(kept), t_mid, t_mad, p_mid, p_mad, float(np.average(np.abs(gaps), weights=weights)),
            float(np.sqrt(np.average(gaps * gaps, weights=weights))), float(cov * cov / var) if var > 0 else 0.0,
            sketch.error / sketch.n, sketch.dump())


def _sketched(keys, capacity, frame_steps):
    def run(batches: Iterator[pd.DataFrame]):
        held, latest = {}, {}
        for pdf in batches:
            pdf = pdf[np.isfinite(pdf["target"]) & np.isfinite(pdf["prediction"])]
            for key, rows in pdf.groupby(keys, sort=False):
                held.setdefault(key, PairSketch(capacity)).add(rows[["target", "prediction"]].to_numpy(float))
                if frame_steps:
                    latest[key] = max(latest.get(key, rows["ts"].max()), rows["ts"].max())
        if held:
            out = pd.DataFrame(list(held), columns=keys)
            if frame_steps:
                out["ts"] = [latest[k] for k in held]
            out["sketch"] = [s.dump() for s in held.values()]
            yield out
    return run


class LevelSketches(StatefulProcessor):
    """One sketch per key. Without frames a key answers whenever rows arrive; with them it
    answers once, when the watermark passes the frame's end, and its state goes."""

    def __init__(self, keys, capacity, thresh, ttl_ms, frame_steps):
        self.keys, self.capacity, self.thresh = keys, capacity, thresh
        self.ttl_ms, self.frame_steps = ttl_ms, frame_steps

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("sketch", "blob BINARY", ttlDurationMs=self.ttl_ms)

    def _row(self, key, sketch):
        names = [*self.keys, *[f.split()[0] for f in ROW.split(", ")]]
        return pd.DataFrame([[*key, *robust_row(sketch, self.thresh)]], columns=names)

    def handleInputRows(self, key, rows, timerValues):
        if self.frame_steps:
            end = (int(key[-1]) + 1) * self.frame_steps * STEP_MS
            if timerValues.getCurrentWatermarkInMs() >= end:
                return  # the frame has answered; these rows are late
        sketch = PairSketch.load(self.state.get()[0]) if self.state.exists() else PairSketch(self.capacity)
        for pdf in rows:
            for blob in pdf["sketch"]:
                sketch.merge(PairSketch.load(blob))
        self.state.update((sketch.dump(),))
        if self.frame_steps:
            if end not in list(self.handle.listTimers()):
                self.handle.registerTimer(end)
        else:
            yield self._row(key, sketch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sketch = PairSketch.load(self.state.get()[0])
        self.state.clear()
        yield self._row(key, sketch)

    def close(self):
        pass


def stream_robust_metrics(stream: DataFrame, by=("plevel",), thresh: float = THRESHOLD, capacity: int = CAPACITY,
                          ttl_ms: int | None = None, frame_steps: int | None = None, delay: str = "6 hours",
                          time: str = "time") -> DataFrame:
    """A streaming table of (by…, [frame,] ``ROW``) from pairs (by…, target, prediction).

    Pairs without two finite numbers are left out. ``n`` is exact; limits and metrics are those
    of the sketch, whose targets are at most ``rank_error`` * n ranks off (0 while a level has
    fewer than twice ``capacity`` pairs: then all is exact). A level that is quiet for
    ``ttl_ms`` (processing time) is forgotten; such a stream never ends by itself. With
    ``frame_steps`` the key is also ``time`` div so many steps: a frame answers once, when the
    watermark (``delay`` behind the newest row) passes its end, and later rows are left out.
    The caller starts the query in update mode.
    """
    by = list(by)
    if ttl_ms and frame_steps:
        raise ValueError("a frame ends by event time, a quiet level by processing time: choose one")
    keys = [*by, "frame"] if frame_steps else by
    kinds = dict(stream.dtypes) | {"frame": "bigint"}
    rows = stream.select(*by, "target", "prediction", *([time] if frame_steps else []))
    fields = [f"{k} {kinds[k]}" for k in keys]
    if frame_steps:
        rows = rows.withColumns({"frame": F.expr(f"{time} div {frame_steps}"),
                                 "ts": F.timestamp_seconds(F.col(time).cast("bigint") * (STEP_MS // 1000))}).drop(time)
    parts = rows.mapInPandas(_sketched(keys, capacity, frame_steps),
                             ", ".join([*fields, *(["ts TIMESTAMP"] if frame_steps else []), "sketch BINARY"]))
    if frame_steps:
        parts = parts.withWatermark("ts", delay)
    mode = "EventTime" if frame_steps else "ProcessingTime" if ttl_ms else "None"
    return parts.groupBy(*keys).transformWithStateInPandas(
        LevelSketches(keys, capacity, thresh, ttl_ms, frame_steps), ", ".join([*fields, ROW]), "Update", mode)


def _asked(what: str):
    """Brackets from the sketches: (by…, n, least, most, p, lo, hi) of one quantity's median."""
    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = pdf.drop(columns=[c for c in pdf if c in ("sketch", "t_med", "t_mad", "p_med", "kept", "stay")])
            found = []
            for row in pdf.itertuples():
                s = PairSketch.load(row.sketch)
                pairs, w = s.weighted()
                values, slack, low, high, n = pairs[:, 0], s.error, s.low[0], s.high[0], s.n
                if what == "t_mad":
                    values, slack = np.abs(values - row.t_med), 2 * s.error
                    low, high = 0.0, max(high - row.t_med, row.t_med - low)
                elif what != "t_med":
                    stay = ~(np.abs(values - row.t_med) * MAD_TO_SIGMA > row.t_mad * row.stay)
                    values, w, low, high, n = pairs[stay, 1], w[stay], s.low[1], s.high[1], row.kept
                    # A sample of this many pairs: four standard errors of its median's rank.
                    slack = w.sum() * min(0.5, 2 / np.sqrt(max(len(w), 1))) if s.error else 0
                    if what == "p_mad":
                        values, slack = np.abs(values - row.p_med), 2 * slack
                        low, high = 0.0, max(high - row.p_med, row.p_med - low)
                if len(w):
                    spot = (w.sum() - 1) / 2
                    lo, hi = at_ranks(values, w, [np.floor(spot - slack - 1), np.ceil(spot + slack + 1)])
                else:
                    lo, hi = low, high
                found.append((n, low, high, 0, lo, hi))
            yield pd.concat([out.reset_index(drop=True), pd.DataFrame(found, columns=["n", "least", "most", "p", "lo", "hi"])], axis=1)
    return run


def exact_limits(pairs: DataFrame, state: DataFrame, by=("plevel",), thresh: float = THRESHOLD) -> DataFrame:
    """(by…, t_med, t_mad, p_med, p_mad): exact limits of all ``pairs``, from the sketches of all of them.

    Each of the four medians lies in a bracket the sketch gives, so it takes one pass that
    counts what is below and keeps what is inside; a bracket that misses is counted whole.
    """
    by = list(by)
    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in by], "n BIGINT, least DOUBLE, most DOUBLE, p INT, lo DOUBLE, hi DOUBLE"])
    known = state.select(*by, "sketch")

    def median(rows, value, what):
        brackets = known.mapInPandas(_asked(what), schema)
        found = exact_quantiles(rows, value, [0.5], by, brackets=brackets)
        return settle(found.select(*by, F.col("quantiles")[0].alias(what)))

    def known_with(table):
        return settle(attach(known, table, by, settled=True))

    known = known_with(median(pairs, "target", "t_med"))
    rows = attach(pairs, known.drop("sketch"), by, settled=True)
    known = known_with(median(rows, F.abs(F.col("target") - F.col("t_med")), "t_mad"))
    kept = survivors(pairs, known, by, thresh)
    sizes = settle(kept.groupBy(*by).agg(F.count("*").alias("kept")))
    known = known_with(sizes).withColumn("stay", F.lit(float(thresh)))
    known = known_with(median(kept, "prediction", "p_med"))
    rows = attach(kept, known.select(*by, "p_med"), by, settled=True)
    last = median(rows, F.abs(F.col("prediction") - F.col("p_med")), "p_mad")
    return attach(known.select(*by, "t_med", "t_mad", "p_med"), last, by, settled=True)


def survivors(pairs: DataFrame, limits: DataFrame, by=("plevel",), thresh: float = THRESHOLD) -> DataFrame:
    """The pairs within the limits that are known: of targets, and of predictions where given."""
    by = list(by)
    stages = [("target", "t"), *([("prediction", "p")] if "p_mad" in limits.columns else [])]
    rows = attach(pairs, limits.select(*by, *[f"{s}_{m}" for _, s in stages for m in ("med", "mad")]), by, settled=True)
    for col, s in stages:
        gap = F.abs(F.col(col) - F.col(f"{s}_med")) * MAD_TO_SIGMA
        rows = rows.where(~F.coalesce(gap > F.col(f"{s}_mad") * thresh, F.lit(False)))
    return rows.select(*pairs.columns)


def exact_metrics(pairs: DataFrame, state: DataFrame, thresh: float = THRESHOLD) -> DataFrame:
    """Level metrics without outliers, exact, of all pairs the state has seen."""
    rows = pairs.where(is_number("target") & is_number("prediction"))
    return level_metrics(survivors(rows, settle(exact_limits(rows, state, thresh=thresh)), thresh=thresh))
