"""Synchronous data-parallel training: runs of small steps in one task after the other, a Spark
job per large step, or one barrier job per epoch.

A step needs the weights of the step before it, so steps follow each other. Where a step has few
rows, a job takes a run of steps: its task reads their rows in the order of the steps, a few Arrow
batches at a time, and hands weights and moments on to the next job. No task sees more than its
run, and an epoch pays one start for each run instead of each step.

A step of more than ``STEP_ROWS`` rows is a job of its own. It reads only its own block of
batches; tasks turn their rows into one summed gradient each; these are added in pieces on the
executors, and the driver receives one vector of the model's size.

In a barrier job each task has its share of every step and its own copy of weights and moments;
per step the tasks exchange their summed gradients and all make the same update. Spark's
``allGather`` answers only once a second, so this suits steps that take longer than that.

Batches are written once to the shared folder, in blocks by batch number. A lost executor
repeats its part of the step, the run, or in a barrier job the epoch, from the weights it began with.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StructField, StructType,
)

from gridspark.operators import network
from gridspark.runtime import scratch_path
from gridspark.sources.versions import latest_state, publish

PIECE = 65_536  # gradient elements per row sent to the reducers
LANES = 32      # first-level reducers per piece
BLOCK = 64      # batches per folder
MESSAGE = 1_000_000  # gradient elements a task hands over at once
HANDED = 16_384  # numbers per row that a run hands on to the next
RESULTS = 16  # tasks that bring these to the driver
STEP_ROWS = 16_384    # a step of more rows is dealt over tasks
RUN_ROWS = 131_072    # rows of the steps that one task takes at most


@dataclass
class Adam:
    learning_rate: float = 1e-4
    beta_1: float = 0.9
    beta_2: float = 0.999
    epsilon: float = 1e-8
    clip: float | None = None
    state: dict = field(default_factory=dict)

    def step(self, w, g):
        s = self.state
        if self.clip is not None:
            g = np.clip(g, -self.clip, self.clip)
        s["t"] = s.get("t", 0) + 1
        s["m"] = self.beta_1 * s.get("m", 0.0) + (1 - self.beta_1) * g
        s["v"] = self.beta_2 * s.get("v", 0.0) + (1 - self.beta_2) * g * g
        rate = self.learning_rate * np.sqrt(1 - self.beta_2 ** s["t"]) / (1 - self.beta_1 ** s["t"])
        return w - rate * s["m"] / (np.sqrt(s["v"]) + self.epsilon)


@dataclass
class RMSprop:
    learning_rate: float = 1e-3
    rho: float = 0.9
    epsilon: float = 1e-7
    state: dict = field(default_factory=dict)

    def step(self, w, g):
        s = self.state
        s["v"] = self.rho * s.get("v", 0.0) + (1 - self.rho) * g * g
        return w - self.learning_rate * g / (np.sqrt(s["v"]) + self.epsilon)


@dataclass
class TrainControl:
    """When to stop, slow down and keep weights; all watch ``monitor``."""
    patience: int = 10
    lr_patience: int = 5
    lr_factor: float = 0.1
    lr_min_gain: float = 1e-4  # a smaller improvement does not hold off a lower learning rate
    monitor: str = "loss"


SUMS = "piece INT, lane INT, n BIGINT, loss DOUBLE, mae DOUBLE, mse DOUBLE, gradient ARRAY<DOUBLE>"


def batch_sums(rows: DataFrame, net, loss: str, with_gradient: bool = True, lanes: int = LANES):
    """(n, loss, mae, mse, gradient) averaged over the rows of (features, target)."""
    held = rows.sparkSession.sparkContext.broadcast(net)
    size = net.flat().size

    def partial(batches):
        from pyspark import TaskContext
        n, sums, total = 0, np.zeros(3), np.zeros(size)
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["features"]), np.stack(pdf["target"])
                if with_gradient:
                    *part, grad = network.gradient(held.value, x, y, loss)
                    total += grad
                else:
                    part = network.losses(held.value, x, y, loss)
                n, sums = n + len(pdf), sums + part
        if n:
            lane = TaskContext.get().partitionId() % lanes
            starts = range(0, size, PIECE) if with_gradient else [0]
            pieces = [total[s:s + PIECE] if with_gradient else np.zeros(0) for s in starts]
            yield pd.DataFrame({
                "piece": range(len(pieces)), "lane": lane, "n": n, "loss": sums[0],
                "mae": sums[1], "mse": sums[2], "gradient": pieces})

    def add(pdf):
        head = pdf.iloc[:1].copy()
        for c in ("n", "loss", "mae", "mse"):
            head[c] = pdf[c].sum(skipna=False)  # a NaN loss must show
        head["gradient"] = [np.sum(np.stack(pdf["gradient"]), axis=0)]
        return head

    parts = rows.select("features", "target").mapInPandas(partial, SUMS)
    whole = parts.groupBy("piece", "lane").applyInPandas(add, SUMS).groupBy("piece").applyInPandas(add, SUMS)
    found = sorted(whole.collect(), key=lambda r: r.piece)
    held.destroy()  # also the driver's copy on disk, one per step
    if not found:
        raise ValueError("no rows to train on")
    n = found[0].n
    outputs = sum(h[-1].shape[1] for h in net.heads)
    # NaN comes back from a task as null; float arrays turn it into NaN again.
    total, mae, mse = np.array([found[0].loss, found[0].mae, found[0].mse], dtype=float) / n
    flat = np.concatenate([np.array(r.gradient, dtype=float) for r in found]) / n
    return n, total, mae / outputs, mse / outputs, flat


def store_batches(batches: DataFrame) -> DataFrame:
    """(source, batch_id, features, target) written once, in folders of consecutive batches."""
    path = scratch_path(batches.sparkSession, "batches")
    source = F.col("source") if "source" in batches.columns else F.lit(0)
    blocked = batches.select(source.cast("string").alias("source"), "batch_id", "features", "target",
                             F.floor(F.col("batch_id") / BLOCK).alias("block"))
    (blocked.repartitionByRange("batch_id", "source").sortWithinPartitions("batch_id")
     .write.partitionBy("block").parquet(path))
    return batches.sparkSession.read.parquet(path)


def step_rows(stored: DataFrame, lengths: dict, step: int) -> DataFrame:
    """The rows of one step: from each source its next batch, starting over at its end."""
    wanted = {source: step % length for source, length in lengths.items()}
    match = F.lit(False)
    for source, number in wanted.items():
        match = match | ((F.col("source") == source) & (F.col("batch_id") == number))
    folders = sorted({number // BLOCK for number in wanted.values()})
    return stored.where(F.col("block").isin(folders) & match)


def _span_rows(stored: DataFrame, lengths: dict, first: int, steps: int) -> DataFrame:
    """The rows of steps [first, first + steps): a stretch of batches per source, or all of them."""
    match, blocks = F.lit(False), set()
    for source, length in lengths.items():
        low = first % length
        high = low + steps - 1
        at = F.col("batch_id")
        if steps >= length:
            wanted, spans = F.lit(True), [(0, length - 1)]
        elif high < length:
            wanted, spans = at.between(low, high), [(low, high)]
        else:
            wanted, spans = (at >= low) | (at <= high - length), [(low, length - 1), (0, high - length)]
        blocks |= {b for a, z in spans for b in range(a // BLOCK, z // BLOCK + 1)}
        match = match | ((F.col("source") == source) & wanted)
    return stored.where(F.col("block").isin(sorted(blocks)) & match)


def _added(context, numbers: np.ndarray) -> np.ndarray:
    """The sum of every task's numbers, in the order of the tasks, so that all get the same."""
    parts = []
    for first in range(0, len(numbers), MESSAGE):
        told = context.allGather(base64.b64encode(numbers[first:first + MESSAGE].tobytes()).decode())
        parts.append(np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0))
    return np.concatenate(parts)


# What a run hands on, as pieces of bytes: in arrays each number would be an object on the driver.
EPOCH = "name STRING, piece INT, numbers BINARY"
DONE = pa.schema([("name", pa.string()), ("piece", pa.int32()), ("numbers", pa.binary())])


def _told(numbers: dict):
    """Arrow batches of the named numbers, a piece each."""
    for name, values in numbers.items():
        values = np.asarray(values, float).ravel()
        for k, i in enumerate(range(0, values.size, HANDED)):
            piece = {"name": name, "piece": k, "numbers": values[i:i + HANDED].tobytes()}
            yield pa.RecordBatch.from_pylist([piece], DONE)


def _heard(rows) -> dict:
    """The named numbers of such pieces."""
    pieces: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.piece):
        pieces.setdefault(r.name, []).append(np.frombuffer(r.numbers, float))
    return {name: np.concatenate(values) for name, values in pieces.items()}


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows; a null element is NaN."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different length, or null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def _by_step(batches):
    """(step, features, targets) of the steps that Arrow batches, in order of step, have rows of."""
    step, xs, ys = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(0).to_numpy()
        x, y = _matrix(batch.column(1)), _matrix(batch.column(2))
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        for low, high in zip(cuts, cuts[1:]):
            if at[low] != step:
                if xs:
                    yield step, np.concatenate(xs), np.concatenate(ys)
                step, xs, ys = at[low], [], []
            xs.append(x[low:high])
            ys.append(y[low:high])
    if xs:
        yield step, np.concatenate(xs), np.concatenate(ys)


def _step_shares(stored: DataFrame, lengths: dict, first: int, steps: int, tasks: int) -> DataFrame:
    """(step, features, target) of steps [first, first + steps), dealt over tasks, each in the order of its steps."""
    length = F.element_at(F.create_map(*[F.lit(v) for pair in lengths.items() for v in pair]), F.col("source"))
    start = F.lit(first) + F.pmod(F.col("batch_id") - first, length)
    rows = _span_rows(stored, lengths, first, steps).withColumns({
        "step": F.explode(F.sequence(start.cast("bigint"), F.lit(first + steps - 1).cast("bigint"), length.cast("bigint"))),
        "_mix": F.xxhash64("source", "batch_id", "features")})
    # The hash also fixes the order inside a step, and with it how its gradient is rounded.
    # One task needs no key: a deployment may raise the partitions of a keyed shuffle.
    spread = rows.repartition(tasks, "_mix") if tasks > 1 else rows.repartition(1)
    return spread.sortWithinPartitions("step", "_mix").select("step", "features", "target")


def steps_at_once(rows_per_step: float) -> int:
    """How many steps one task takes in a run; 0 if a step is large enough to be dealt over tasks."""
    return 0 if rows_per_step > STEP_ROWS else max(1, int(RUN_ROWS // max(rows_per_step, 1)))


def run_epoch(stored: DataFrame, lengths: dict, first: int, steps: int, net, optimizer, loss: str, tasks: int):
    """One job over ``steps`` steps: (weights, optimizer state, losses of the steps).

    Each task reads its share of the rows step by step, so it holds a few Arrow batches however
    many steps there are. More than one task make a barrier job: all must run at the same time,
    and each step sends the size of the model to every task; few large tasks do best.
    """
    spark = stored.sparkSession
    held = spark.sparkContext.broadcast((net, optimizer))

    def work(batches):
        context = None
        if tasks > 1:
            from pyspark import BarrierTaskContext
            context = BarrierTaskContext.get()
        own = _by_step(batches)
        ahead = next(own, None)
        model, rule = held.value
        flat, seen = model.flat(), []
        outputs = sum(h[-1].shape[1] for h in model.heads)
        for step in range(first, first + steps):
            total = np.zeros(4 + flat.size)
            if ahead is not None and ahead[0] == step:
                _, x, y = ahead
                *sums, grad = network.gradient(model, x, y, loss)
                total[:4] = len(x), *sums
                total[4:] = grad
                ahead = next(own, None)
            if context is not None:
                total = _added(context, total)
            if not total[0]:
                raise ValueError(f"no rows to train on in step {step}")
            value, mae, mse = total[1:4] / total[0]
            seen.append([value, mae / outputs, mse / outputs])
            if not np.isfinite(value):
                break
            flat = rule.step(flat, total[4:] / total[0])
            model = model.with_flat(flat)
        if context is None or context.partitionId() == 0:
            yield from _told({"weights": flat, "seen": seen, **{f"state_{k}": v for k, v in rule.state.items()}})

    spread = _step_shares(stored, lengths, first, steps, tasks)
    told, large = spread.mapInArrow(work, EPOCH, barrier=tasks > 1), net.flat().size > PIECE
    if large and tasks == 1:
        # The driver gets the results of several tasks one by one, and not a single large one.
        told = told.repartition(RESULTS)
    done = _heard(told.collect())
    held.destroy()
    if large:
        # Copies of the net and its moments; a driver that waits for room to run out grows by each run.
        spark.sparkContext._jvm.System.gc()
    state = {k.removeprefix("state_"): v for k, v in done.items() if k.startswith("state_")}
    if "t" in state:
        state["t"] = int(state["t"][0])
    return done["weights"], state, list(done["seen"].reshape(-1, 3))


COUNTERS = ("epoch", "step", "best", "best_rate", "waited", "flat_epochs", "learning_rate", "t", "done")


def save_training(spark, path: str, flat, best_flat, optimizer, counters: dict, log: list) -> None:
    """A version of everything training needs to go on, complete or not there at all."""
    numbers = {"weights": flat, "best": best_flat, "counters": [float(counters[c]) for c in COUNTERS],
               "log": np.array([[np.nan if v is None else v for v in row] for row in log], float).ravel(),
               **{f"state_{k}": v for k, v in optimizer.state.items() if k != "t"}}
    rows = [(name, i, [float(v) for v in values[i * PIECE:(i + 1) * PIECE]])
            for name, values in numbers.items() for i in range(-(-len(values) // PIECE))]
    publish(spark.createDataFrame(rows, "name STRING, piece INT, numbers ARRAY<DOUBLE>"), path, int(counters["epoch"]))


def load_training(spark, path: str):
    """(weights, best weights, optimizer state, counters, log) of the newest version; None if there is none."""
    saved = latest_state(spark, path)
    if saved is None:
        return None
    parts: dict[str, list] = {}
    for r in saved.orderBy("name", "piece").toLocalIterator():
        parts.setdefault(r.name, []).extend(r.numbers)
    counters = dict(zip(COUNTERS, parts["counters"]))
    for c in ("epoch", "step", "waited", "flat_epochs", "t"):
        counters[c] = int(counters[c])
    state = {k.removeprefix("state_"): np.array(v) for k, v in parts.items() if k.startswith("state_")}
    if counters["t"]:
        state["t"] = counters["t"]
    width = len(LOG.fields)
    log = [parts["log"][i:i + width] for i in range(0, len(parts.get("log", [])), width)]
    log = [(int(r[0]), int(r[1]), *[None if np.isnan(v) and k == 6 else v for k, v in enumerate(r[2:], 2)]) for r in log]
    return np.array(parts["weights"]), np.array(parts["best"]), state, counters, log


LOG = StructType([
    StructField("epoch", IntegerType()), StructField("steps", LongType()),
    *[StructField(c, DoubleType()) for c in ("loss", "mae", "mse", "rmse", "val_loss", "learning_rate")],
])


def train_mlp(batches: DataFrame, trunk=network.TRUNK, head=network.HEAD, loss: str = "log_cosh",
              optimizer=None, epochs: int = 10, steps_per_epoch: int | None = 1000,
              val: DataFrame | None = None, val_steps: int | None = None, control: TrainControl | None = None,
              init_weights: DataFrame | None = None, seed: int = 0,
              checkpoint_path: str | None = None, tasks: int | None = None, state_path: str | None = None):
    """Train on ([source,] batch_id, features, target) rows; returns (weights, log) tables.

    Loss is the batch mean, summed over the outputs. Batches are used in order, and each
    source starts over at its end; without ``steps_per_epoch`` an epoch is one pass of the
    longest. The weights of the best epoch are returned, and written to
    ``checkpoint_path`` whenever an epoch improves. Training ends on a loss that is not
    a number. ``val`` rows are written once; with ``val_steps`` they hold a batch_id, and an
    epoch takes that many batches of them, going on where the last one stopped. Runs of
    small steps and single large ones are a job each; with ``tasks`` an epoch is one barrier job
    of that many tasks instead. With ``state_path`` every epoch leaves a version of weights,
    moments, step, learning rate and counters there, and training goes on from the newest:
    ``epochs`` then counts all of them.
    """
    spark = batches.sparkSession
    optimizer, control = optimizer or Adam(), control or TrainControl()
    stored = store_batches(batches)
    sources = stored.groupBy("source").agg((F.max("batch_id") + 1).alias("n"),
                                           F.count("*").alias("rows")).collect()
    lengths = {r.source: r.n for r in sources}
    steps_per_epoch = steps_per_epoch or max(lengths.values())
    run = steps_per_epoch if tasks else steps_at_once(sum(r.rows / r.n for r in sources))
    if val is not None:
        path = scratch_path(spark, "validation")
        val.write.parquet(path)
        val = spark.read.parquet(path)
        if val_steps is not None:
            val_batches = val.agg(F.max("batch_id")).first()[0] + 1
    if init_weights is not None:
        net = network.from_table(init_weights)
    else:
        shape = stored.select(F.size("features").alias("x"), F.size("target").alias("y")).first()
        net = network.new_net(shape.x, shape.y, trunk, head, seed)

    flat, best_flat, best, best_rate = net.flat(), net.flat(), np.inf, np.inf
    waited, flat_epochs, log, step, begun = 0, 0, [], 0, 1
    known = load_training(spark, state_path) if state_path else None
    if known is not None:
        flat, best_flat, optimizer.state, counters, log = known
        best, best_rate, optimizer.learning_rate = counters["best"], counters["best_rate"], counters["learning_rate"]
        waited, flat_epochs, step = counters["waited"], counters["flat_epochs"], counters["step"]
        begun = epochs + 1 if counters["done"] else counters["epoch"] + 1
        net = net.with_flat(flat)
    for epoch in range(begun, epochs + 1):
        seen = []
        while len(seen) < steps_per_epoch and (not seen or np.isfinite(seen[-1][0])):
            if run:
                flat, optimizer.state, more = run_epoch(
                    stored, lengths, step, min(run, steps_per_epoch - len(seen)), net, optimizer, loss, tasks or 1)
            else:
                *more, grad = batch_sums(step_rows(stored, lengths, step), net, loss)[1:]
                flat = optimizer.step(flat, grad) if np.isfinite(more[0]) else flat
                more = [more]
            seen += more
            step += len(more)
            net = net.with_flat(flat)
        value, mae, mse = np.mean(seen, axis=0)
        val_loss = None
        if val is not None:
            rows = val
            if val_steps is not None:
                first = (epoch - 1) * val_steps
                numbers = [(first + i) % val_batches for i in range(min(val_steps, val_batches))]
                rows = val.where(F.col("batch_id").isin(numbers))
            val_loss = float(batch_sums(rows, net, loss, with_gradient=False)[1])
        log.append((epoch, step, float(value), float(mae), float(mse), float(np.sqrt(mse)),
                    val_loss, float(optimizer.learning_rate)))
        done = not np.isfinite(value)
        watched = val_loss if control.monitor == "val_loss" else value
        if not done:
            if watched < best_rate - control.lr_min_gain:
                best_rate, flat_epochs = watched, 0
            else:
                flat_epochs += 1
                if flat_epochs >= control.lr_patience:
                    optimizer.learning_rate *= control.lr_factor
                    flat_epochs = 0
            if watched < best:
                best, best_flat, waited = watched, flat, 0
                if checkpoint_path:
                    saved = network.to_table(spark, net).withColumn("epoch", F.lit(epoch))
                    saved.write.mode("overwrite").parquet(f"{checkpoint_path}/epoch={epoch:04d}")
            else:
                waited += 1
                done = waited >= control.patience
        if state_path:
            save_training(spark, state_path, flat, best_flat, optimizer, {
                "epoch": epoch, "step": step, "best": best, "best_rate": best_rate, "waited": waited, "flat_epochs": flat_epochs,
                "learning_rate": optimizer.learning_rate, "t": optimizer.state.get("t", 0), "done": done}, log)
        if done:
            break
    return network.to_table(spark, net.with_flat(best_flat)), spark.createDataFrame(log, LOG)
