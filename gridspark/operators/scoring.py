"""Batch scoring and feature attribution with a trained net."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import network
from gridspark.operators.index import shuffle_rank
from gridspark.operators.scaler import scaler_inverse, scaler_transform
from gridspark.runtime import attach

def _matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(vectors), -1).astype(float)


def share(weights: DataFrame) -> Broadcast:
    """The model sent to the executors once; its size does not depend on the data."""
    return weights.sparkSession.sparkContext.broadcast(network.from_table(weights))


def predict(df: DataFrame, weights: DataFrame | Broadcast, col: str = "features", out: str = "prediction") -> DataFrame:
    """Forward pass; only the feature column goes through Arrow to Python."""
    held = weights if isinstance(weights, Broadcast) else share(weights)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            if not len(vectors):
                yield pa.array([], pa.list_(pa.float64()))
                continue
            y = network.forward(held.value, _matrix(vectors))
            offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            yield pa.ListArray.from_arrays(offsets, y.ravel())

    return df.withColumn(out, run(col))


def batch_score(df: DataFrame, weights: DataFrame | Broadcast, x_state: DataFrame, y_state: DataFrame,
                target: str = "gwfu") -> DataFrame:
    """Scale the features, predict, and unscale the predictions to the target's units."""
    scaled = scaler_transform(df.select("sample_id", "features", target), x_state, "features")
    scored = scaler_inverse(predict(scaled, weights), y_state, "prediction")
    return scored.select("sample_id", F.col(target).alias("target"), "prediction")


def attribution(df: DataFrame, background: DataFrame, weights: DataFrame, level: int,
                block: tuple[int, int] | None = None, n_permutations: int = 32, seed: int = 0) -> DataFrame:
    """Mean size of each feature's contribution to one output: (idx, mean_abs).

    Contributions are Shapley values against the background. A linear net has them in
    closed form, w * (x - background mean), computed without Python; otherwise see
    :func:`sampled_attribution`.
    """
    net = network.from_table(weights)
    rows = df.select("sample_id", "features")
    if net.is_linear:
        return _linear(rows, background, net, level, block)
    return _sampled(rows, background, net, level, block, n_permutations, seed)


def _mean_size(per_feature: DataFrame, block) -> DataFrame:
    if block is not None:
        per_feature = per_feature.where((F.col("idx") >= block[0]) & (F.col("idx") < block[1]))
    return per_feature.groupBy("idx").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def _linear(rows, background, net, level, block):
    matrix = np.hstack([h[0] for h in net.heads])
    slopes = F.lit([float(w) for w in matrix[:-1, level]])
    means = background.select(F.posexplode("features").alias("idx", "v")).groupBy("idx").agg(
        F.avg("v").alias("m"))
    centre = means.agg(F.array_sort(F.collect_list(F.struct("idx", "m"))).alias("s")).select(
        F.col("s")["m"].alias("_centre"))
    gaps = F.zip_with("features", "_centre", lambda x, m: x - m)
    phi = attach(rows, centre).select(
        F.posexplode(F.zip_with(gaps, slopes, lambda d, w: d * w)).alias("idx", "phi"))
    return _mean_size(phi, block)


def _one_output(net, level):
    """The trunk and the head that gives an output, and its place in that head."""
    start = 0
    for head in net.heads:
        width = head[-1].shape[1]
        if level < start + width:
            return network.Net(net.trunk, [head]), level - start
        start += width
    raise ValueError(f"the net has {start} outputs, there is no {level}")


def sampled_attribution(df: DataFrame, background: DataFrame, weights: DataFrame, level: int,
                        block: tuple[int, int] | None = None, n_permutations: int = 32, seed: int = 0) -> DataFrame:
    """(idx, mean_abs) by sampled Shapley values, for any net and a background of any size.

    Draw k of a sample replaces features, in a random order, of the background row whose
    place (in seeded order) is a hash of seed, sample and k; the rows meet in a join.
    """
    rows = df.select("sample_id", "features")
    return _sampled(rows, background, network.from_table(weights), level, block, n_permutations, seed)


def _drawn(rows, background, draws, seed):
    """(sample_id, k, features, base): ``draws`` background rows for each sample, met in a join.

    The place of a row in the seeded order of the background is a hash of seed, sample and k.
    """
    based = shuffle_rank(background.select("sample_id", "features"), seed, out="at").select(
        "at", F.col("features").alias("base"))
    size = background.select("sample_id").agg(F.count("*").alias("n")).scalar()
    drawn = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"), F.col("k").cast("string")))
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return drawn.withColumn("at", F.pmod(place, size)).join(based, "at").select(
        "sample_id", "k", "features", "base")


def _mean_phi(explained: DataFrame) -> DataFrame:
    """(sample_id, idx, phi): the mean over a sample's draws, combined before the shuffle."""
    return explained.select("sample_id", F.posexplode("phi").alias("idx", "phi")).groupBy("sample_id", "idx").agg(
        F.avg("phi").alias("phi"))


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, values.ravel())


def _sampled(rows, background, net, level, block, n_permutations, seed):
    model, output = _one_output(net, level)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def explain(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, base = _matrix(batch.column("features")), _matrix(batch.column("base"))
            phi = np.zeros_like(x)
            # Row k of ``taken`` holds the first k features of the sample and the rest of the base.
            taken = np.tri(x.shape[1] + 1, x.shape[1], -1, dtype=bool)
            ids, draws = (batch.column(c).to_numpy() for c in ("sample_id", "k"))
            for i in range(len(x)):
                order = np.random.default_rng([seed, int(ids[i]), int(draws[i])]).permutation(x.shape[1])
                steps = np.tile(base[i], (x.shape[1] + 1, 1))
                steps[:, order] = np.where(taken, x[i, order], steps[:, order])
                phi[i, order] = np.diff(network.forward(held.value, steps)[:, output])
            yield pa.record_batch([batch.column("sample_id").cast(pa.int64()), _lists(phi)], ["sample_id", "phi"])

    paired = _drawn(rows, background, n_permutations, seed)
    return _mean_size(_mean_phi(paired.mapInArrow(explain, "sample_id BIGINT, phi ARRAY<DOUBLE>")), block)


def path_contributions(df: DataFrame, background: DataFrame, weights: DataFrame, level: int,
                       draws: int = 32, seed: int = 0, steps: int | None = 32) -> DataFrame:
    """(sample_id, k, phi ARRAY<DOUBLE>, rise): contributions to one output by backward passes.

    Gradients are integrated along the straight way from a drawn background row to the sample
    (the draws of :func:`sampled_attribution`). Contributions of a draw add up to ``rise``,
    the output at the sample less that at the background row, within the error that
    :func:`network.path_contributions` states: a draw costs ``steps`` backward passes whatever
    the number of features, or, with None, one for each bend on the way and no error.
    """
    model, output = _one_output(network.from_table(weights), level)
    rows = df.select("sample_id", "features")
    held = rows.sparkSession.sparkContext.broadcast([*model.trunk, *model.heads[0]])

    def explain(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                phi, rise = network.path_contributions(held.value, _matrix(some.column("features")),
                                                       _matrix(some.column("base")), output, steps)
                yield pa.record_batch([some.column("sample_id").cast(pa.int64()), some.column("k"), _lists(phi),
                                       pa.array(rise)], ["sample_id", "k", "phi", "rise"])

    paired = _drawn(rows, background, draws, seed)
    return paired.mapInArrow(explain, "sample_id BIGINT, k INT, phi ARRAY<DOUBLE>, rise DOUBLE")


def path_attribution(df: DataFrame, background: DataFrame, weights: DataFrame, level: int,
                     block: tuple[int, int] | None = None, draws: int = 32, seed: int = 0,
                     steps: int | None = 32) -> DataFrame:
    """(idx, mean_abs) of a net of any depth by :func:`path_contributions`; exact for a linear one."""
    return _mean_size(_mean_phi(path_contributions(df, background, weights, level, draws, seed, steps)), block)


def attribution_topk(attr: DataFrame, k: int = 7) -> DataFrame:
    return attr.orderBy(F.col("mean_abs").desc(), "idx").limit(k)
