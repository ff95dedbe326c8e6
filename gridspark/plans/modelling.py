"""Queries for training, scoring and attribution."""

import numpy as np
from pyspark.sql import functions as F

from gridspark.operators import network, scaler, scoring, split, training
from gridspark.operators.index import shuffle_rank
from gridspark.operators.reshape import slice_levels
from gridspark.plans import fixtures as fx
from gridspark.plans.evaluation import rounded
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.registry import query
from gridspark.plans.sampling import FITTED
from gridspark.runtime import scratch_path

SEED = 7


def linear_weights(spark):
    """A linear model given by a rule: weight ((7 i + 3 j) mod 11 - 5) / 10, bias j / 10."""
    i, j = np.indices((fx.FEATURES, fx.TARGETS))
    weights = ((7 * i + 3 * j) % 11 - 5) / 10
    matrix = np.vstack([weights, np.arange(fx.TARGETS)[None, :] / 10])
    return network.to_table(spark, network.Net([], [[matrix]]))


def linear_scored(spark, folder):
    rows = fx.vectors(spark, folder)
    return scoring.batch_score(rows, linear_weights(spark), scaler.scaler_fit(rows, "features"),
                               scaler.scaler_fit(rows, "gwfu"))


LINEAR_SCORE = f"""
    WITH e AS (SELECT sample_id, CAST(unnest(range(52)) AS INT) AS idx, unnest(features) AS v FROM vectors),
    z AS (SELECT sample_id, idx, (v - mean) / sqrt(m2 / n) AS z FROM e JOIN ({FITTED}) USING (idx)),
    y AS (SELECT sample_id, CAST(unnest(range(6)) AS INT) AS plevel, unnest(gwfu) AS target FROM vectors),
    s AS (SELECT plevel, avg(target) AS m, stddev_pop(target) AS sd FROM y GROUP BY plevel),
    p AS (SELECT sample_id, plevel, plevel / 10.0::DOUBLE + sum(z * ((7 * idx + 3 * plevel) % 11 - 5) / 10.0::DOUBLE) AS p
          FROM z, (SELECT CAST(range AS INT) AS plevel FROM range(6)) GROUP BY sample_id, plevel)
    SELECT y.sample_id AS sample_id, y.plevel AS plevel, round(target, 8) AS target, round(p * sd + m, 8) AS prediction
    FROM y JOIN p USING (sample_id, plevel) JOIN s USING (plevel)"""


@query(sql(LINEAR_SCORE))
def batch_score(spark, folder):
    rows = linear_scored(spark, folder).select(
        "sample_id", F.posexplode(F.arrays_zip("target", "prediction")).alias("plevel", "z"))
    return rounded(rows.select("sample_id", "plevel", "z.target", "z.prediction"), 8, "target", "prediction")


ATTRIBUTION = f"""
    WITH r AS (SELECT sample_id, features, row_number() OVER (ORDER BY md5('{SEED}:' || sample_id)) - 1 AS pos
               FROM vectors),
    e AS (SELECT pos, unnest(range(52)) AS idx, unnest(features) AS v FROM r),
    b AS (SELECT idx, avg(v) AS m FROM e WHERE pos < 200 GROUP BY idx)
    SELECT CAST(idx AS INT) AS idx, avg(abs((v - m) * ((7 * idx + 3 * 2) % 11 - 5) / 10.0::DOUBLE)) AS mean_abs
    FROM e JOIN b USING (idx) WHERE pos >= 200 GROUP BY idx"""


def _attributed(spark, folder, weights, block=None, n_permutations=8):
    rows = shuffle_rank(fx.vectors(spark, folder).select("sample_id", "features"), SEED)
    parts = split.attribution_split(rows, 200, rows.count())
    return scoring.attribution(parts.where("role = 'test'"), parts.where("role = 'background'"), weights,
                               2, block, n_permutations, SEED)


@query(sql(f"SELECT idx, round(mean_abs, 8) AS mean_abs FROM ({ATTRIBUTION}) WHERE idx >= 10 AND idx < 40"))
def attribution(spark, folder):
    return rounded(_attributed(spark, folder, linear_weights(spark), (10, 40)), 8, "mean_abs")


@query(sql(f"SELECT idx, round(mean_abs, 8) AS mean_abs FROM ({ATTRIBUTION}) ORDER BY mean_abs DESC, idx LIMIT 7"))
def attribution_topk(spark, folder):
    found = _attributed(spark, folder, linear_weights(spark))
    return rounded(scoring.attribution_topk(found, 7), 8, "mean_abs")


DRAWS = f"""
    WITH r AS (SELECT sample_id, features, row_number() OVER (ORDER BY md5('{SEED}:' || sample_id)) - 1 AS pos
               FROM vectors),
    d AS (SELECT sample_id, features, CAST('0x' || substr(md5('{SEED}:' || sample_id || ':' || k), 1, 8) AS BIGINT) % 200 AS at
          FROM r, (SELECT unnest(range(4)) AS k) WHERE pos >= 200)"""

DRAWN_ATTRIBUTION = sql(DRAWS + """,
    p AS (SELECT d.sample_id, CAST(unnest(range(52)) AS INT) AS idx, unnest(d.features) - unnest(b.features) AS gap
          FROM d JOIN r b ON b.pos = d.at),
    q AS (SELECT sample_id, idx, avg(gap) * ((7 * idx + 3 * 2) % 11 - 5) / 10.0::DOUBLE AS phi FROM p GROUP BY sample_id, idx)
    SELECT idx, round(avg(abs(phi)), 8) AS mean_abs FROM q GROUP BY idx""")


def _test_and_background(spark, folder):
    rows = shuffle_rank(fx.vectors(spark, folder).select("sample_id", "features"), SEED)
    parts = split.attribution_split(rows, 200, rows.count())
    return parts.where("role = 'test'"), parts.where("role = 'background'")


@query(DRAWN_ATTRIBUTION)
def attribution_sampled(spark, folder):
    """The sampled path with a linear net, where the order of the features does not matter."""
    found = scoring.sampled_attribution(*_test_and_background(spark, folder), linear_weights(spark), 2, None, 4, SEED)
    return rounded(found, 8, "mean_abs")


@query(DRAWN_ATTRIBUTION)
def attribution_path(spark, folder):
    """Gradients along the way from the background, of a linear net."""
    found = scoring.path_attribution(*_test_and_background(spark, folder), linear_weights(spark), 2, None, 4, SEED)
    return rounded(found, 8, "mean_abs")


def hidden_weights(spark):
    """A net with a hidden layer of 8 given by a rule, so that SQL can score it."""
    i, j = np.indices((fx.FEATURES, 8))
    hidden = np.vstack([((7 * i + 3 * j) % 11 - 5) / 10, np.arange(8)[None, :] / 10])
    i, j = np.indices((8, fx.TARGETS))
    last = np.vstack([((5 * i + 2 * j) % 7 - 3) / 10, np.zeros((1, fx.TARGETS))])
    return network.to_table(spark, network.Net([hidden], [[last]]))


@query(sql(DRAWS + """,
    w AS (SELECT j, list(((7 * i + 3 * j) % 11 - 5) / 10.0::DOUBLE ORDER BY i) AS w
          FROM (SELECT unnest(range(52)) AS i), (SELECT unnest(range(8)) AS j) GROUP BY j),
    f AS (SELECT sample_id, pos, sum(greatest(list_dot_product(features, w) + j / 10.0::DOUBLE, 0)
            * ((5 * j + 2 * 2) % 7 - 3) / 10.0::DOUBLE) AS f FROM r, w GROUP BY ALL)
    SELECT d.sample_id AS sample_id, round(avg(x.f - b.f), 6) AS total
    FROM d JOIN f x ON x.sample_id = d.sample_id JOIN f b ON b.pos = d.at GROUP BY d.sample_id"""))
def attribution_total(spark, folder):
    """Contributions to a net with a hidden layer: they add up to what SQL scores by two forward passes."""
    found = scoring.path_contributions(*_test_and_background(spark, folder), hidden_weights(spark), 2, 4, SEED, None)
    sums = found.withColumn("total", F.aggregate("phi", F.lit(0.0), lambda a, v: a + v))
    return rounded(sums.groupBy("sample_id").agg(F.avg("total").alias("total")), 6, "total")


@query()
def attribution_net(spark, folder):
    net = network.new_net(fx.FEATURES, fx.TARGETS, (16,), (8,), seed=1)
    return _attributed(spark, folder, network.to_table(spark, net), n_permutations=2)


def training_batches(spark, folder, batch_size=128):
    """Scaled features and targets in balanced batches."""
    rows = fx.vectors(spark, folder)
    scaled = scaler.scaler_transform(rows, scaler.scaler_fit(rows, "features"), "features")
    scaled = scaler.scaler_transform(scaled, scaler.scaler_fit(rows, "gwfu"), "gwfu", "target")
    return split.minibatches(scaled.select("sample_id", "source", "features", "target"),
                             batch_size, 500_000, SEED)


SMALL = dict(trunk=(32, 32), head=(16, 8))


def _trained(spark, folder, **options):
    """A whole training unless options say less: the full net, ten epochs, each a pass of the longest source."""
    given = dict(trunk=network.TRUNK, head=network.HEAD, optimizer=training.Adam(1e-3), epochs=10, steps_per_epoch=None)
    return training.train_mlp(training_batches(spark, folder), **{**given, **options})


LOSSES = f"""
    WITH e AS (SELECT sample_id, source, CAST(unnest(range(52)) AS INT) AS idx, unnest(features) AS v FROM vectors),
    z AS (SELECT sample_id, idx, (v - mean) / sqrt(m2 / n) AS z FROM e JOIN ({FITTED}) USING (idx)),
    y AS (SELECT sample_id, CAST(unnest(range(6)) AS INT) AS plevel, unnest(gwfu) AS t FROM vectors),
    s AS (SELECT plevel, avg(t) AS m, stddev_pop(t) AS sd FROM y GROUP BY plevel),
    p AS (SELECT sample_id, plevel, plevel / 10.0::DOUBLE + sum(z * ((7 * idx + 3 * plevel) % 11 - 5) / 10.0::DOUBLE) AS p
          FROM z, (SELECT CAST(range AS INT) AS plevel FROM range(6)) GROUP BY sample_id, plevel),
    d AS (SELECT sample_id, sum(power(p - (t - m) / sd, 2)) AS sq, sum(abs(p - (t - m) / sd)) AS ab
          FROM y JOIN p USING (sample_id, plevel) JOIN s USING (plevel) GROUP BY sample_id),
    r AS (SELECT sample_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}/mix:' || sample_id)) - 1 AS rk,
          count(*) OVER (PARTITION BY source) AS rows FROM vectors),
    b AS (SELECT sample_id, source, rk // 64 AS batch_id, rows // 64 AS batches FROM r WHERE rk < rows // 64 * 64),
    st AS (SELECT step, avg(sq) AS sq, avg(ab) AS ab
           FROM b JOIN (SELECT unnest(range(2 * (SELECT max(batches) FROM b))) AS step)
           ON batch_id = step % batches JOIN d USING (sample_id) GROUP BY step)
    SELECT CAST(step // (SELECT max(batches) FROM b) + 1 AS INT) AS epoch, round(avg(sq), 8) AS loss,
      round(avg(ab) / 6, 8) AS mae, round(avg(sq) / 6, 8) AS mse FROM st GROUP BY 1"""


@query(sql(LOSSES))
def training_loss(spark, folder):
    """Epoch losses of a fixed linear model: scaling, balanced batches, cycling, reduction."""
    _, log = _trained(spark, folder, loss="mse", optimizer=training.Adam(0.0), epochs=2,
                      init_weights=linear_weights(spark))
    return rounded(log.select("epoch", "loss", "mae", "mse"), 8, "loss", "mae", "mse")


def _learned_sql(steps: str, last: int = 2) -> str:
    """The linear model after its ``last`` step; ``steps`` has the update of step k from w and g."""
    head = LOSSES[:LOSSES.index("    p AS (")] + LOSSES[LOSSES.index("    r AS ("):LOSSES.index("    st AS (")]
    return head + f"""
    x AS (SELECT sample_id, idx, z FROM z UNION ALL SELECT sample_id, 52, 1.0::DOUBLE FROM vectors),
    t AS (SELECT sample_id, plevel, (t - m) / sd AS t FROM y JOIN s USING (plevel)),
    w0 AS (SELECT CAST(i.range AS INT) AS idx, CAST(j.range AS INT) AS plevel, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v,
             CASE WHEN i.range = 52 THEN j.range / 10.0::DOUBLE
                  ELSE ((7 * i.range + 3 * j.range) % 11 - 5) / 10.0::DOUBLE END AS w FROM range(53) i, range(6) j),
    {steps}
    SELECT idx, plevel, round(w, 7) AS w FROM w{last}"""


def _step(k: int, moments: str, update: str, clip: float | None) -> str:
    g = "g" if clip is None else f"greatest(least(g, {clip}), -{clip})"
    return f"""d{k} AS (SELECT b.sample_id, w.plevel, sum(z * w.w) - any_value(t.t) AS d
          FROM b JOIN x ON x.sample_id = b.sample_id JOIN w{k - 1} w USING (idx)
          JOIN t ON t.sample_id = b.sample_id AND t.plevel = w.plevel
          WHERE batch_id = {k - 1} % batches GROUP BY ALL),
    g{k} AS (SELECT idx, plevel, 2 * sum(d * z) / (SELECT count(DISTINCT sample_id) FROM d{k}) AS g
          FROM d{k} JOIN x USING (sample_id) GROUP BY ALL),
    u{k} AS (SELECT idx, plevel, w, {moments.replace("G", g)} FROM g{k} JOIN w{k - 1} USING (idx, plevel)),
    w{k} AS (SELECT idx, plevel, m, v, {update} AS w FROM u{k})"""


def _adam_sql(rate: float, clip: float | None, last: int = 2) -> str:
    def update(k):
        scale = f"{rate} * sqrt(1 - power(0.999::DOUBLE, {k})) / (1 - power(0.9::DOUBLE, {k}))"
        return f"w - {scale} * m / (sqrt(v) + 1e-8)"
    moments = ("0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * (G) AS m, "
               "0.999::DOUBLE * v + (1 - 0.999::DOUBLE) * (G) * (G) AS v")
    return ",\n    ".join(_step(k, moments, update(k), clip) for k in range(1, last + 1))


def _rmsprop_sql(rate: float) -> str:
    moments = "(G) AS m, 0.9::DOUBLE * v + (1 - 0.9::DOUBLE) * (G) * (G) AS v"
    return ",\n    ".join(_step(k, moments, f"w - {rate} * m / (sqrt(v) + 1e-7)", None) for k in (1, 2))


def _learned(spark, folder, optimizer, **options):
    """Weights of the linear model after two steps, by input and output."""
    weights, _ = _trained(spark, folder, loss="mse", optimizer=optimizer, init_weights=linear_weights(spark),
                          **{"epochs": 1, "steps_per_epoch": 2, **options})
    return _by_place(weights)


def _by_place(weights):
    cells = weights.select("n_cols", F.posexplode("weights").alias("at", "w"))
    return cells.select(F.floor(F.col("at") / F.col("n_cols")).cast("int").alias("idx"),
                        F.pmod("at", "n_cols").alias("plevel"), F.round("w", 7).alias("w"))


@query(sql(_learned_sql(_adam_sql(0.01, None))))
def train_adam(spark, folder):
    return _learned(spark, folder, training.Adam(0.01))


@query(sql(_learned_sql(_adam_sql(0.01, 0.05))))
def train_adam_clipped(spark, folder):
    return _learned(spark, folder, training.Adam(0.01, clip=0.05))


@query(sql(_learned_sql(_rmsprop_sql(0.002))))
def train_rmsprop(spark, folder):
    return _learned(spark, folder, training.RMSprop(0.002))


@query(sql(_learned_sql(_adam_sql(0.01, None))))
def train_one_job(spark, folder):
    """The same two steps inside one barrier job."""
    return _learned(spark, folder, training.Adam(0.01), tasks=2)


@query(sql(_learned_sql(_adam_sql(0.01, None, 4), 4)))
def train_resumed(spark, folder):
    """Two epochs of a step, then two more by a run that knows only the saved state."""
    path = scratch_path(spark, "training")
    for epochs in (2, 4):
        _trained(spark, folder, loss="mse", optimizer=training.Adam(0.01), init_weights=linear_weights(spark),
                 epochs=epochs, steps_per_epoch=1, state_path=path)
    flat = training.load_training(spark, path)[0]
    net = network.from_table(linear_weights(spark))
    return _by_place(network.to_table(spark, net.with_flat(flat)))


@query()
def mlp_train(spark, folder):
    weights, _ = _trained(spark, folder, epochs=2, **SMALL)
    return weights.select("part", "head", "layer", F.posexplode("weights").alias("at", "w")).withColumn(
        "w", F.round("w", 4))


@query()
def mlp_train_small(spark, folder):
    """The small net on one output, with the last fifth of the rows for validation."""
    rows = shuffle_rank(fx.vectors(spark, folder), SEED).select(
        "sample_id", "source", "pos", "features", "gwfu")
    labelled = split.tail_split(slice_levels(rows, 0, 1, ["gwfu"]).withColumnRenamed("gwfu", "target"),
                                rows.count(), 0.2)
    batches = split.minibatches(labelled.where("split = 'train'"), 128, 500_000, SEED)
    _, log = training.train_mlp(
        batches, trunk=network.SMALL_TRUNK, head=None, loss="mse", optimizer=training.RMSprop(),
        epochs=2, steps_per_epoch=None, val=labelled.where("split = 'val'"),
        control=training.TrainControl(patience=10))
    return log


@query()
def training_log(spark, folder):
    return _trained(spark, folder, loss="mse")[1]


@query()
def mlp_resume(spark, folder):
    weights, _ = _trained(spark, folder, epochs=1, **SMALL)
    clipped = training.Adam(1e-3, clip=0.1)
    return _trained(spark, folder, epochs=1, optimizer=clipped, init_weights=weights)[1]
