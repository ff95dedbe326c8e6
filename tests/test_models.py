"""Gradients, training control, scoring and attribution."""

import re

import numpy as np
import pyarrow as pa
import pytest

from gridspark.operators import network, scaler, scoring, training
from gridspark.plans import modelling

RNG = np.random.default_rng(4)
X = RNG.normal(size=(240, 5))
Y = np.stack([X[:, 0] - 2 * X[:, 1], np.maximum(X[:, 2], 0)], axis=1)


def rows(spark, x=X, y=Y, batch=60):
    data = [(i, i // batch, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(
        data, "sample_id BIGINT, batch_id BIGINT, features ARRAY<DOUBLE>, target ARRAY<DOUBLE>")


@pytest.mark.parametrize("loss", ["log_cosh", "mse", "mae"])
@pytest.mark.parametrize("head", [(4, 3), None])
def test_gradient_is_the_slope_of_the_loss(loss, head):
    net = network.new_net(5, 2, (6, 4), head, seed=1)
    # Biases off zero: at zero a unit without input sits on the kink of its ReLU.
    flat = net.flat() + RNG.normal(scale=0.1, size=net.flat().size)
    net = net.with_flat(flat)
    *_, grad = network.gradient(net, X, Y, loss)
    for i in RNG.choice(flat.size, 25, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (network.gradient(net.with_flat(flat + s * step), X, Y, loss)[0] for s in (1, -1))
        assert np.isclose(grad[i], (up - down) / 2e-6, rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("lanes", [1, 4])
def test_gradient_does_not_depend_on_partitions(spark, monkeypatch, lanes):
    monkeypatch.setattr(training, "PIECE", 17)  # several pieces of a small gradient
    net = network.new_net(5, 2, (6,), (4,), seed=1)
    one = training.batch_sums(rows(spark).coalesce(1), net, "mse", lanes=lanes)
    many = training.batch_sums(rows(spark).repartition(7), net, "mse", lanes=lanes)
    *want, grad = network.gradient(net, X, Y, "mse")
    for n, loss, mae, mse, flat in (one, many):
        assert n == 240 and np.isclose(loss, want[0] / 240) and np.isclose(mse, want[2] / 480)
        assert np.allclose(flat, grad / 240, atol=1e-9)


def test_loss_falls_and_weights_come_back(spark, tmp_path):
    weights, log = training.train_mlp(
        rows(spark), trunk=(16,), head=(8,), loss="mse", optimizer=training.Adam(0.02), epochs=4,
        steps_per_epoch=4, val=rows(spark), checkpoint_path=str(tmp_path))
    log = log.orderBy("epoch").collect()
    assert log[-1].loss < 0.7 * log[0].loss and [r.steps for r in log] == [4, 8, 12, 16]
    net = network.from_table(weights)
    after = ((network.forward(net, X) - Y) ** 2).sum(axis=1).mean()
    assert np.isclose(after, min(r.val_loss for r in log), rtol=0.2)
    saved = spark.read.parquet(str(tmp_path))
    assert saved.select("epoch").distinct().count() >= 2
    _, more = training.train_mlp(rows(spark), loss="mse", optimizer=training.Adam(0.02, clip=0.1), epochs=1,
                                 steps_per_epoch=2, init_weights=weights)
    assert more.first().loss < log[0].loss


def test_training_stops_when_nothing_improves(spark):
    control = training.TrainControl(patience=3, lr_patience=2)
    _, log = training.train_mlp(rows(spark), trunk=(), head=None, optimizer=training.Adam(0.0), epochs=9,
                                steps_per_epoch=4, control=control)
    assert log.count() == 4


def test_learning_rate_falls_when_loss_is_flat(spark):
    control = training.TrainControl(patience=5, lr_patience=2)
    adam = training.Adam(1e-300)
    training.train_mlp(rows(spark), trunk=(), head=None, optimizer=adam, epochs=4, steps_per_epoch=4,
                       control=control)
    assert np.isclose(adam.learning_rate / 1e-301, 1.0)


def test_training_stops_on_nan(spark):
    y = Y.copy()
    y[70, 0] = np.nan
    _, log = training.train_mlp(rows(spark, y=y), trunk=(), head=None, epochs=5, steps_per_epoch=4)
    assert log.count() == 1 and log.first().steps == 2


def test_a_step_takes_the_next_batch_of_each_source(spark):
    data = [(s, b, [float(b)], [0.0]) for s, n in (("a", 3), ("b", 2)) for b in range(n)]
    df = spark.createDataFrame(data, "source STRING, batch_id BIGINT, features ARRAY<DOUBLE>, target ARRAY<DOUBLE>")
    stored = training.store_batches(df)
    got = [sorted((r.source, r.batch_id) for r in training.step_rows(stored, {"a": 3, "b": 2}, s).collect())
           for s in range(4)]
    assert got == [[("a", 0), ("b", 0)], [("a", 1), ("b", 1)], [("a", 2), ("b", 0)], [("a", 0), ("b", 1)]]


def test_weights_table_round_trip(spark):
    net = network.new_net(5, 3, (7, 4), (6,), seed=2)
    again = network.from_table(network.to_table(spark, net).repartition(3))
    assert (net.flat() == again.flat()).all() and np.allclose(network.forward(net, X), network.forward(again, X))
    full = network.new_net(203, 33)
    assert len(full.trunk) == 4 and [m.shape[1] for m in full.heads[0]] == [256, 128, 64, 32, 1]


def test_batch_score_scales_in_and_out(spark):
    net = network.new_net(5, 2, (6,), (4,), seed=3)
    df = rows(spark).withColumnRenamed("target", "gwfu")
    x_state, y_state = scaler.scaler_fit(df, "features"), scaler.scaler_fit(df, "gwfu")
    scored = scoring.batch_score(df, network.to_table(spark, net), x_state, y_state).orderBy("sample_id").collect()
    z = (X - X.mean(axis=0)) / X.std(axis=0)
    want = network.forward(net, z) * Y.std(axis=0) + Y.mean(axis=0)
    assert np.allclose([r.prediction for r in scored], want) and np.allclose([r.target for r in scored], Y)


def test_sampled_attribution_of_a_linear_model_is_exact(spark):
    net = network.new_net(5, 2, (), None, seed=3)
    deep = network.Net([], [[np.vstack([np.eye(5), 50 * np.ones((1, 5))]),
                             np.vstack([net.heads[0][0][:-1], net.heads[0][0][-1:] - 50 * net.heads[0][0][:-1].sum(axis=0)])]])
    df = rows(spark)
    test, base = df.where("sample_id >= 1"), df.where("sample_id < 1")
    exact = scoring.attribution(test, base, network.to_table(spark, net), 1, (1, 4))
    sampled = scoring.attribution(test, base, network.to_table(spark, deep), 1, (1, 4), 2)
    a, b = ({r.idx: r.mean_abs for r in d.collect()} for d in (exact, sampled))
    assert set(a) == {1, 2, 3}
    assert np.allclose([a[i] for i in sorted(a)], [b[i] for i in sorted(a)])
    want = np.abs(net.heads[0][0][:-1, 1] * (X[1:] - X[0])).mean(axis=0)
    assert np.allclose([a[i] for i in (1, 2, 3)], want[1:4])


def test_contributions_along_the_way_match_a_fine_grid():
    rng = np.random.default_rng(4)
    for trunk, head in (((6, 5), (4,)), ((30,), (9, 7)), ((), None)):
        net = network.new_net(5, 3, trunk, head, seed=5)
        matrices = [*net.trunk, *net.heads[-1 if head else 0]]
        output = 0 if head else 2
        x, base = rng.normal(size=(20, 5)), rng.normal(size=(20, 5))
        x[3] = base[3]  # no way to go
        x[4] = 0.0  # every unit without bias sits on its bend
        phi, rise = network.path_contributions(matrices, x, base, output)
        assert np.allclose(rise, (network.forward(net, x) - network.forward(net, base))[:, 2])
        assert np.abs(phi.sum(axis=1) - rise).max() < 1e-9 and not phi[3].any()
        assert np.abs(phi - network.path_contributions(matrices, x, base, output, 20_000)[0]).max() < 1e-3
        rough = network.path_contributions(matrices, x, base, output, 8)[0]
        grid = (np.arange(2000) + 0.5) / 2000
        gap = x - base
        along = np.array([(network.slopes(matrices, base + t * gap, gap, output)[1] * gap).sum(axis=1) for t in grid])
        changes = np.abs(np.diff(along, axis=0)).sum(axis=0)
        assert (np.abs(rough.sum(axis=1) - rise) <= changes / 16 + 1e-9).all()
    assert network.path_contributions(matrices, x[:0], base[:0], output)[0].shape == (0, 5)


def test_path_attribution_of_a_deep_net(spark):
    net = network.new_net(5, 2, (6, 4), (3,), seed=3)
    weights, df = network.to_table(spark, net), rows(spark)
    test, base = df.where("sample_id >= 3"), df.where("sample_id < 3")
    found = scoring.path_contributions(test, base, weights, 1, draws=4, seed=2, steps=None).collect()
    assert sorted((r.sample_id, r.k) for r in found) == [(i, k) for i in range(3, len(X)) for k in range(4)]
    assert all(abs(sum(r.phi) - r.rise) < 1e-9 for r in found)
    want = {}
    for r in found:
        want.setdefault(r.sample_id, []).append(r.phi)
    want = np.abs([np.mean(v, axis=0) for v in want.values()]).mean(axis=0)
    got = scoring.path_attribution(test, base, weights, 1, (1, 4), draws=4, seed=2, steps=None).collect()
    assert np.allclose([v for _, v in sorted((r.idx, r.mean_abs) for r in got)], want[1:4])
    assert scoring.path_attribution(test.limit(0), base, weights, 1).collect() == []


def test_topk_orders_by_size(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 5, 3, 5])], "idx INT, mean_abs DOUBLE")
    assert [r.idx for r in scoring.attribution_topk(df, 3).collect()] == [1, 3, 2]


def test_a_large_background_is_joined_not_broadcast(spark):
    """Draws meet their background rows in a shuffle join, however many there are."""
    net = network.new_net(5, 2, (4,), None)
    base = spark.range(30_000).selectExpr("id as sample_id", "array(sin(id), cos(id), 0.1, 0.2, sin(2 * id)) as features")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        found = scoring.attribution(rows(spark).where("sample_id < 6"), base, network.to_table(spark, net), 0, n_permutations=3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[.*at#", plan)
        assert [r.idx for r in found.orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("optimizer", [lambda: training.Adam(0.02, clip=0.5), lambda: training.RMSprop(0.01)])
def test_one_job_an_epoch_gives_the_weights_of_a_job_a_step(spark, monkeypatch, optimizer):
    monkeypatch.setattr(training, "MESSAGE", 37)  # several messages for a small gradient
    given = dict(trunk=(8,), head=(4,), loss="log_cosh", epochs=2, steps_per_epoch=5, val=rows(spark))
    runs = [training.train_mlp(rows(spark), optimizer=optimizer(), **given, **how) for how in ({}, {"tasks": 3})]
    (one, log_one), (two, log_two) = runs
    assert np.allclose(network.from_table(one).flat(), network.from_table(two).flat(), rtol=0, atol=1e-9)
    for a, b in zip(log_one.orderBy("epoch").collect(), log_two.orderBy("epoch").collect(), strict=True):
        assert a.steps == b.steps and np.allclose([a.loss, a.mae, a.mse, a.val_loss], [b.loss, b.mae, b.mse, b.val_loss])


def test_an_epoch_is_one_barrier_job(spark):
    stored = training.store_batches(rows(spark))
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("epoch", "one epoch")
    net = network.new_net(5, 2, (6,), None, seed=1)
    flat, state, seen = training.run_epoch(stored, {"0": 4}, 3, 9, net, training.Adam(0.01), "mse", 2)
    sc.setLocalProperty("spark.jobGroup.id", None)
    # The shuffle that deals the rows is a job of its own under adaptive execution.
    assert len(tracker.getJobIdsForGroup("epoch")) <= 2
    assert len(seen) == 9 and state["t"] == 9 and not np.allclose(flat, net.flat())


@pytest.mark.parametrize("span", [(0, 2), (3, 2), (3, 4), (2, 9)])
def test_the_rows_of_a_span_are_those_of_its_steps(spark, span):
    data = [(k, b, [float(b)], [0.0]) for k, n in (("a", 4), ("b", 3)) for b in range(n)]
    frame = spark.createDataFrame(data, "source STRING, batch_id BIGINT, features ARRAY<DOUBLE>, target ARRAY<DOUBLE>")
    stored, lengths = training.store_batches(frame), {"a": 4, "b": 3}
    want = {(s, k % n) for s, n in lengths.items() for k in range(span[0], span[0] + span[1])}
    assert {(r.source, r.batch_id) for r in training._span_rows(stored, lengths, *span).collect()} == want


@pytest.mark.parametrize("tasks", [None, 2])
def test_training_goes_on_where_it_stopped(spark, tmp_path, tasks):
    given = dict(trunk=(8,), head=None, loss="mse", steps_per_epoch=3, val=rows(spark), tasks=tasks, seed=5,
                 control=training.TrainControl(monitor="val_loss", lr_patience=1, lr_min_gain=1e9, lr_factor=0.5))
    whole, log = training.train_mlp(rows(spark), optimizer=training.Adam(0.02), epochs=4, **given)
    path = str(tmp_path)
    training.train_mlp(rows(spark), optimizer=training.Adam(0.02), epochs=2, state_path=path, **given)
    (tmp_path / "batch=9").mkdir()  # of a run that was cut off while it wrote
    parts, more = training.train_mlp(rows(spark), optimizer=training.Adam(0.02), epochs=4, state_path=path, **given)
    assert np.allclose(network.from_table(whole).flat(), network.from_table(parts).flat(), rtol=0, atol=1e-12)
    assert [tuple(r) for r in log.collect()] == [tuple(r) for r in more.collect()] and more.count() == 4
    again, _ = training.train_mlp(rows(spark), optimizer=training.Adam(0.02), epochs=4, state_path=path, **given)
    assert np.allclose(network.from_table(again).flat(), network.from_table(parts).flat(), rtol=0, atol=0)


def test_training_that_has_ended_stays_ended(spark, tmp_path):
    given = dict(trunk=(), head=None, loss="mse", steps_per_epoch=1, state_path=str(tmp_path),
                 control=training.TrainControl(patience=1))
    training.train_mlp(rows(spark), optimizer=training.Adam(0.0), epochs=5, **given)
    _, log = training.train_mlp(rows(spark), optimizer=training.Adam(0.0), epochs=9, **given)
    assert log.count() < 5


def test_jobs_do_not_grow_with_small_steps(spark, monkeypatch):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    nets, jobs = [], []
    for most, steps in ((training.STEP_ROWS, 4), (training.STEP_ROWS, 12), (0, 12)):
        monkeypatch.setattr(training, "STEP_ROWS", most, raising=False)
        sc.setJobGroup(f"steps-{most}-{steps}", "an epoch")
        weights, log = training.train_mlp(rows(spark), trunk=(6,), head=None, loss="mse", optimizer=training.Adam(0.01),
                                          epochs=2, steps_per_epoch=steps, seed=2)
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(tracker.getJobIdsForGroup(f"steps-{most}-{steps}")))
        nets.append((network.from_table(weights).flat(), np.array([tuple(r)[:6] for r in log.collect()], float)))
    assert jobs[0] == jobs[1] and jobs[2] >= jobs[1] + 2 * 10
    for one, other in zip(nets[1], nets[2]):
        assert np.allclose(one, other, rtol=0, atol=1e-12)


def test_runs_of_steps_hand_over_weights_and_moments(spark, monkeypatch):
    given = dict(trunk=(6,), head=None, loss="mse", epochs=2, steps_per_epoch=7, seed=2)
    whole, _ = training.train_mlp(rows(spark), optimizer=training.Adam(0.01), **given)
    monkeypatch.setattr(training, "RUN_ROWS", 130)
    parts, log = training.train_mlp(rows(spark), optimizer=training.Adam(0.01), **given)
    assert np.allclose(network.from_table(whole).flat(), network.from_table(parts).flat(), rtol=0, atol=1e-12)
    assert [r.steps for r in log.collect()] == [7, 14]


def test_rows_come_step_by_step_and_ragged_ones_are_refused():
    def batch(steps, vectors):
        return pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(vectors, pa.list_(pa.float64())),
                                           pa.array([[1.0]] * len(steps))], ["step", "features", "target"])
    got = list(training._by_step([batch([3, 3, 5], [[1.0], [2.0], [None]]), batch([], []), batch([5, 6], [[4.0], [5.0]])]))
    assert [(int(k), len(x)) for k, x, _ in got] == [(3, 2), (5, 2), (6, 1)]
    assert np.isnan(got[1][1][0, 0]) and got[1][1][1, 0] == 4.0
    for bad in ([[1.0], [1.0, 2.0, 3.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            list(training._by_step([batch([1, 1], bad)]))


def test_the_log_is_of_the_full_net_and_all_epochs(spark, tmp_path):
    vectors = np.random.default_rng(6).normal(size=(300, 64))
    data = [(i, v.tolist(), int(i >= 200)) for i, v in enumerate(vectors)]
    spark.createDataFrame(data, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    batches = {}
    for r in modelling.training_batches(spark, str(tmp_path)).collect():
        batches.setdefault((r.source, r.batch_id), []).append((r.features, r.target))
    net, adam, want = network.new_net(52, 6, (256, 256, 256, 256), (256, 128, 64, 32)), training.Adam(1e-3), []
    for step in range(30):  # 200 rows of one source are three batches of 64, 100 of the other one
        x, y = (np.array(v) for v in zip(*batches[0, step % 3], *batches[1, 0]))
        *sums, grad = network.gradient(net, x, y, "mse")
        want.append([sums[0] / 128, sums[1] / 768, sums[2] / 768])
        net = net.with_flat(adam.step(net.flat(), grad / 128))
    log = modelling.training_log(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [(r.epoch, r.steps) for r in log] == [(e, 3 * e) for e in range(1, 11)]
    assert np.allclose([[r.loss, r.mae, r.mse] for r in log], np.reshape(want, (10, 3, 3)).mean(axis=1), rtol=1e-6)
