"""The commands one after the other on two small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import network
from gridspark.operators.training import Adam
from gridspark.plans import commands
from tests.netcdf import write_netcdf

T, P, LAT, LON = 30, 4, 2, 3
VARIABLES = ["temp", "ucomp", "gwfu_cgwd", "gwfv_cgwd"]
FEATURES = ["slp", "temp", "ucomp", "lat", "lon"]


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    rng, years = np.random.default_rng(8), []
    for y in (1, 2):
        axes = ("time", "level", "lat", "lon")
        data = {v: rng.normal(size=(T, P, LAT, LON)) for v in VARIABLES}
        data["gwfu_cgwd"] = 0.5 * data["ucomp"] + 0.1 * data["temp"]
        slp = rng.normal(size=(T, LAT, LON))
        write_netcdf(root / f"year{y}.nc", {"time": T, "level": P, "lat": LAT, "lon": LON}, {
            **{v: (axes, a, "f8", {"units": "1"}) for v, a in data.items()},
            "slp": (("time", "lat", "lon"), slp, "f8", {})}, unlimited="time")
        years.append({**data, "slp": slp})
    whole = {k: np.concatenate([y[k] for y in years]) for k in years[0]}
    return str(root), whole


def test_commands_end_to_end(spark, world):
    root, cube = world
    commands.ingest(spark, f"{root}/year*.nc", f"{root}/raw", VARIABLES, scatter_points=50)
    summary = {r.name: r for r in spark.read.json(f"{root}/raw/summary").collect()}
    assert np.isclose(summary["temp"]["mean"], cube["temp"].mean())
    assert (summary["temp"].units, summary["temp"].long_name, summary["slp"].units) == ("1", "", "")
    assert summary["slp"].shape == f"({2 * T}, {LAT}, {LON})" and np.isclose(summary["slp"]["max"], cube["slp"].max())
    assert all(float(summary[v].mean_text) == float(np.format_float_scientific(cube[v].mean(), precision=2))
               for v in ("temp", "slp"))
    assert spark.read.parquet(f"{root}/raw/scatter").count() == 50

    commands.extract(spark, f"{root}/raw", f"{root}/rows", LAT, LON, FEATURES, plevels=3, target_levels=2,
                     num_samples=300, seed=1)
    rows = spark.read.parquet(f"{root}/rows/samples").collect()
    assert len({r.sample_id for r in rows}) == 300 and sorted(r.pos for r in rows) == list(range(300))
    for r in rows[:40]:
        t, lat, lon = np.unravel_index(r.sample_id, (2 * T, LAT, LON))
        want = [cube["slp"][t, lat, lon], *cube["temp"][t, :3, lat, lon], *cube["ucomp"][t, :3, lat, lon], lat, lon]
        assert r.features == want and r.gwfu == cube["gwfu_cgwd"][t, :2, lat, lon].tolist()

    commands.extract(spark, f"{root}/year*.nc", f"{root}/direct", LAT, LON, FEATURES, plevels=3, target_levels=2,
                     num_samples=300, seed=1)
    direct = spark.read.parquet(f"{root}/direct/samples").collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, rows))

    commands.split(spark, f"{root}/rows", f"{root}/split", 0.1, 0.1, 100)
    split = spark.read.parquet(f"{root}/split/samples")
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {
        "train": 240, "val": 30, "test": 30}
    facts = {r.key: r.value for r in spark.read.parquet(f"{root}/split/metadata").collect()}
    assert facts["input_shape"] == 9 and facts["num_train_samples"] == 240
    state = spark.read.parquet(f"{root}/split/scaler/gwfu").collect()
    assert {r.n for r in state} == {240}

    commands.train(spark, [f"{root}/split"], f"{root}/split/scaler", f"{root}/model", batch_size=80,
                   trunk=(16,), head=None, loss="mse", optimizer=Adam(0.05), epochs=5, steps_per_epoch=3)
    log = spark.read.parquet(f"{root}/model/log").orderBy("epoch").collect()
    assert log[-1].loss < log[0].loss and log[0].val_loss is not None

    commands.evaluate(spark, f"{root}/rows", f"{root}/split/scaler", f"{root}/model", f"{root}/eval",
                      remove_outliers=3.5, bins=20, panels={1: "0.5 hPa"})
    panel = spark.read.parquet(f"{root}/eval/panels").first()
    assert panel.label == "0.5 hPa" and panel.hpa == 0.56 and panel.vmin == -panel.vmax
    assert spark.read.parquet(f"{root}/eval/r2_profile").count() == 2
    found = {r.plevel: r for r in spark.read.parquet(f"{root}/eval/level_metrics").collect()}
    assert set(found) == {0, 1} and found[0].r_squared > 0.5
    assert spark.read.parquet(f"{root}/eval/sample_metrics").count() == 300
    assert spark.read.parquet(f"{root}/eval/distributions").count() == 2 * 2 * 20

    commands.evaluate(spark, f"{root}/rows", f"{root}/split/scaler", f"{root}/model", f"{root}/random",
                      random_inputs=True, num_samples=200, bins=20)
    control = {r.plevel: r for r in spark.read.parquet(f"{root}/random/level_metrics").collect()}
    assert control[0].n == 200 and control[0].r_squared < found[0].r_squared

    commands.attribute(spark, f"{root}/rows", f"{root}/split/scaler", f"{root}/model", f"{root}/why", level=0,
                       background=50, test=60, n_permutations=4, k=3)
    top = spark.read.parquet(f"{root}/why/top").orderBy(F.desc("mean_abs")).collect()
    assert top[0].idx == 4  # ucomp on the top level drives the top output
    commands.attribute(spark, f"{root}/rows", f"{root}/split/scaler", f"{root}/model", f"{root}/why2", level=0,
                       background=50, test=60, n_permutations=4, k=3, along_path=True)
    assert spark.read.parquet(f"{root}/why2/top").orderBy(F.desc("mean_abs")).first().idx == 4

    ranks = commands.compare(spark, {("full", "gwfu"): f"{root}/eval", ("random", "gwfu"): f"{root}/random"},
                             f"{root}/compare")
    assert {(r.experiment, r["rank"]) for r in ranks.collect()} == {("full", 1), ("random", 2)}
    commands.compare(spark, {("full_features", "gwfu"): f"{root}/eval", ("full_features", "gwfv"): f"{root}/random"},
                     f"{root}/compare2")
    matrix = {r.plevel: r for r in spark.read.parquet(f"{root}/compare2/matrix").collect()}
    assert set(matrix) == {0, 1} and np.isclose(matrix[0].gwfu, found[0].r_squared)
    boxes = spark.read.parquet(f"{root}/compare2/box").collect()
    assert {(r.experiment, r.target) for r in boxes} == {("full_features", "gwfu"), ("full_features", "gwfv")}
    assert all(r.whisker_lo <= r.q1 <= r.median <= r.q3 <= r.whisker_hi for r in boxes)

    commands.train(spark, [f"{root}/split"], f"{root}/split/scaler", f"{root}/control", batch_size=10, trunk=(4,),
                   head=None, loss="mse", optimizer=Adam(0.05), epochs=2, steps_per_epoch=2, random_inputs=True,
                   validation_steps=1)
    log2 = spark.read.parquet(f"{root}/control/log").collect()
    assert len(log2) == 2 and all(r.val_loss is not None for r in log2)

    commands.profiles(spark, f"{root}/eval/scored", [f"{root}/eval/scored"], f"{root}/climate", LAT, LON, lat=1, window=10)
    lines = spark.read.parquet(f"{root}/climate/profiles").collect()
    assert lines and all(np.isclose(r.difference, r.target - r.prediction) for r in lines)
    assert network.from_table(spark.read.parquet(f"{root}/model/weights")).trunk[0].shape == (10, 16)
