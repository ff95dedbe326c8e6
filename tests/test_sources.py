"""netCDF loading, file round trips and metadata."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators.profiles import sources_in_line
from gridspark.sources import grid, tables
from tests.netcdf import write_netcdf

DIMS = {"time": 5, "level": 3, "lat": 2, "lon": 4}
AXES = ("time", "level", "lat", "lon")
RNG = np.random.default_rng(0)


def year(path, unlimited=None, wide=False, shift=0.0):
    cube = RNG.normal(size=(5, 3, 2, 4)) + shift
    whole = RNG.integers(-99, 99, size=(5, 3, 2, 4))
    low = RNG.normal(size=(5, 2, 4))
    write_netcdf(path, DIMS, {
        "temp": (AXES, cube, "f8", {"long_name": "temperature", "units": "deg_k", "valid_range": [100.0, 400.0]}),
        "ucomp": (AXES, whole, "i2", {"long_name": "zonal wind", "units": "m/s"}),
        "slp": (("time", "lat", "lon"), low, "f4", {}),
        "level": (("level",), np.array([1.0, 10.0, 100.0]), "f8", {"units": "hPa"}),
    }, unlimited, wide)
    return cube, whole, low


@pytest.mark.parametrize("unlimited", [None, "time"])
@pytest.mark.parametrize("wide", [False, True])
def test_grid_load(spark, tmp_path, unlimited, wide):
    cube, whole, low = year(tmp_path / "a.nc", unlimited, wide)
    cells = grid.read_grid(spark, str(tmp_path / "*.nc"), ["temp", "ucomp"], steps=2)
    assert cells.rdd.getNumPartitions() == 3
    rows = cells.collect()
    assert len(rows) == cube.size
    for r in rows:
        at = (r.time, r.plevel, r.lat, r.lon)
        assert r.temp == cube[at] and r.ucomp == whole[at] and r.source == "a.nc"
    surface = grid.read_grid(spark, str(tmp_path / "a.nc"), ["slp"]).collect()
    assert len(surface) == low.size
    assert all(r.slp == np.float32(low[r.time, r.lat, r.lon]) for r in surface)
    levels = grid.read_levels(spark, str(tmp_path / "a.nc")).orderBy("plevel").collect()
    assert [(r.plevel, r.hpa) for r in levels] == [(0, 1.0), (1, 10.0), (2, 100.0)]


@pytest.mark.parametrize("kind, shape", [("i2", (7, 1, 3)), ("i2", (5, 2, 2)), ("f4", (4, 3, 1))])
def test_a_single_record_variable_is_not_padded(spark, tmp_path, kind, shape):
    data = np.arange(np.prod(shape)).reshape(shape)
    write_netcdf(tmp_path / "one.nc", dict(zip(("time", "lat", "lon"), shape)),
                 {"slp": (("time", "lat", "lon"), data, kind, {})}, unlimited="time")
    rows = grid.read_grid(spark, str(tmp_path / "one.nc"), ["slp"], steps=2).collect()
    assert len(rows) == data.size and all(r.slp == data[r.time, r.lat, r.lon] for r in rows)


@pytest.mark.parametrize("unlimited", [None, "time"])
def test_columns_load_without_a_shuffle(spark, tmp_path, unlimited):
    cube, whole, low = year(tmp_path / "a.nc", unlimited)
    columns = grid.read_columns(spark, str(tmp_path / "a.nc"), ["temp", "slp", "ucomp"], steps=2)
    assert "Exchange" not in columns._jdf.queryExecution().toString()
    rows = columns.collect()
    assert len(rows) == low.size
    for r in rows:
        at = (r.time, slice(None), r.lat, r.lon)
        assert r.temp == cube[at].tolist() and r.ucomp == whole[at].tolist()
        assert r.slp == np.float32(low[r.time, r.lat, r.lon])


def test_attributes_and_refusals(spark, tmp_path):
    year(tmp_path / "a.nc")
    rows = {r.name: r for r in grid.read_variables(spark, str(tmp_path / "a.nc")).collect()}
    assert rows["temp"].long_name == "temperature" and rows["temp"].valid_range == "[100.0, 400.0]"
    assert rows["slp"].units == ""
    (tmp_path / "b.txt").write_text("no grid")
    with pytest.raises(Exception, match="not a netCDF-3 file"):
        grid.read_grid(spark, str(tmp_path / "b.txt"), ["temp"]).count()


def test_several_files_in_line(spark, tmp_path):
    one, *_ = year(tmp_path / "y1.nc")
    two, *_ = year(tmp_path / "y2.nc", shift=100.0)
    files = str(tmp_path / "y*.nc")
    both = np.concatenate([one, two])
    apart = grid.read_grid(spark, files, ["temp"], steps=3)
    for cells in (sources_in_line(apart), grid.read_grid(spark, files, ["temp"], steps=3, in_line=True)):
        rows = cells.collect()
        assert len(rows) == both.size
        assert all(r.temp == both[r.time, r.plevel, r.lat, r.lon] for r in rows)
    assert grid.count_columns(files, "temp") == 10 * 2 * 4


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("key", ["sample_id", None])
def test_vectors_csv_round_trip(spark, tmp_path, header, key):
    xs = RNG.normal(size=(20, 12)) * 1e-7
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)],
                               "sample_id BIGINT, features ARRAY<DOUBLE>")
    path = str(tmp_path / "csv")
    for _ in range(2):  # overwriting leaves one copy
        tables.write_vectors_csv(df, path, "features", 12, header, key)
    back = tables.read_vectors_csv(spark, path, 12, header, key).collect()
    assert sorted(r.features for r in back) == sorted(x.tolist() for x in xs)
    tables.write_vectors_csv(df, path, "features", 12, header, key, mode="append")
    assert tables.read_vectors_csv(spark, path, 12, header, key).count() == 40


@pytest.mark.parametrize("regroup", [True, False])
def test_cube_store_prunes_years(spark, tmp_path, regroup):
    df = spark.range(1000).selectExpr("cast(id % 4 as int) as year", "cast(id div 4 as int) as time",
                                      "0 as plevel", "cast(id as double) as temp")
    tables.write_cube(df, str(tmp_path / "cube"), regroup=regroup)
    back = tables.read_cube(spark, str(tmp_path / "cube"))
    assert sorted(back.select("temp").collect()) == sorted(df.select("temp").collect())
    plan = back.where("year = 2 and plevel < 3").select("temp")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "LessThan(plevel,3)" in plan


def test_input_width():
    default = ["temp", "hght", "ucomp", "vcomp", "omega", "slp", "lat", "lon"]
    assert tables.input_width(default, 40) == 203
    assert tables.input_width(["ucomp"], 33) == 33


def test_newer_metadata_wins(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "key STRING, value BIGINT, version INT")
    new = tables.metadata_of(spark.range(1).selectExpr("7 as b", "8 as c"), 1)
    got = {r.key: r.value for r in tables.merge_metadata(old, new).collect()}
    assert got == {"a": 1, "b": 7, "c": 8}
    facts = tables.dataset_metadata(spark.range(50), ["ucomp", "slp"], 10, 3).collect()
    assert {r.key: r.value for r in facts} == {"total_samples": 50, "input_shape": 11, "output_shape": 3}


def test_summary_json(spark, tmp_path):
    df = spark.createDataFrame([("temp", 1.5)], "name STRING, mean DOUBLE")
    tables.write_summary_json(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).select("name", F.col("mean")).first() == ("temp", 1.5)


class Counting:
    """A file that counts the bytes read from it."""

    def __init__(self, f, seen):
        self.f, self.seen = f, seen

    def read(self, n):
        self.seen.append(n)
        return self.f.read(n)

    def seek(self, at):
        self.f.seek(at)

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.f.close()


@pytest.mark.parametrize("unlimited", [None, "time"])
@pytest.mark.parametrize("kind", [grid.GridReader, grid.ColumnReader])
def test_conditions_become_byte_ranges(spark, tmp_path, monkeypatch, unlimited, kind):
    cube, _, _ = year(tmp_path / "a.nc", unlimited)
    monkeypatch.setattr(grid, "GAP_BYTES", 0)
    reader = kind([str(tmp_path / "a.nc")], ["temp"], 2, False, {"lat": 1, "time": {"from": 3}, "lon": [0, 1]})
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(2, 4), (4, 5)]
    seen, plain = [], grid.open_input
    monkeypatch.setattr(grid, "variables_of", lambda path, known=grid.variables_of(str(tmp_path / "a.nc")): known)
    monkeypatch.setattr(grid, "open_input", lambda path: Counting(plain(path), seen))
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sum(seen) == 2 * 3 * 2 * 8   # two steps, three levels, two longitudes of one latitude
    if kind is grid.GridReader:
        assert {(r["time"], r["plevel"], r["lat"], r["lon"]): r["temp"] for r in rows} == {
            (t, p, 1, x): cube[t, p, 1, x] for t in (3, 4) for p in range(3) for x in (0, 1)}
    else:
        assert {(r["time"], r["lat"], r["lon"]): r["temp"] for r in rows} == {
            (t, 1, x): cube[t, :, 1, x].tolist() for t in (3, 4) for x in (0, 1)}


@pytest.mark.parametrize("where, condition", [
    ({"lat": 1, "time": {"from": 4, "to": 7}}, "lat = 1 and time >= 4 and time < 7"),
    ({"plevel": [0, 2], "lon": {"to": 3}}, "plevel in (0, 2) and lon < 3"),
    ({"lat": 99}, "lat = 99"), ({"time": [0, 9]}, "time in (0, 9)"), ({}, "true")])
def test_where_gives_what_a_filter_gives(spark, tmp_path, where, condition):
    year(tmp_path / "y1.nc")
    year(tmp_path / "y2.nc", "time", True)
    path = f"file://{tmp_path}/*.nc"
    for read, names in ((grid.read_grid, ["temp", "ucomp"]), (grid.read_columns, ["temp", "slp"])):
        if read is grid.read_columns and "plevel" in where:
            with pytest.raises(Exception, match="no condition"):
                read(spark, path, names, where=where).count()
            continue
        whole = read(spark, path, names, steps=2, in_line=True)
        got = read(spark, path, names, steps=2, in_line=True, where=where)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.where(condition).collect()))
        # Two selections of one table do not mix.
        both = whole.where("lat = 0").select("lat").unionAll(whole.where("lat = 1 and lon = 2").select("lat"))
        assert both.where("lat = 0").count() == 4 * both.where("lat = 1").count()


def test_files_that_appear_are_streamed_once(spark, tmp_path):
    from gridspark.streaming import jobs
    (tmp_path / "in").mkdir()
    cubes = [year(tmp_path / "in" / "y1.nc")[0]]

    def run():
        stream = grid.stream_columns(spark, str(tmp_path / "in" / "*.nc"), ["temp"], steps=2, in_line=True)
        jobs.stream_scaler(stream, "temp", str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
        return {r.idx: (r.n, r.mean) for r in jobs.latest_state(spark, str(tmp_path / "state")).collect()}

    for name in ("y2.nc", "y3.nc", None):
        whole = np.concatenate(cubes)
        got = run()
        assert all(got[p][0] == whole[:, p].size and np.isclose(got[p][1], whole[:, p].mean()) for p in range(3))
        if name:
            cubes.append(year(tmp_path / "in" / name, "time", shift=5.0)[0])
    cells = grid.stream_grid(spark, str(tmp_path / "in" / "*.nc"), ["temp"], in_line=True)
    seen = []
    query = cells.select("time").writeStream.foreachBatch(lambda b, _: seen.extend(r.time for r in b.distinct().collect()))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == list(range(15))
