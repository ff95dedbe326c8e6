"""Reshaping, zonal means, frames and lag stacks against arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import lags, reshape
from gridspark.operators import profiles as pf

CUBE = np.random.default_rng(1).normal(size=(47, 3, 2, 4))


def cells_of(spark, cube, col="u"):
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(cube) for at in [at]]
    return spark.createDataFrame(rows, f"time INT, plevel INT, lat INT, lon INT, {col} DOUBLE")


@pytest.fixture(scope="module")
def cells(spark):
    return cells_of(spark, CUBE).cache()


def test_columns_hold_levels_in_order(spark, cells):
    rows = reshape.to_columns(cells.repartition(5), ["u"], plevels=2).collect()
    assert len(rows) == 47 * 2 * 4
    assert all(r.u == CUBE[r.time, :2, r.lat, r.lon].tolist() for r in rows)
    dense = reshape.to_dense_columns(cells.where("plevel != 1"), ["u"], 3).first()
    assert dense.u[1] == 0.0 and dense.u[2] == CUBE[dense.time, 2, dense.lat, dense.lon]


def test_vectors_return_to_cells(spark, cells):
    columns = reshape.to_columns(cells, ["u"])
    by_id = columns.selectExpr("(time * 2 + lat) * 4 + lon as sample_id", "u").orderBy(F.rand(3))
    back = reshape.vectors_to_cells(by_id, ["u"], 2, 4).collect()
    assert len(back) == CUBE.size
    assert all(r.u == CUBE[r.time, r.plevel, r.lat, r.lon] for r in back)


def test_subset_takes_whole_blocks(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "features ARRAY<DOUBLE>")
    layout = reshape.feature_layout(["u", "v", "t"], ["slp"], 2)
    got = reshape.feature_subset(df, ["t", "slp", "u"], layout).first().features
    assert got == [4.0, 5.0, 6.0, 0.0, 1.0]


def test_feature_names(spark):
    levels = reshape.levels_table(spark, 12, 15)
    got = {(r.feature, r.plevel): r.name for r in reshape.feature_names(levels, ["u", "v"]).collect()}
    assert got[("u", 12)] == "u 1" and got[("v", 14)] == "v -1" and len(got) == 6


def test_zip_join_keeps_common_ids(spark):
    a, b, c = (spark.createDataFrame([(i, 1.0) for i in ids], f"sample_id INT, {n} DOUBLE")
               for n, ids in (("x", [1, 2, 3]), ("y", [2, 3, 4]), ("z", [3, 2, 9])))
    assert sorted(r.sample_id for r in reshape.zip_join(a, b, c).collect()) == [2, 3]


@pytest.mark.parametrize("drop_last", [True, False])
def test_zonal_mean(spark, cells, drop_last):
    got = {(r.window, r.plevel): (r["mean"], r.month)
           for r in pf.zonal_mean(cells, "u", 1, window=10, drop_last=drop_last, lo=1, hi=3).collect()}
    assert set(got) == {(w, p) for w in range(5) for p in (1, 2)}
    for (w, p), (mean, month) in got.items():
        steps = CUBE[w * 10:w * 10 + (9 if drop_last else 10), p, 1, :]
        assert np.isclose(mean, steps.mean(axis=0).mean()) and month == w / 2


def test_frames_drop_an_incomplete_last_one(spark, cells):
    got = pf.tendency_frames(cells, "u", 0, duration=15, lo=1, hi=3).collect()
    assert {r.frame for r in got} == {0, 1, 2} and len(got) == 3 * 2 * 4
    for r in got:
        assert np.isclose(r["mean"], CUBE[r.frame * 15:r.frame * 15 + 15, r.plevel, 0, r.lon].mean())


def test_years_follow_each_other(spark, cells):
    both = pf.concat_years([cells, cells.withColumn("u", F.col("u") + 1)], 47)
    assert both.agg(F.max("time"), F.count("*")).first() == (93, 2 * CUBE.size)


def test_profile_difference(spark, cells):
    other = cells.withColumn("u", F.col("u") * 0.5)
    rows = pf.profile_difference(cells, other, col="u", lat=0, window=10).collect()
    assert len(rows) == 15
    assert all(np.isclose(r.difference, r.target / 2) for r in rows)


@pytest.mark.parametrize("step,start,num,block", [(1, 1, 3, None), (3, 2, 4, None), (2, 0, 5, 11), (1, 1, 12, 12)])
def test_lag_stack(spark, cells, step, start, num, block):
    columns = reshape.to_columns(cells, ["u"])
    got = lags.lag_stack(columns, "u", step, start, num, block=block).collect()
    reach = start + (num - 1) * step
    assert len(got) == (47 - reach) * 8
    for r in got:
        assert r.lags == [CUBE[r.time - start - k * step, :, r.lat, r.lon].tolist() for k in range(num)]


def test_lag_stack_drops_rows_with_gaps_in_their_past(spark, cells):
    columns = reshape.to_columns(cells.where("time != 20"), ["u"])
    times = {r.time for r in lags.lag_stack(columns, "u", 1, 1, 3).collect()}
    assert times == set(range(3, 47)) - {20, 21, 22, 23}


def test_years_in_line_equals_tables_end_to_end(spark):
    rows = [(y, t, float(y * t)) for y in (2001, 2002, 2004) for t in (0, 5, 9)]
    table = spark.createDataFrame(rows, "year INT, time INT, u DOUBLE")
    line = pf.years_in_line(table, "year", 10)
    years = [table.where(F.col("year") == y) for y in range(2001, 2005)]
    assert sorted(line.collect()) == sorted(pf.concat_years(years, 10).collect())
    odd = spark.createDataFrame([(None, 3, 1.0), (2000, 3, 1.0)], "year INT, time INT, u DOUBLE")
    assert {r.year: r.time for r in pf.years_in_line(odd, "year", 10).collect()} == {None: None, 2000: 3}
    assert pf.years_in_line(odd.limit(0), "year", 10).count() == 0
