"""Errors that add up over parts, and joins of bucketed tables."""

import numpy as np
import pytest

from gridspark.operators import error_state as es
from gridspark.operators import metrics as mt
from gridspark.operators.reshape import paste_features
from gridspark.runtime import scratch_path
from gridspark.sources import buckets as bk

PAIRS = "plevel INT, target DOUBLE, prediction DOUBLE"


def pairs_of(spark, rng, levels, n, shift=0.0):
    rows = [(int(lv), float(t), float(t + e)) for lv in levels
            for t, e in zip(rng.normal(shift, 1, n), rng.normal(0, 0.3, n))]
    return spark.createDataFrame(rows, PAIRS)


def by_level(df):
    return {r.plevel: r.asDict() for r in df.collect()}


def same(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for level, row in want.items():
        for name, value in row.items():
            assert got[level][name] == (value if value is None else pytest.approx(value, rel=tol, abs=1e-12)), name


def test_merged_parts_equal_one_pass(spark):
    """Parts of unlike sizes and levels, far from zero, merged at once, in two steps, and after a repeat."""
    rng = np.random.default_rng(1)
    parts = [pairs_of(spark, rng, [0, 1], 50, 1e6), pairs_of(spark, rng, [1, 2], 7, 1e6 + 3),
             spark.createDataFrame([(3, 2.0, 2.5)], PAIRS)]
    path = scratch_path(spark, "parts")
    for number, part in enumerate(parts):
        es.keep_part(es.error_state(part), path, number)
    es.keep_part(es.error_state(parts[1]), path, 1)
    merged = es.all_parts(spark, path)
    whole = parts[0].union(parts[1]).union(parts[2])
    same(by_level(es.metrics_of(merged)), by_level(mt.level_metrics(whole)), 1e-7)
    same(by_level(es.lines_of(merged)), by_level(mt.level_regression(whole)), 1e-5)
    first = es.merge_states(es.error_state(parts[0]).union(es.error_state(parts[1])))
    twice = es.merge_states(first.union(es.error_state(parts[2])))
    same(by_level(twice), by_level(merged))


def test_states_of_missing_values_and_empty_tables(spark):
    rows = [(0, 1.0, 2.0), (0, None, 5.0), (0, 3.0, None), (None, 1.0, 1.5), (1, None, None), (2, 4.0, 4.0)]
    state = es.error_state(spark.createDataFrame(rows, PAIRS))
    got = by_level(es.metrics_of(es.merge_states(state.union(state))))
    assert {k: (v["n"], v["mae"]) for k, v in got.items()} == {0: (6, 1.0), None: (2, 0.5), 1: (2, None), 2: (2, 0.0)}
    assert all(v["r_squared"] == 0 for v in got.values())
    empty = es.merge_states(es.error_state(spark.createDataFrame([], PAIRS)))
    assert es.metrics_of(empty).count() == 0 and es.lines_of(empty).count() == 0
    assert es.all_parts(spark, scratch_path(spark, "none")) is None


def test_bucketed_tables_join_without_an_exchange(spark):
    shapes = {"features": range(0, 60), "gwfu": range(20, 90), "gwfv": [*range(10, 50), None]}
    tables = {n: spark.createDataFrame([(i, float(i or 0)) for i in ids], f"sample_id LONG, {n} DOUBLE")
              for n, ids in shapes.items()}
    names = {}
    for name, df in tables.items():
        path = scratch_path(spark, "buckets")
        names[name] = f"{name}_" + path.rsplit("-", 1)[-1]
        bk.write_bucketed(df.where("sample_id < 40 OR sample_id IS NULL"), names[name], path, 4)
        bk.write_bucketed(df.where("sample_id >= 40"), names[name], path, 4, mode="append")
    joined = bk.paste_bucketed(spark, names.values())
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
    assert sorted(joined.collect()) == sorted(paste_features(list(tables.values())).collect())
    assert joined.count() == 30


def test_buckets_are_a_power_of_two():
    assert [bk.buckets_for(n, 10) for n in (0, 10, 11, 20, 21, 41, 1000)] == [1, 1, 2, 2, 4, 8, 128]
