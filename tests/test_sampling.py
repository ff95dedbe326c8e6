"""Positions, samples, splits, batches and scalers."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.operators import index, scaler, split


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "sample_id")


def test_shuffle_is_a_permutation(spark):
    rows = index.shuffle_rank(ids(spark, 500), 1).collect()
    assert sorted(r.pos for r in rows) == list(range(500))
    again = index.shuffle_rank(ids(spark, 500).repartition(7), 1).collect()
    assert {r.sample_id: r.pos for r in rows} == {r.sample_id: r.pos for r in again}
    other = index.shuffle_rank(ids(spark, 500), 2).collect()
    assert {r.sample_id: r.pos for r in rows} != {r.sample_id: r.pos for r in other}


def test_shuffle_inside_groups(spark):
    df = ids(spark, 300).withColumn("source", F.when(F.col("sample_id") < 250, "a").otherwise("b"))
    rows = index.shuffle_rank(df, 1, by=["source"]).collect()
    for source, n in (("a", 250), ("b", 50)):
        assert sorted(r.pos for r in rows if r.source == source) == list(range(n))


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (37, 37), (100, 100), (1000, 100), (None, 100)])
def test_sample_sizes(spark, n, want):
    got = [r.sample_id for r in index.sample_exact(ids(spark, 100), n, 3).collect()]
    assert len(got) == len(set(got)) == want


def test_sample_is_the_head_of_the_shuffle(spark):
    sample = {r.sample_id for r in index.sample_exact(ids(spark, 400), 60, 9).collect()}
    ranked = index.shuffle_rank(ids(spark, 400), 9)
    assert sample == {r.sample_id for r in ranked.where("pos < 60").collect()}


def test_sample_by_ids_keeps_all_rows_of_drawn_ids(spark):
    rows = ids(spark, 200).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(2))))
    drawn = {r.sample_id for r in index.sample_exact(ids(spark, 200), 30, 4).collect()}
    got = index.sample_by_ids(rows, ids(spark, 200), 30, 4).collect()
    assert len(got) == 90 and {r.sample_id for r in got} == drawn
    assert index.sample_by_ids(rows, ids(spark, 200), None, 4).count() == 600


def test_global_index_follows_the_order_with_ties(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(1000)], "k INT, v INT").repartition(9)
    rows = index.global_index(df, ["k"]).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    exact = index.global_index(df, [F.col("v").desc()]).collect()
    assert all(r.pos == 999 - r.v for r in exact)


def chunk_counts(spark, n, *args, **kwargs):
    df = ids(spark, n).withColumn("pos", F.col("sample_id"))
    return Counter(r.split for r in split.chunked_split(df, n, *args, **kwargs).collect())


def test_chunks_go_whole_to_the_split_they_start_in(spark):
    assert split.split_sizes(1010, 0.1, 0.05) == (859, 50, 101)
    assert chunk_counts(spark, 1010, 0.1, 0.05, 100_000) == {"train": 900, "val": 50, "test": 60}
    assert chunk_counts(spark, 1010, 0.1, 0.05, 100_000, exact=True) == {"train": 859, "val": 50, "test": 101}


def test_split_without_test_rows(spark):
    assert chunk_counts(spark, 100, 0.0, 0.0, 30) == {"train": 100}
    assert chunk_counts(spark, 100, 0.0, 0.2, 30) == {"train": 80, "val": 20}


def test_skipped_labels_stay_on_test_rows(spark):
    df = ids(spark, 100).withColumn("pos", F.col("sample_id")).withColumn("gwfu", F.lit(1.0))
    rows = split.chunked_split(df, 100, 0.2, 0.1, 10, skip_labels=True, targets=("gwfu",)).collect()
    assert all((r.gwfu is not None) == (r.split == "test") for r in rows)


def test_tail_split_and_subsample(spark):
    df = ids(spark, 100).withColumn("pos", F.col("sample_id"))
    tail = split.tail_split(df, 100, 0.2).where("split = 'val'").collect()
    assert sorted(r.pos for r in tail) == list(range(80, 100))
    assert split.eval_subsample(df, 7, 10).count() == 7
    assert split.eval_subsample(df, 25, 10).count() == 30
    assert split.eval_subsample(df, 1000, 10).count() == 100
    roles = split.attribution_split(df, 20, 30).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in roles} == {"background": 20, "test": 30}


def sources(spark, sizes):
    rows = [(s, i, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source STRING, i INT, sample_id STRING")


def test_batches_take_the_same_from_each_source(spark):
    rows = split.minibatches(sources(spark, {"a": 95, "b": 40}), 10, 30, 1).collect()
    per = Counter((r.source, r.batch_id) for r in rows)
    assert set(per.values()) == {5}
    # 95 rows: three chunks of 30 give 6 batches each, the rest of 5 gives one.
    assert {b for s, b in per if s == "a"} == set(range(19))
    assert {b for s, b in per if s == "b"} == set(range(8))
    assert len({r.sample_id for r in rows}) == len(rows)


def test_short_chunks_drop_their_rest(spark):
    rows = split.minibatches(sources(spark, {"a": 33}), 10, 16, 1).collect()
    assert Counter(r.batch_id for r in rows) == {0: 10, 1: 10}


def test_exhausted_sources_start_again(spark):
    rows = split.minibatches(sources(spark, {"a": 40, "b": 15}), 10, 100, 1, steps=8).collect()
    per = Counter((r.source, r.batch_id) for r in rows)
    assert per == {(s, b): 5 for s in "ab" for b in range(8)}
    repeat = [{r.sample_id for r in rows if r.source == "b" and r.batch_id == b} for b in (0, 3, 6)]
    assert repeat[0] == repeat[1] == repeat[2]


def test_batches_per_epoch():
    assert split.batches_per_epoch(1000, 256) == 3


def vectors(spark, xs, col="v"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)],
                                 f"sample_id INT, {col} ARRAY<DOUBLE>")


XS = np.random.default_rng(2).normal(5, 3, size=(200, 4))


def state_of(df):
    return {r.idx: (r.n, r.mean, r.m2) for r in df.collect()}


def test_scaler_uses_population_variance(spark):
    got = state_of(scaler.scaler_fit(vectors(spark, XS), "v"))
    for i in range(4):
        assert np.allclose(got[i], (200, XS[:, i].mean(), XS[:, i].var() * 200))


def test_scaler_ignores_nan(spark):
    xs = XS.copy()
    xs[::7, 2] = np.nan
    n, mean, _ = state_of(scaler.scaler_fit(vectors(spark, xs), "v"))[2]
    assert n == (~np.isnan(xs[:, 2])).sum() and np.isclose(mean, np.nanmean(xs[:, 2]))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 199), min_size=1, max_size=3, unique=True))
def test_any_chunking_merges_to_one_fit(spark, cuts):
    parts = np.split(XS, sorted(cuts))
    state = scaler.scaler_fit(vectors(spark, parts[0]), "v")
    for part in parts[1:]:
        state = scaler.scaler_merge(state, scaler.scaler_fit(vectors(spark, part), "v"))
    whole = state_of(scaler.scaler_fit(vectors(spark, XS), "v"))
    got = state_of(state)
    assert all(np.allclose(got[i], whole[i], rtol=1e-9) for i in whole)


def test_inverse_undoes_transform(spark):
    df = vectors(spark, XS)
    state = scaler.scaler_fit(df, "v")
    scaled = scaler.scaler_transform(df, state, "v")
    z = np.array([r.v for r in scaled.orderBy("sample_id").collect()])
    assert np.allclose(z, (XS - XS.mean(axis=0)) / XS.std(axis=0))
    back = np.array([r.v for r in scaler.scaler_inverse(scaled, state, "v").orderBy("sample_id").collect()])
    assert np.allclose(back, XS, atol=1e-9)


def test_constant_elements_keep_scale_one(spark):
    df = vectors(spark, [[2.0, 1.0], [2.0, 3.0]])
    got = scaler.scaler_transform(df, scaler.scaler_fit(df, "v"), "v").orderBy("sample_id").collect()
    assert [r.v for r in got] == [[0.0, -1.0], [0.0, 1.0]]
