import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark import functions as fn


def one(spark, *cols, **values):
    row = spark.createDataFrame([values])
    return row.select(*cols).first()


def test_ravel_and_unravel_are_inverse(spark):
    ids = spark.range(0, 3 * 4 * 5).withColumnRenamed("id", "sample_id")
    where = fn.unravel_index("sample_id", 4, 5)
    back = ids.select("sample_id", *[c.alias(n) for n, c in where.items()])
    rows = back.withColumn("again", fn.ravel_index("time", "lat", "lon", 4, 5)).collect()
    for r in rows:
        assert r.again == r.sample_id
        assert (r.time, r.lat, r.lon) == np.unravel_index(r.sample_id, (3, 4, 5))


def test_ravel_is_exact_beyond_double_precision(spark):
    big = 2**60 + 1
    where = fn.unravel_index("sample_id", 1000, 10**9)
    df = spark.createDataFrame([(big,)], "sample_id BIGINT")
    r = df.select(*[c.alias(n) for n, c in where.items()]).withColumn(
        "again", fn.ravel_index("time", "lat", "lon", 1000, 10**9)).first()
    assert r.again == big


def test_midpoint_norm_interpolates_and_clamps(spark):
    xs = [-5.0, -2.0, -1.0, 0.0, 3.0, 6.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = [r[0] for r in df.select(fn.midpoint_norm("x", -2, 0, 6)).collect()]
    assert np.allclose(got, np.interp(xs, [-2, 0, 6], [0, 0.5, 1]))


def test_log_cosh_survives_large_errors(spark):
    got = one(spark, fn.log_cosh("a").alias("a"), fn.log_cosh("b").alias("b"), a=800.0, b=-0.3)
    assert np.isclose(got.a, 800 - np.log(2)) and np.isclose(got.b, np.log(np.cosh(0.3)))


def test_scientific_text(spark):
    xs = [1.5, 1.0, 123456.0, 63.65, 0.0, -27.15, 1e100]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = [r[0] for r in df.select(fn.scientific("x")).collect()]
    assert got == ["1.5e+00", "1.e+00", "1.23e+05", "6.36e+01", "0.e+00", "-2.71e+01", "1.e+100"]


def test_minmax_norm_of_an_empty_range_is_zero(spark):
    assert one(spark, fn.minmax_norm("x", "x", "x").alias("n"), x=4.0).n == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=9))
def test_vector_statistics(spark, xs):
    df = spark.createDataFrame([(xs,)], "v ARRAY<DOUBLE>")
    got = df.select(fn.vector_mean("v"), fn.vector_std("v"), fn.vector_median("v")).first()
    assert np.allclose(list(got), [np.mean(xs), np.std(xs), np.median(xs)], atol=1e-6)


def test_hash_normal_does_not_depend_on_partitioning(spark):
    ids = spark.range(4000)
    one_part = ids.coalesce(1).select("id", fn.hash_normal(3, "id", 5).alias("v"))
    many = ids.repartition(16).select("id", fn.hash_normal(3, "id", 5).alias("v"))
    a, b = (np.array([r.v for r in d.orderBy("id").collect()]) for d in (one_part, many))
    assert (a == b).all()
    assert abs(a.mean()) < 0.02 and abs(a.std() - 1) < 0.02
    assert np.abs(np.corrcoef(a.T) - np.eye(5)).max() < 0.06


def test_labels(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "time INT, plevel INT, lat INT, lon INT")
    got = df.select(fn.cell_label("temp"), fn.surface_label("slp")).first()
    assert list(got) == ["temp_1_2_3_4", "slp_1_3_4"]


def test_number_check_excludes_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x DOUBLE")
    assert df.where(fn.is_number(F.col("x"))).count() == 1


def test_student_probability(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (1.0, 1.0), (-3.0, 2.0), (1.96, 1e6), (60.0, 3.0)],
                               "t DOUBLE, f DOUBLE")
    got = [r[0] for r in df.select(fn.t_two_sided("t", "f")).collect()]
    angle = np.arctan(60 / np.sqrt(3))  # closed forms for 1, 2 and 3 degrees of freedom
    three = 1 - 2 / np.pi * (angle + np.sin(angle) * np.cos(angle))
    want = [0.0733880348, 1.0, 0.5, 1 - 3 / np.sqrt(11), 0.0499958, three]
    assert np.allclose(got, want, rtol=1e-5)


def test_student_probability_against_the_density(spark):
    pairs = [(t, f) for f in (3.0, 7.0, 29.0, 250.0, 5e4) for t in (0.3, 1.1, 2.7, 4.2)]
    got = [r[0] for r in spark.createDataFrame(pairs, "t DOUBLE, f DOUBLE").select(fn.t_two_sided("t", "f")).collect()]
    for (t, f), p in zip(pairs, got):
        xs = np.linspace(0, t, 20001)
        density = (1 + xs * xs / f) ** (-(f + 1) / 2)
        # The density's constant, from its integral over everything (x = sqrt(f) tan u).
        u = np.linspace(0, np.pi / 2, 400001)
        whole = np.sqrt(f) * np.trapezoid(np.cos(u) ** (f - 1), u)
        assert np.isclose(p, 1 - np.trapezoid(density, xs) / whole, rtol=1e-6, atol=1e-9)


def test_student_probability_of_very_many_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1.96, 1e10), (-1.0, 1e300), (0.5, float("nan")), (1.0, 0.0)], "t DOUBLE, f DOUBLE")
    got = [r[0] for r in df.select(fn.t_two_sided("t", "f")).collect()]
    assert np.allclose(got[:2], [0.04999579, 0.31731051], rtol=1e-7) and got[2:] == [None, None]
