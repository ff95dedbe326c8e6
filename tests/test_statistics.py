"""Quantiles, outliers, histograms, summaries and metrics against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import histogram, metrics, outliers, reshape, stats
from gridspark.operators.quantiles import exact_quantiles
from gridspark.runtime import attach


def column(spark, xs, name="x"):
    return spark.createDataFrame([(float(x),) for x in xs], f"{name} DOUBLE")


def grouped(spark, groups):
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "g INT, x DOUBLE")


RNG = np.random.default_rng(5)
SERIES = {
    "normal": RNG.normal(size=999),
    "even": RNG.normal(size=1000),
    "heavy": np.exp(RNG.normal(scale=12, size=700)),
    "ties": np.repeat([1.0, 2.0, 2.5], [500, 1, 300]),
    "constant": np.full(200, 3.25),
    "two": np.array([1.0, 9.0]),
    "single": np.array([4.0]),
    "tiny": np.array([0.0, 5e-324, 1e-323, 1.5e-323] * 5),
    "wide": np.array([-1.7e308, -1.0, 0.0, 1.0, 1.7e308] * 3),
}


@pytest.mark.parametrize("name", sorted(SERIES))
@pytest.mark.parametrize("most, accuracy", [(1, 2), (10**6, 1000)])
def test_exact_quantiles(spark, name, most, accuracy):
    xs = SERIES[name]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    with np.errstate(over="ignore", invalid="ignore"):
        want = np.quantile(xs, probs)
    got = exact_quantiles(column(spark, xs), "x", probs, most=most, accuracy=accuracy).first()
    assert got.n == len(xs)
    # Between the smallest denormals an interpolated value may round either way.
    assert np.allclose(got.quantiles, want, rtol=1e-12, atol=5e-324)


@pytest.mark.parametrize("limit", [1, 10**6])
def test_exact_quantiles_with_infinities(spark, limit):
    xs = np.concatenate([np.full(3, -np.inf), RNG.normal(size=41), np.full(5, np.inf)])
    got = exact_quantiles(column(spark, xs), "x", [0.0, 0.25, 0.5, 1.0], most=limit, accuracy=2).first()
    assert np.allclose(got.quantiles, np.sort(xs)[[0, 12, 24, 48]])


@pytest.mark.parametrize("limit", [20, 10**6])
def test_exact_quantiles_by_group_ignore_nan(spark, limit):
    groups = {1: SERIES["normal"], 2: np.append(SERIES["ties"], [np.nan] * 40), 3: [7.0]}
    got = exact_quantiles(grouped(spark, groups), "x", [0.5, 0.75], ["g"], most=limit, accuracy=2).collect()
    assert {r.g for r in got} == {1, 2, 3}
    for r in got:
        assert np.allclose(r.quantiles, np.nanquantile(groups[r.g], [0.5, 0.75]))


def mad_flags(xs, thresh=3.5):
    dev = np.abs(xs - np.median(xs))
    return 0.6745 * dev > thresh * np.median(dev)


def test_outliers_match_the_definition(spark):
    xs = np.append(RNG.normal(size=300), [9.0, -12.0, 40.0])
    got = outliers.flag_outliers(column(spark, xs), "x").collect()
    want = dict(zip(xs, mad_flags(xs)))
    assert all(r.is_outlier == want[r.x] for r in got) and sum(want.values()) >= 3


def test_zero_mad_flags_every_other_value(spark):
    got = outliers.flag_outliers(column(spark, [5, 5, 5, 5, 6]), "x").collect()
    assert sorted((r.x, r.is_outlier) for r in got) == [(5.0, False)] * 4 + [(6.0, True)]


def test_nan_is_never_an_outlier(spark):
    got = outliers.flag_outliers(column(spark, [1, 2, 3, float("nan"), 900]), "x").collect()
    assert [r.is_outlier for r in got if np.isnan(r.x)] == [False]
    assert [r.is_outlier for r in got if r.x == 900] == [True]


def test_paired_outliers_look_at_survivors(spark):
    t = np.append(RNG.normal(size=200), [80.0, 0.1])
    p = np.append(RNG.normal(size=200), [0.0, 60.0])
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, p)],
                               "plevel INT, target DOUBLE, prediction DOUBLE")
    first = ~mad_flags(t)
    t1, p1 = t[first], p[first]
    want = sorted(zip(t1[~mad_flags(p1)], p1[~mad_flags(p1)]))
    got = outliers.remove_paired_outliers(df).collect()
    assert sorted((r.target, r.prediction) for r in got) == want


def test_vector_outliers(spark):
    xs = RNG.normal(size=(200, 3))
    xs[7] += 50
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "i INT, v ARRAY<DOUBLE>")
    dist = np.sqrt(((xs - np.median(xs, axis=0)) ** 2).sum(axis=1))
    want = 0.6745 * dist > 3.5 * np.median(dist - 0)
    got = outliers.flag_vector_outliers(df, "v").collect()
    # Distances are all positive, so their median is the deviation used.
    assert {r.i: r.is_outlier for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("xs", [SERIES["normal"], SERIES["ties"], SERIES["constant"], SERIES["single"]])
def test_histogram_matches_numpy(spark, xs):
    rows = histogram.histogram(column(spark, xs), "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(xs, 10)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r.lo for r in rows], edges[:-1]) and np.allclose([r.hi for r in rows], edges[1:])
    assert np.isclose(sum(r.density * (r.hi - r.lo) for r in rows), 1.0)


def test_histogram_of_nothing_is_empty(spark):
    assert histogram.histogram(column(spark, []), "x").count() == 0


def test_normalised_histogram(spark):
    hist = histogram.histogram(column(spark, SERIES["normal"]), "x", 7)
    rows = histogram.normalise_histogram(hist).orderBy("bin").collect()
    n = np.histogram(SERIES["normal"], 7, density=True)[0]
    f = n / n.max()
    assert np.allclose([r.fraction for r in rows], f)
    assert np.allclose([r.norm for r in rows], (f - f.min()) / (f.max() - f.min()))


def test_box_statistics(spark):
    xs = np.append(RNG.normal(size=100), [30.0, -30.0])
    r = stats.box_stats(column(spark, xs), "x").first()
    q1, q2, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
    inside = xs[(xs >= q1 - 1.5 * (q3 - q1)) & (xs <= q3 + 1.5 * (q3 - q1))]
    assert np.allclose([r.q1, r.median, r.q3], [q1, q2, q3])
    assert (r.whisker_lo, r.whisker_hi) == (inside.min(), inside.max())
    assert r.fliers == len(xs) - len(inside)


def test_feature_summary_with_attributes(spark):
    cells = spark.createDataFrame(
        [(t, p, 0, x, float(t + p)) for t in range(2) for p in range(3) for x in range(4)],
        "time INT, plevel INT, lat INT, lon INT, temp DOUBLE")
    meta = spark.createDataFrame([("temp", "temperature", "deg_k", "[100, 400]")],
                                 "name STRING, long_name STRING, units STRING, valid_range STRING")
    r = stats.feature_summary(cells, ["temp"], meta).first()
    assert (r["shape"], r.units, r.mean, r["max"], r["min"]) == ("(2, 3, 1, 4)", "deg_k", 1.5, 3.0, 0.0)
    assert r.mean_text == "1.5e+00" and json.dumps(r.asDict())


def pairs(spark, target, prediction, level=0):
    rows = [(i, level, float(t), float(p)) for i, (t, p) in enumerate(zip(target, prediction))]
    return spark.createDataFrame(rows, "sample_id INT, plevel INT, target DOUBLE, prediction DOUBLE")


def test_constant_predictions_have_no_correlation(spark):
    df = pairs(spark, [1, 2, 3], [5, 5, 5])
    assert metrics.level_metrics(df).first().r_squared == 0.0
    r = metrics.level_regression(df).first()
    assert r.slope is None and r.intercept is None and r.r_value == 0.0


def test_regression_line(spark):
    x = RNG.normal(size=50)
    y = 3 * x + RNG.normal(size=50)
    r = metrics.level_regression(pairs(spark, y, x)).first()
    slope, intercept = np.polyfit(x, y, 1)
    left = y - slope * x - intercept
    stderr = np.sqrt((left**2).sum() / 48 / ((x - x.mean()) ** 2).sum())
    assert np.allclose([r.slope, r.intercept, r.stderr], [slope, intercept, stderr])
    assert np.isclose(r.r_value, np.corrcoef(x, y)[0, 1])
    assert 0 < r.p_value < 1e-10


@pytest.mark.parametrize("y,want", [([1.0, 3.0, 2.0], None), ([1.0, 2.0, 3.0], 0.0), ([1.0, 0.0, 1.0], 1.0)])
def test_p_value_of_three_points(spark, y, want):
    x = np.array([0.0, 1.0, 2.0])
    r = metrics.level_regression(pairs(spark, y, x)).first()
    if want is None:  # one degree of freedom has a closed form
        t = r.r_value * np.sqrt(1 / (1 - r.r_value**2))
        want = 1 - 2 / np.pi * np.arctan(abs(t))
    assert np.isclose(r.p_value, want, atol=1e-8)


def test_losses_and_composite(spark):
    df = pairs(spark, [1, 2], [0, 4], 0).union(pairs(spark, [1, 2], [0, 4], 20))
    by_level = {r.plevel: r.loss for r in metrics.composite_loss(df).collect()}
    assert by_level == {0: 2.5, 20: 1.5}
    total = metrics.total_losses(df).first()
    assert np.isclose(total.mse, 5.0) and np.isclose(total.mae, 3.0)
    assert np.isclose(total.log_cosh, 2 * np.mean(np.log(np.cosh([1, 2]))))


def test_value_limits(spark):
    df = spark.createDataFrame([(0, -3.0, 1.0), (0, 2.0, 2.5)], "g INT, a DOUBLE, b DOUBLE")
    assert tuple(stats.value_limits(df, ["a", "b"]).first()) == (-3.0, 2.5)
    r = stats.value_limits(df, ["a", "b"], True, 1.2, ["g"]).first()
    assert np.allclose([r.vmin, r.vmax], [-3.6, 3.6])


def test_missing_levels_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 2, 7.0)], "sample_id INT, plevel INT, v DOUBLE")
    with pytest.raises(Exception, match="levels are missing"):
        reshape.stack_levels(rows, ["v"]).collect()
    with pytest.raises(Exception, match="levels are missing"):
        reshape.to_columns(rows, ["v"], key=("sample_id",)).collect()
    whole = rows.where("plevel = 0")
    assert reshape.stack_levels(whole, ["v"]).first().v == [5.0]


def test_whiskers_do_not_end_inside_the_box(spark):
    r = stats.box_stats(column(spark, [0, 0, 0, 100]), "x").first()
    assert (r.whisker_lo, r.whisker_hi, r.q3, r.fliers) == (0.0, 25.0, 25.0, 1)


def test_wide_ranging_and_mostly_equal_values(spark):
    xs = np.concatenate([10.0 ** RNG.uniform(-300, 300, 1500), -(10.0 ** RNG.uniform(-300, 300, 1500)), np.zeros(4000)])
    got = exact_quantiles(column(spark, xs), "x", [0.05, 0.5, 0.95], most=1).first()
    assert np.allclose(got.quantiles, np.quantile(xs, [0.05, 0.5, 0.95]))


def test_shuffled_attach_equals_broadcast(spark, monkeypatch):
    df = grouped(spark, {1: range(100), 2: range(3)})
    state = df.groupBy("g").agg(F.avg("x").alias("m"))
    want = sorted(map(tuple, attach(df, state, ["g"]).select("g", "x", "m").collect()))
    monkeypatch.setattr("gridspark.runtime.BROADCAST_ROWS", 1)
    plain = attach(df, state, ["g"])
    assert "BROADCAST" not in plain._jdf.queryExecution().logical().toString().upper()
    assert sorted(map(tuple, plain.select("g", "x", "m").collect())) == want


def test_groups_without_numbers_and_null_groups_keep_their_rows(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 3.0), (1, 99.0), (2, float("nan")), (2, None), (None, 5.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g INT, x DOUBLE")
    got = outliers.flag_outliers(df, "x", ["g"]).collect()
    assert len(got) == len(rows)
    assert [(r.g, r.x) for r in got if r.is_outlier] == [(1, 99.0)]
    boxes = {r.g: r.median for r in stats.box_stats(df, "x", ["g"]).collect()}
    assert boxes == {1: 2.5, None: 5.0}
    bars = histogram.histogram(df, "x", 4, ["g"]).collect()
    assert {(g, sum(r["count"] for r in bars if r.g == g)) for g in (1, None)} == {(1, 4), (None, 2)}
    assert len(bars) == 8


@pytest.mark.parametrize("limit", [5, 10**6])
def test_one_group_with_most_rows(spark, limit):
    groups = {0: np.concatenate([RNG.normal(size=3000), np.full(2000, 0.5)]), 1: [1.0, 2.0], 2: [3.0]}
    got = exact_quantiles(grouped(spark, groups), "x", [0.1, 0.5], ["g"], most=limit, accuracy=2).collect()
    assert all(np.allclose(r.quantiles, np.quantile(groups[r.g], [0.1, 0.5])) for r in got) and len(got) == 3
