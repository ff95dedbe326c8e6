"""Scalar and vector column expressions, all JVM-side."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "ravel_index", "unravel_index", "shuffle_key", "key_bucket", "log_cosh", "midpoint_norm",
    "minmax_norm", "cell_label", "surface_label", "scientific", "scale_vector",
    "unscale_vector", "hash_normal", "vector_sum", "vector_mean", "vector_std",
    "vector_median", "is_number", "t_two_sided",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_number(c) -> Column:
    """Neither null nor NaN (NaN sorts above every number in Spark)."""
    return _col(c).isNotNull() & ~F.isnan(_col(c))


# --- coordinates -----------------------------------------------------------------------

def ravel_index(time, lat, lon, n_lat: int, n_lon: int) -> Column:
    """Row-major id of a vertical column."""
    row = _col(time).cast("bigint") * n_lat + _col(lat)
    return row * n_lon + _col(lon)


def unravel_index(sample_id, n_lat: int, n_lon: int) -> dict[str, Column]:
    """Inverse of :func:`ravel_index`, as columns by name."""
    sid = _col(sample_id)
    per_step = n_lat * n_lon
    return {
        "time": F.call_function("div", sid, F.lit(per_step)).cast("int"),
        "lat": F.call_function("div", F.pmod(sid, F.lit(per_step)), F.lit(n_lon)).cast("int"),
        "lon": F.pmod(sid, F.lit(n_lon)).cast("int"),
    }


def cell_label(feature: str, time="time", plevel="plevel", lat="lat", lon="lon") -> Column:
    return F.concat_ws("_", F.lit(feature), _col(time), _col(plevel), _col(lat), _col(lon))


def surface_label(feature: str, time="time", lat="lat", lon="lon") -> Column:
    return F.concat_ws("_", F.lit(feature), _col(time), _col(lat), _col(lon))


# --- seeded order ----------------------------------------------------------------------

def shuffle_key(seed, key) -> Column:
    """A hex key whose order is a seeded random permutation, equal in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def key_bucket(hex_key, digits: int) -> Column:
    """Leading hex digits as a number: buckets that follow the order of the key."""
    return F.conv(F.substring(_col(hex_key), 1, digits), 16, 10).cast("int")


def hash_normal(seed, key, width: int) -> Column:
    """A vector of ``width`` N(0, 1) draws fixed by (seed, key): Box-Muller on md5 bits."""
    key = _col(key).cast("string")

    def draw(i):
        bits = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), i.cast("string")))
        u = (F.conv(F.substring(bits, 1, 8), 16, 10).cast("double") + 1) / float(2**32)
        v = F.conv(F.substring(bits, 9, 8), 16, 10).cast("double") / float(2**32)
        return F.sqrt(F.log(u) * -2.0) * F.cos(v * (2 * math.pi))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), draw)


# --- arithmetic ------------------------------------------------------------------------

def log_cosh(d) -> Column:
    """ln(cosh(d)) without overflow for large |d|."""
    size = F.abs(_col(d))
    return size + F.log1p(F.exp(size * -2.0)) - math.log(2.0)


def midpoint_norm(value, vmin: float, midpoint: float, vmax: float) -> Column:
    """Piecewise-linear map of [vmin, midpoint, vmax] to [0, 0.5, 1], clamped at both ends."""
    v = _col(value)
    return (
        F.when(F.isnan(v), v)
        .when(v <= vmin, 0.0)
        .when(v >= vmax, 1.0)
        .when(v < midpoint, F.try_divide(v - vmin, F.lit(float(midpoint - vmin))) * 0.5)
        .otherwise(F.try_divide(v - midpoint, F.lit(float(vmax - midpoint))) * 0.5 + 0.5)
    )


def minmax_norm(value, lo, hi) -> Column:
    """(x - lo) / (hi - lo); 0 where the range is empty."""
    return F.coalesce(F.try_divide(_col(value) - _col(lo), _col(hi) - _col(lo)), F.lit(0.0))


def scientific(value, decimals: int = 2) -> Column:
    """Scientific text with at most ``decimals`` decimals: 1.5e+00, 1.e+00, 1.23e+05.

    The JVM's formatter rounds ties of the shortest digits up; the wanted text rounds the
    exact binary value, so the batch is formatted in Python. Meant for summary rows.
    """
    @F.pandas_udf("string")
    def text(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda x: np.format_float_scientific(x, precision=decimals), na_action=None)

    return text(_col(value).cast("double"))


def t_two_sided(t, df) -> Column:
    """Probability of |T| >= |t| for Student's t, by the incomplete beta's continued fraction.

    There is no such function in SQL; this runs on result rows, one per group. Null where
    the fraction does not converge.
    """
    lgamma = np.vectorize(math.lgamma, otypes=[float])

    def fraction(a, b, x):
        c, d = np.ones_like(x), 1.0 / (1.0 - (a + b) * x / (a + 1.0))
        value = d
        done = np.zeros(len(x), bool)
        for m in range(1, 2000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                         -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1.0 / (1.0 + step * d), 1.0 + step / c
                value = value * c * d
            done |= np.abs(c * d - 1.0) < 1e-14
            if done.all():
                break
        return np.where(done, value, np.nan)

    @F.pandas_udf("double")
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        t, n = ts.to_numpy(float), dfs.to_numpy(float)
        out = np.where(t == 0, 1.0, np.nan)
        use = (n > 0) & (t != 0) & ~np.isnan(t)
        t, n = t[use], n[use]
        # With so many degrees of freedom the normal limit is closer than rounding here.
        limit = n > 1e7
        n = np.where(limit, 1.0, n)
        x, y = n / (n + t * t), t * t / (n + t * t)
        a, b = n / 2, np.full_like(n, 0.5)
        scale = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log(y))
        near = x < (a + 1) / (a + b + 2)  # the fraction converges fast on this side
        part = scale * fraction(np.where(near, a, b), np.where(near, b, a), np.where(near, x, y))
        normal = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in t])
        out[use] = np.where(limit, normal, np.where(near, part / a, 1 - part / b))
        return pd.Series(out)

    found = run(_col(t).cast("double"), _col(df).cast("double"))
    return F.when(~F.isnan(found), found)


# --- vectors ---------------------------------------------------------------------------

def scale_vector(vector, mean, scale) -> Column:
    centred = F.zip_with(_col(vector), _col(mean), lambda x, m: x - m)
    return F.zip_with(centred, _col(scale), lambda x, s: x / s)


def unscale_vector(vector, mean, scale) -> Column:
    spread = F.zip_with(_col(vector), _col(scale), lambda x, s: x * s)
    return F.zip_with(spread, _col(mean), lambda x, m: x + m)


def vector_sum(vector) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0), lambda total, x: total + x)


def vector_mean(vector) -> Column:
    return F.try_divide(vector_sum(vector), F.size(_col(vector)))


def vector_std(vector) -> Column:
    """Population standard deviation; the mean is folded first, then the squares."""
    v = _col(vector)
    with_mean = F.transform(F.array(F.struct(v.alias("v"), vector_mean(v).alias("m"))), lambda s: F.sqrt(
        F.try_divide(
            F.aggregate(s["v"], F.lit(0.0), lambda acc, x: acc + (x - s["m"]) * (x - s["m"])),
            F.size(s["v"]),
        )))
    return F.get(with_mean, F.lit(0))


def vector_median(vector) -> Column:
    ordered = F.sort_array(_col(vector))
    half = F.size(_col(vector)) / F.lit(2)
    upper = F.floor(half).cast("int")
    lower = F.ceil(half).cast("int") - 1
    return (F.get(ordered, lower) + F.get(ordered, upper)) / 2.0
