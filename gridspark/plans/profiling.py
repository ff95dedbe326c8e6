"""Queries for variable summaries, outliers, histograms and box statistics."""

from pyspark.sql import functions as F

from gridspark.functions import ravel_index
from gridspark.operators import histogram as hg
from gridspark.operators import outliers, scaler, stats
from gridspark.operators.index import shuffle_rank
from gridspark.plans import fixtures as fx
from gridspark.plans.evaluation import rounded
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.registry import query

SUMMARY_SQL = " UNION ALL ".join(f"""SELECT '{v}' AS name,
    '(' || max(time) + 1 || ', ' || max(plevel) + 1 || ', ' || max(lat) + 1 || ', ' || max(lon) + 1 || ')' AS shape,
    count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, max({v}) AS max, min({v}) AS min
    FROM cells""" for v in ("ucomp", "temp"))


def summary(spark, folder):
    found = stats.feature_summary(fx.cells(spark, folder), ["ucomp", "temp"])
    return rounded(found.select("name", "shape", "n", "mean", "std", "max", "min"), 6, "mean", "std")


@query(sql(SUMMARY_SQL))
def feature_summary(spark, folder):
    return summary(spark, folder)


def _text_sql(column: str) -> str:
    """The number's own digits where it has at most two, else two decimals, whose zeros stay."""
    value = f"CAST({column} AS DOUBLE)"
    own = f"regexp_replace(printf('%.14e', {value}), '0*e', 'e')"
    few = f"length(regexp_extract({own}, '[.]([0-9]*)e', 1)) < 2 AND CAST(replace({own}, '.e', 'e') AS DOUBLE) = {value}"
    return f"CASE WHEN {few} THEN {own} ELSE printf('%.2e', {value}) END"


@query(sql(f"""SELECT name, units, {", ".join(f"{_text_sql(c)} AS {c}_text" for c in ("mean", "std", "max", "min"))}
    FROM ({SUMMARY_SQL.replace("round(avg(", "(avg(").replace("round(stddev_pop(", "(stddev_pop(").replace("), 6)", "))")})
    LEFT JOIN (VALUES ('temp', 'K')) AS m(name, units) USING (name)"""))
def feature_summary_text(spark, folder):
    """The summary's texts, and what is known about a variable beside its numbers."""
    meta = spark.createDataFrame([("temp", "K"), ("omega", "Pa/s")], "name STRING, units STRING")
    found = stats.feature_summary(fx.cells(spark, folder), ["ucomp", "temp"], meta)
    return found.select("name", "units", *[f"{c}_text" for c in ("mean", "std", "max", "min")])


@query(sql("""
    WITH d AS (SELECT time, plevel, lat, lon, ucomp, abs(ucomp - med) AS dev
               FROM cells, (SELECT median(ucomp) AS med FROM cells))
    SELECT time, plevel, lat, lon, ucomp, 0.6745 * dev > 3.5 * mad AS is_outlier
    FROM d, (SELECT median(dev) AS mad FROM d)"""))
def mad_outlier(spark, folder):
    return outliers.flag_outliers(fx.cells(spark, folder).drop("temp"), "ucomp")


@query(sql("""
    WITH d AS (SELECT time, plevel, lat, lon, ucomp, abs(ucomp - med) AS dev
               FROM cells JOIN (SELECT plevel, median(ucomp) AS med FROM cells GROUP BY plevel) USING (plevel))
    SELECT time, plevel, lat, lon, ucomp, 0.6745 * dev > 3.5 * mad AS is_outlier
    FROM d JOIN (SELECT plevel, median(dev) AS mad FROM d GROUP BY plevel) USING (plevel)"""))
def mad_outlier_level(spark, folder):
    return outliers.flag_outliers(fx.cells(spark, folder).drop("temp"), "ucomp", by=["plevel"])


@query(sql("""
    WITH e AS (SELECT sample_id, unnest(range(52)) AS idx, unnest(features) AS v FROM vectors),
    m AS (SELECT idx, median(v) AS med FROM e GROUP BY idx),
    d AS (SELECT sample_id, sqrt(sum(power(v - med, 2))) AS dev FROM e JOIN m USING (idx) GROUP BY sample_id),
    c AS (SELECT median(dev) AS mid FROM d)
    SELECT sample_id, 0.6745 * dev > 1.0 * mid AS is_outlier FROM d, c"""))
def mad_outlier_vector(spark, folder):
    rows = fx.vectors(spark, folder).select("sample_id", "features")
    return outliers.flag_vector_outliers(rows, "features", 1.0).drop("features")


@query(sql("""
    WITH e AS (SELECT sample_id, unnest(range(52)) AS idx, unnest(features) AS v FROM vectors),
    m AS (SELECT idx, median(v) AS med FROM e WHERE idx <> 3 GROUP BY idx),
    d AS (SELECT sample_id, sqrt(sum(power(v - med, 2))) AS dev FROM e JOIN m USING (idx) GROUP BY sample_id),
    c AS (SELECT median(dev) AS mid FROM d)
    SELECT sample_id, 0.6745 * dev > 1.0 * mid AS is_outlier FROM d, c"""))
def mad_outlier_vector_gap(spark, folder):
    """An element without a number in any row is left out and moves no other."""
    rows = fx.vectors(spark, folder).select("sample_id", F.transform(
        "features", lambda x, i: F.when(i == 3, float("nan")).otherwise(x)).alias("features"))
    return outliers.flag_vector_outliers(rows, "features", 1.0).drop("features")


HIST = """
    WITH r AS (SELECT min(ucomp) AS lo, (max(ucomp) - min(ucomp)) / 100 AS w, count(*) AS n FROM cells),
    c AS (SELECT least(floor((ucomp - lo) / w), 99) AS bin, count(*) AS c FROM cells, r GROUP BY 1),
    h AS (SELECT CAST(b AS INT) AS bin, lo + b * w AS lo, lo + (b + 1) * w AS hi, coalesce(c.c, 0) AS count,
          coalesce(c.c, 0) / (n * w) AS density FROM r CROSS JOIN (SELECT range AS b FROM range(100))
          LEFT JOIN c ON c.bin = b)
"""


@query(sql(HIST + "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count, round(density, 9) AS density FROM h"))
def histogram(spark, folder):
    return rounded(rounded(hg.histogram(fx.cells(spark, folder), "ucomp"), 6, "lo", "hi"), 9, "density")


@query(sql(HIST + """, f AS (SELECT bin, count, density / max(density) OVER () AS fraction FROM h)
    SELECT bin, count, round(fraction, 9) AS fraction,
      round((fraction - min(fraction) OVER ()) / (max(fraction) OVER () - min(fraction) OVER ()), 9) AS norm FROM f"""))
def histogram_norm(spark, folder):
    normed = hg.normalise_histogram(hg.histogram(fx.cells(spark, folder), "ucomp"))
    return rounded(normed.select("bin", "count", "fraction", "norm"), 9, "fraction", "norm")


KEPT = """
    WITH d AS (SELECT time, plevel, lat, lon, ucomp, abs(ucomp - med) AS dev
               FROM cells JOIN (SELECT plevel, median(ucomp) AS med FROM cells GROUP BY plevel) USING (plevel)),
    k AS (SELECT d.* FROM d JOIN (SELECT plevel, median(dev) AS mad FROM d GROUP BY plevel) USING (plevel)
          WHERE NOT 0.6745 * dev > 3.5 * mad),
    r AS (SELECT plevel, min(ucomp) AS lo, (max(ucomp) - min(ucomp)) / 100 AS w, count(*) AS n FROM k GROUP BY plevel),
    c AS (SELECT plevel, least(floor((ucomp - lo) / w), 99) AS bin, count(*) AS c FROM k JOIN r USING (plevel)
          GROUP BY 1, 2)
"""


@query(sql(KEPT + """SELECT r.plevel AS plevel, CAST(b AS INT) AS bin, round(lo + b * w, 6) AS lo,
    round(lo + (b + 1) * w, 6) AS hi, coalesce(c.c, 0) AS count, round(coalesce(c.c, 0) / (n * w), 9) AS density
    FROM r CROSS JOIN (SELECT range AS b FROM range(100)) LEFT JOIN c ON c.plevel = r.plevel AND c.bin = b"""))
def histogram_level(spark, folder):
    kept = outliers.remove_outliers(fx.cells(spark, folder), "ucomp", ["plevel"])
    return rounded(rounded(hg.histogram(kept, "ucomp", by=["plevel"]), 6, "lo", "hi"), 9, "density")


@query(sql(KEPT + "SELECT plevel, round(avg(ucomp), 6) AS mean, round(stddev_pop(ucomp), 6) AS std FROM k GROUP BY plevel"))
def robust_level_moments(spark, folder):
    kept = outliers.remove_outliers(fx.cells(spark, folder), "ucomp", ["plevel"])
    moments = kept.groupBy("plevel").agg(F.avg("ucomp").alias("mean"), F.stddev_pop("ucomp").alias("std"))
    return rounded(moments, 6, "mean", "std")


@query(sql("""
    WITH e AS (SELECT sample_id, unnest(range(6)) AS plevel, unnest(gwfu) AS v FROM vectors),
    st AS (SELECT plevel, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY plevel),
    o AS (SELECT sample_id FROM vectors ORDER BY md5('7:' || sample_id) LIMIT 100000),
    z AS (SELECT plevel, (v - m) / s AS z FROM e JOIN st USING (plevel) JOIN o USING (sample_id)),
    r AS (SELECT plevel, min(z) AS lo, (max(z) - min(z)) / 1000 AS w FROM z GROUP BY plevel),
    c AS (SELECT plevel, least(floor((z - lo) / w), 999) AS bin, count(*) AS c FROM z JOIN r USING (plevel) GROUP BY 1, 2)
    SELECT CAST(r.plevel AS INT) AS plevel, CAST(b AS INT) AS bin, round(lo + b * w, 8) AS lo,
      round(lo + (b + 1) * w, 8) AS hi, coalesce(c.c, 0) AS count
    FROM r CROSS JOIN (SELECT range AS b FROM range(1000)) LEFT JOIN c ON c.plevel = r.plevel AND c.bin = b"""))
def scaled_histogram(spark, folder):
    rows = fx.vectors(spark, folder).select("sample_id", "gwfu")
    state = scaler.scaler_fit(rows, "gwfu")
    return rounded(hg.scaled_histogram(shuffle_rank(rows, 7), state, "gwfu"), 8, "lo", "hi")


@query(sql("""
    WITH q AS (SELECT plevel, count(*) AS n, quantile_cont(ucomp, 0.25) AS q1, quantile_cont(ucomp, 0.5) AS median,
               quantile_cont(ucomp, 0.75) AS q3 FROM cells GROUP BY plevel)
    SELECT plevel, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(least(min(CASE WHEN ucomp >= q1 - 1.5 * (q3 - q1) THEN ucomp END), q1), 6) AS whisker_lo,
      round(greatest(max(CASE WHEN ucomp <= q3 + 1.5 * (q3 - q1) THEN ucomp END), q3), 6) AS whisker_hi,
      count(*) FILTER (ucomp < q1 - 1.5 * (q3 - q1) OR ucomp > q3 + 1.5 * (q3 - q1)) AS fliers
    FROM cells JOIN q USING (plevel) GROUP BY plevel, n, q.q1, q.median, q.q3"""))
def box_stats(spark, folder):
    found = stats.box_stats(fx.cells(spark, folder), "ucomp", ["plevel"])
    return rounded(found, 6, "q1", "median", "q3", "whisker_lo", "whisker_hi")


JOINT = "SELECT (CAST(time AS BIGINT) * 5 + lat) * 5 * 8 + lon * 8 + plevel AS cell_id, ucomp, temp FROM cells"
DRAWN = f"SELECT * FROM ({JOINT}) ORDER BY md5('11:' || cell_id) LIMIT 1000"


def _joint(spark, folder):
    sid = ravel_index("time", "lat", "lon", fx.N_LAT, fx.N_LON)
    rows = fx.cells(spark, folder).withColumn("cell_id", sid * fx.LEVELS + F.col("plevel"))
    return stats.joint_scatter(rows, "ucomp", "temp", 1000, 11, "cell_id", 20)


@query(sql(DRAWN))
def joint_scatter(spark, folder):
    return _joint(spark, folder)[0]


@query(sql(f"""
    WITH d AS ({DRAWN}),
    s AS (SELECT 'x' AS axis, ucomp AS v FROM d UNION ALL SELECT 'y', temp FROM d),
    r AS (SELECT axis, min(v) AS lo, (max(v) - min(v)) / 20 AS w, count(*) AS n FROM s GROUP BY axis),
    c AS (SELECT axis, least(floor((v - lo) / w), 19) AS bin, count(*) AS c FROM s JOIN r USING (axis) GROUP BY 1, 2)
    SELECT r.axis AS axis, CAST(b AS INT) AS bin, round(lo + b * w, 6) AS lo, round(lo + (b + 1) * w, 6) AS hi,
      coalesce(c.c, 0) AS count, round(coalesce(c.c, 0) / (n * w), 9) AS density
    FROM r CROSS JOIN (SELECT range AS b FROM range(20)) LEFT JOIN c ON c.axis = r.axis AND c.bin = b"""))
def joint_marginals(spark, folder):
    return rounded(rounded(_joint(spark, folder)[1], 6, "lo", "hi"), 9, "density")


@query(sql("""SELECT plevel, round(-1.2 * m, 6) AS vmin, round(1.2 * m, 6) AS vmax FROM (
    SELECT plevel, greatest(max(abs(target)), max(abs(prediction))) AS m FROM pairs GROUP BY plevel)"""))
def value_limits(spark, folder):
    limits = stats.value_limits(fx.pairs(spark, folder), ["target", "prediction"], True, 1.2, ["plevel"])
    return rounded(limits, 6, "vmin", "vmax")
