"""Queries for error metrics, losses and experiment comparison."""

from pyspark.sql import functions as F

from gridspark.functions import t_two_sided
from gridspark.operators import experiments as ex
from gridspark.operators import metrics as mt
from gridspark.operators.error_state import error_state, lines_of, merge_states, metrics_of
from gridspark.operators.histogram import histogram_pair as histogram_pair_of
from gridspark.operators.outliers import remove_paired_outliers
from gridspark.plans import fixtures as fx
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.registry import query
from gridspark.runtime import attach, small, stored


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(sql("""SELECT plevel, count(*) AS n, round(avg(abs(target - prediction)), 4) AS mae,
    round(sqrt(avg(power(target - prediction, 2))), 4) AS rmse,
    round(power(corr(prediction, target), 2), 6) AS r_squared FROM pairs GROUP BY plevel"""))
def level_metrics(spark, folder):
    out = rounded(mt.level_metrics(fx.pairs(spark, folder)), 4, "mae", "rmse")
    return rounded(out, 6, "r_squared")


@query(sql("SELECT plevel, round(power(corr(prediction, target), 2), 8) AS r_squared FROM pairs GROUP BY plevel"))
def level_r2(spark, folder):
    return rounded(mt.level_r2(fx.pairs(spark, folder)), 8, "r_squared")


@query(sql("""SELECT plevel, count(*) AS n, round(regr_slope(target, prediction), 8) AS slope,
    round(regr_intercept(target, prediction), 4) AS intercept, round(corr(target, prediction), 8) AS r_value,
    round(sqrt((1 - power(corr(target, prediction), 2)) * var_pop(target) / var_pop(prediction) / (count(*) - 2)), 8)
      AS stderr FROM pairs GROUP BY plevel"""))
def level_regression(spark, folder):
    lines = mt.level_regression(fx.pairs(spark, folder)).drop("p_value")
    return rounded(rounded(lines, 8, "slope", "r_value", "stderr"), 4, "intercept")


def merged_errors(spark, folder):
    """The error state of seven parts of the samples, stored and merged again."""
    parts = fx.pairs(spark, folder).withColumn("part", F.pmod("sample_id", F.lit(7)))
    return merge_states(stored(error_state(parts, ("part", "plevel")), "errors").drop("part"))


@query(sql("""SELECT plevel, count(*) AS n, round(avg(abs(target - prediction)), 4) AS mae,
    round(sqrt(avg(power(target - prediction, 2))), 4) AS rmse,
    round(power(corr(prediction, target), 2), 6) AS r_squared FROM pairs GROUP BY plevel"""))
def merged_level_metrics(spark, folder):
    out = rounded(metrics_of(merged_errors(spark, folder)), 4, "mae", "rmse")
    return rounded(out, 6, "r_squared")


@query(sql("""SELECT plevel, count(*) AS n, round(regr_slope(target, prediction), 8) AS slope,
    round(regr_intercept(target, prediction), 4) AS intercept, round(corr(target, prediction), 8) AS r_value,
    round(sqrt((1 - power(corr(target, prediction), 2)) * var_pop(target) / var_pop(prediction) / (count(*) - 2)), 8)
      AS stderr FROM pairs GROUP BY plevel"""))
def merged_level_regression(spark, folder):
    lines = lines_of(merged_errors(spark, folder)).drop("p_value")
    return rounded(rounded(lines, 8, "slope", "r_value", "stderr"), 4, "intercept")


@query(sql("""WITH s AS (SELECT plevel, avg(target) AS m, stddev_pop(target) AS sd FROM pairs GROUP BY plevel)
    SELECT sample_id, round(1 - 2 / pi() * atan(abs(z)), 8) AS p1, round(1 - abs(z) / sqrt(2 + z * z), 8) AS p2
    FROM (SELECT sample_id, (target - m) / sd AS z FROM pairs JOIN s USING (plevel))"""))
def t_probability(spark, folder):
    """Two-sided Student probabilities of standardised targets, at 1 and 2 degrees of freedom."""
    rows = fx.pairs(spark, folder)
    state = rows.groupBy("plevel").agg(F.avg("target").alias("m"), F.stddev_pop("target").alias("sd"))
    z = attach(rows, state, ["plevel"]).select("sample_id", ((F.col("target") - F.col("m")) / F.col("sd")).alias("z"))
    return rounded(z.select("sample_id", t_two_sided("z", F.lit(1)).alias("p1"),
                            t_two_sided("z", F.lit(2)).alias("p2")), 8, "p1", "p2")


@query(sql("""SELECT sample_id, round(list_stddev_pop(gwfu), 8) AS std, list_min(gwfu) AS min, list_max(gwfu) AS max,
    round(list_avg(gwfu), 8) AS mean, round(list_median(gwfu), 8) AS median FROM vectors"""))
def sample_stats(spark, folder):
    return rounded(mt.sample_stats(fx.vectors(spark, folder), "gwfu"), 8, "std", "mean", "median")


@query(sql("""SELECT plevel, round(stddev_pop(target), 4) AS std, min(target) AS min, max(target) AS max,
    round(avg(target), 4) AS mean, round(median(target), 4) AS median FROM pairs GROUP BY plevel"""))
def level_stats(spark, folder):
    return rounded(mt.level_stats(fx.pairs(spark, folder)), 4, "std", "mean", "median")


@query(sql("""SELECT plevel, hpa, round(power(corr(prediction, target), 2), 3) AS r_squared,
    CASE plevel WHEN 1 THEN '0.5 hPa' WHEN 3 THEN '1 hPa' WHEN 6 THEN '2 hPa' END AS label
    FROM pairs JOIN levels USING (plevel) WHERE plevel IN (1, 3, 6) GROUP BY plevel, hpa"""))
def level_panels(spark, folder):
    chosen = {1: "0.5 hPa", 3: "1 hPa", 6: "2 hPa"}
    return mt.level_panels(fx.pairs(spark, folder), fx.levels(spark), chosen)


@query(sql("""SELECT plevel, hpa, round(power(corr(prediction, target), 2), 8) AS r_squared
    FROM pairs JOIN levels USING (plevel) GROUP BY plevel, hpa ORDER BY plevel DESC"""))
def r2_profile(spark, folder):
    return rounded(mt.r2_profile(fx.pairs(spark, folder), fx.levels(spark), reverse=True), 8, "r_squared")


LOSS_SQL = """avg(abs(d) + ln(1 + exp(-2 * abs(d))) - ln(2.0))"""


@query(sql(f"""SELECT plevel, round({LOSS_SQL}, 4) AS log_cosh, round(avg(d * d), 4) AS mse,
    round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse
    FROM (SELECT plevel, (target - prediction) / 1000 AS d FROM pairs) GROUP BY plevel"""))
def losses(spark, folder):
    thousands = fx.pairs(spark, folder).withColumns(
        {c: F.col(c) / 1000 for c in ("target", "prediction")})
    return rounded(mt.losses(thousands), 4, "log_cosh", "mse", "mae", "rmse")


@query(sql(f"""SELECT round(sum(lc), 3) AS log_cosh, round(sum(mse), 3) AS mse, round(sum(mae), 3) AS mae,
    round(sum(rmse), 3) AS rmse FROM (
      SELECT {LOSS_SQL} AS lc, avg(d * d) AS mse, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse
      FROM (SELECT plevel, (target - prediction) / 1000 AS d FROM pairs) GROUP BY plevel)"""))
def total_losses(spark, folder):
    thousands = fx.pairs(spark, folder).withColumns(
        {c: F.col(c) / 1000 for c in ("target", "prediction")})
    return rounded(mt.total_losses(thousands), 3, "log_cosh", "mse", "mae", "rmse")


@query(sql("""SELECT plevel, round(avg(CASE WHEN plevel < 4 THEN power(target - prediction, 2)
    ELSE abs(target - prediction) END), 3) AS loss FROM pairs GROUP BY plevel"""))
def composite_loss(spark, folder):
    return rounded(mt.composite_loss(fx.pairs(spark, folder), switch_level=4), 3, "loss")


PAIRED_SQL = """
    WITH m1 AS (SELECT plevel, median(target) AS med FROM pairs GROUP BY plevel),
    d1 AS (SELECT p.*, abs(target - med) AS dev FROM pairs p JOIN m1 USING (plevel)),
    k1 AS (SELECT d1.* FROM d1 JOIN (SELECT plevel, median(dev) AS mad FROM d1 GROUP BY plevel) USING (plevel)
           WHERE NOT 0.6745 * dev > 1.5 * mad),
    m2 AS (SELECT plevel, median(prediction) AS med FROM k1 GROUP BY plevel),
    d2 AS (SELECT k1.sample_id, k1.plevel, target, prediction, abs(prediction - med) AS dev2
           FROM k1 JOIN m2 USING (plevel)),
    kept AS (SELECT d2.* FROM d2 JOIN (SELECT plevel, median(dev2) AS mad FROM d2 GROUP BY plevel) USING (plevel)
           WHERE NOT 0.6745 * dev2 > 1.5 * mad)
"""


@query(sql(PAIRED_SQL + "SELECT sample_id, plevel, target, round(prediction, 6) AS prediction FROM kept"))
def paired_outliers(spark, folder):
    return rounded(remove_paired_outliers(fx.pairs(spark, folder), thresh=1.5), 6, "prediction")


@query(sql(PAIRED_SQL + """SELECT plevel, count(*) AS n, round(avg(abs(target - prediction)), 4) AS mae,
    round(sqrt(avg(power(target - prediction, 2))), 4) AS rmse,
    round(power(corr(prediction, target), 2), 6) AS r_squared FROM kept GROUP BY plevel"""))
def robust_level_metrics(spark, folder):
    kept = remove_paired_outliers(fx.pairs(spark, folder), thresh=1.5)
    return rounded(rounded(mt.level_metrics(kept), 4, "mae", "rmse"), 6, "r_squared")


@query(sql("""
    WITH s AS (SELECT plevel, 'prediction' AS series, prediction AS v FROM pairs
               UNION ALL SELECT plevel, 'target', target FROM pairs),
    r AS (SELECT plevel, series, min(v) AS lo, (max(v) - min(v)) / 1000 AS w, count(*) AS n FROM s GROUP BY 1, 2),
    c AS (SELECT plevel, series, least(floor((v - lo) / w), 999) AS bin, count(*) AS c
          FROM s JOIN r USING (plevel, series) GROUP BY 1, 2, 3)
    SELECT r.plevel AS plevel, r.series AS series, CAST(b AS INT) AS bin, round(lo + b * w, 6) AS lo,
      round(lo + (b + 1) * w, 6) AS hi, coalesce(c.c, 0) AS count, round(coalesce(c.c, 0) / (n * w), 12) AS density
    FROM r CROSS JOIN (SELECT range AS b FROM range(1000))
    LEFT JOIN c ON c.plevel = r.plevel AND c.series = r.series AND c.bin = b"""))
def histogram_pair(spark, folder):
    out = histogram_pair_of(fx.pairs(spark, folder), 1000)
    return rounded(rounded(out, 6, "lo", "hi"), 12, "density")


def metrics_table(spark, folder):
    """Level metrics of every experiment and target, in one aggregate."""
    tagged = fx.experiment_pairs(spark, folder)
    names = ex.experiment_registry(spark).select("experiment_no", "experiment")
    per = tagged.groupBy("experiment_no", "target_name", "plevel").agg(
        F.avg(F.abs(mt.error())).alias("mae"), F.sqrt(F.avg(mt.error() * mt.error())).alias("rmse"),
        mt.r_squared().alias("r_squared"))
    return per.withColumnRenamed("target_name", "target").join(small(names), "experiment_no").drop(
        "experiment_no")


NOT_FOR = """NOT (target = 'gwfu' AND experiment IN ('vtemp', 'vhght', 'vlatlon'))
    AND NOT (target = 'gwfv' AND experiment IN ('utemp', 'uhght', 'ulatlon'))"""


@query(sql(f"""SELECT experiment, plevel, round(max(CASE WHEN target = 'gwfu' THEN r_squared END), 6) AS gwfu,
    round(max(CASE WHEN target = 'gwfv' THEN r_squared END), 6) AS gwfv
    FROM metrics WHERE {NOT_FOR} GROUP BY experiment, plevel"""))
def experiment_matrix(spark, folder):
    matrix = ex.experiment_matrix(metrics_table(spark, folder), ex.experiment_registry(spark),
                                  ex.exclusion_table(spark))
    return rounded(matrix.drop("label"), 6, "gwfu", "gwfv")


@query(sql("SELECT target, experiment, round(avg(r_squared), 6) AS mean_r2 FROM metrics GROUP BY 1, 2"))
def experiment_mean_r2(spark, folder):
    return rounded(ex.experiment_mean_r2(metrics_table(spark, folder)), 6, "mean_r2")


@query(sql("""
    WITH q AS (SELECT target, experiment, count(*) AS n, quantile_cont(r_squared, 0.25) AS q1,
        quantile_cont(r_squared, 0.5) AS median, quantile_cont(r_squared, 0.75) AS q3 FROM metrics GROUP BY 1, 2)
    SELECT target, experiment, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(least(min(CASE WHEN r_squared >= q1 - 1.5 * (q3 - q1) THEN r_squared END), q1), 6) AS whisker_lo,
      round(greatest(max(CASE WHEN r_squared <= q3 + 1.5 * (q3 - q1) THEN r_squared END), q3), 6) AS whisker_hi,
      count(*) FILTER (r_squared < q1 - 1.5 * (q3 - q1) OR r_squared > q3 + 1.5 * (q3 - q1)) AS fliers
    FROM metrics JOIN q USING (target, experiment) GROUP BY target, experiment, n, q.q1, q.median, q.q3"""))
def experiment_box(spark, folder):
    return rounded(ex.experiment_box(metrics_table(spark, folder)), 6,
                   "q1", "median", "q3", "whisker_lo", "whisker_hi")


@query(sql("""SELECT experiment, target, plevel, round(mae, 4) AS mae, round(rmse, 4) AS rmse,
    round(r_squared, 6) AS r_squared,
    CAST(rank() OVER (PARTITION BY target, plevel ORDER BY r_squared DESC) AS INT) AS rank FROM metrics"""))
def experiment_rank(spark, folder):
    ranked = ex.experiment_rank(metrics_table(spark, folder))
    return rounded(rounded(ranked, 4, "mae", "rmse"), 6, "r_squared")
