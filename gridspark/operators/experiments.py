"""Comparison of experiments: metric matrices, means, box statistics and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.operators.stats import box_stats
from gridspark.runtime import small

# Experiment names and labels, and the target each one does not apply to.
EXPERIMENTS = (
    ("full_features", "[u,v,ω,H,T,λ,φ,ps]"),
    ("only_uv", "[u,v]"),
    ("minus_uv", "[ω,H,T,λ,φ,ps]"),
    ("only_u", "[u]"),
    ("only_v", "[v]"),
    ("utemp", "[u, T]"),
    ("uhght", "[u, H]"),
    ("ulatlon", "[u, λ,φ]"),
    ("vtemp", "[v, T]"),
    ("vhght", "[v, H]"),
    ("vlatlon", "[v, λ,φ]"),
)
EXCLUSIONS = (
    ("vtemp", "gwfu"), ("vhght", "gwfu"), ("vlatlon", "gwfu"),
    ("utemp", "gwfv"), ("uhght", "gwfv"), ("ulatlon", "gwfv"),
)


def experiment_registry(spark: SparkSession, rows=EXPERIMENTS) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)],
                                 "experiment_no INT, experiment STRING, label STRING")


def exclusion_table(spark: SparkSession, rows=EXCLUSIONS) -> DataFrame:
    return spark.createDataFrame(list(rows), "experiment STRING, target STRING")


def applicable(metrics: DataFrame, experiments: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Metrics of registered experiments, without the excluded (experiment, target) pairs."""
    kept = metrics.join(small(exclusions), ["experiment", "target"], "left_anti")
    return kept.join(small(experiments.select("experiment", "label")), "experiment")


def experiment_matrix(metrics: DataFrame, experiments: DataFrame, exclusions: DataFrame,
                      metric: str = "r_squared", targets=("gwfu", "gwfv")) -> DataFrame:
    """One row per experiment and level, one column per target."""
    kept = applicable(metrics, experiments, exclusions)
    return kept.groupBy("experiment", "label", "plevel").pivot("target", list(targets)).agg(
        F.first(metric))


def experiment_mean_r2(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("target", "experiment").agg(F.avg("r_squared").alias("mean_r2"))


def experiment_box(metrics: DataFrame, metric: str = "r_squared") -> DataFrame:
    return box_stats(metrics, metric, ["target", "experiment"])


def experiment_rank(metrics: DataFrame, metric: str = "r_squared", ascending: bool = False) -> DataFrame:
    """Rank of each experiment within a target and level; one row per experiment there."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    best = Window.partitionBy("target", "plevel").orderBy(order)
    return metrics.withColumn("rank", F.rank().over(best))
