"""Cubes, columns, pairs and vectors derived from the given tables.

``CTE`` holds the same derivations in SQL; :func:`with_tables` puts the needed ones in
front of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.reshape import LEVEL_HPA, levels_table

LEVELS, N_LAT, N_LON = 8, 5, 5      # cells
OBS_LEVELS, OBS_LAT, OBS_LON = 7, 10, 15
FEATURES, TARGETS = 52, 6           # vectors


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _div(a: str, n: int) -> Column:
    return F.expr(f"{a} div {n}")


def cells_of(events: DataFrame) -> DataFrame:
    """A dense cube: every (time, level, lat, lon) once."""
    return events.select(
        _div("event_id", LEVELS * N_LAT * N_LON).cast("int").alias("time"),
        (_div("event_id", N_LAT * N_LON) % LEVELS).cast("int").alias("plevel"),
        (_div("event_id", N_LON) % N_LAT).cast("int").alias("lat"),
        (F.col("event_id") % N_LON).cast("int").alias("lon"),
        F.col("value").alias("ucomp"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("temp"),
    )


def cells(spark, folder) -> DataFrame:
    return cells_of(table(spark, folder, "events"))


def forecast(spark, folder) -> DataFrame:
    """A second cube on the same grid, to stand for a prediction of ``ucomp``."""
    value = F.col("ucomp") * 0.8 + F.col("temp") * 0.1
    return cells(spark, folder).withColumn("ucomp", value)


def surface(spark, folder) -> DataFrame:
    """One number per column, from all its levels."""
    return cells(spark, folder).groupBy("time", "lat", "lon").agg(F.max("ucomp").alias("slp"))


def levels(spark) -> DataFrame:
    return levels_table(spark, 0, LEVELS)


def observations(spark, folder) -> DataFrame:
    """Sparse columns: an order is a sample, its line numbers are levels."""
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("sample_id"),
                         (F.col("l_linenumber") - 1).alias("plevel")).agg(
        F.avg("l_extendedprice").alias("gwfu"), F.avg("l_quantity").alias("ucomp"))


def _prediction() -> Column:
    return F.col("l_extendedprice") * 0.9 + F.col("l_quantity") * 800


def pairs(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        (F.col("l_linenumber") - 1).alias("plevel"),
        F.col("l_extendedprice").alias("target"),
        _prediction().alias("prediction"))


def experiment_pairs(spark, folder) -> DataFrame:
    """Pairs tagged with one of eleven experiments and a target; every row has a tag."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 11).cast("int").alias("experiment_no"),
        F.when(F.col("l_returnflag") == "A", "gwfu").otherwise("gwfv").alias("target_name"),
        (F.col("l_linenumber") - 1).alias("plevel"),
        F.col("l_extendedprice").alias("target"),
        _prediction().alias("prediction"))


def vectors(spark, folder) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.slice(wide, 1, FEATURES).alias("features"),
        F.slice(wide, FEATURES + 1, TARGETS).alias("gwfu"),
        F.slice(wide, FEATURES + TARGETS + 1, TARGETS).alias("gwfv"),
        (F.col("label") % 2).alias("source"))


def samples(spark, folder) -> DataFrame:
    """Sample ids with a value, from orders."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("gwfu"))


CTE = {
    "cells": """SELECT CAST(event_id // 200 AS INT) AS time, CAST((event_id // 25) % 8 AS INT) AS plevel,
        CAST((event_id // 5) % 5 AS INT) AS lat, CAST(event_id % 5 AS INT) AS lon, value AS ucomp,
        CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS temp FROM events""",
    "forecast": """SELECT time, plevel, lat, lon,
        ucomp * CAST(0.8 AS DOUBLE) + temp * CAST(0.1 AS DOUBLE) AS ucomp FROM cells""",
    "surface": "SELECT time, lat, lon, max(ucomp) AS slp FROM cells GROUP BY time, lat, lon",
    "levels": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, CAST({p} AS DOUBLE))" for i, p in enumerate(LEVEL_HPA[:LEVELS])) + ") AS t(plevel, hpa)",
    "observations": """SELECT l_orderkey AS sample_id, l_linenumber - 1 AS plevel,
        avg(l_extendedprice) AS gwfu, avg(l_quantity) AS ucomp
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "pairs": """SELECT l_orderkey AS sample_id, l_linenumber - 1 AS plevel, l_extendedprice AS target,
        l_extendedprice * CAST(0.9 AS DOUBLE) + l_quantity * 800 AS prediction FROM lineitem""",
    "names": """SELECT * FROM (VALUES (0, 'full_features'), (1, 'only_uv'), (2, 'minus_uv'), (3, 'only_u'),
        (4, 'only_v'), (5, 'utemp'), (6, 'uhght'), (7, 'ulatlon'), (8, 'vtemp'), (9, 'vhght'),
        (10, 'vlatlon')) AS t(experiment_no, experiment)""",
    "metrics": """SELECT n.experiment AS experiment,
        CASE WHEN l_returnflag = 'A' THEN 'gwfu' ELSE 'gwfv' END AS target, l_linenumber - 1 AS plevel,
        avg(abs(l_extendedprice - (l_extendedprice * CAST(0.9 AS DOUBLE) + l_quantity * 800))) AS mae,
        sqrt(avg(power(l_extendedprice - (l_extendedprice * CAST(0.9 AS DOUBLE) + l_quantity * 800), 2))) AS rmse,
        power(corr(l_extendedprice, l_extendedprice * CAST(0.9 AS DOUBLE) + l_quantity * 800), 2) AS r_squared
        FROM lineitem JOIN names n ON l_suppkey % 11 = n.experiment_no GROUP BY 1, 2, 3""",
    "vectors": """SELECT vec_id AS sample_id, CAST(embedding[1:52] AS DOUBLE[]) AS features,
        CAST(embedding[53:58] AS DOUBLE[]) AS gwfu, CAST(embedding[59:64] AS DOUBLE[]) AS gwfv,
        label % 2 AS source FROM embeddings""",
    "samples": "SELECT o_orderkey AS sample_id, o_totalprice AS gwfu FROM orders",
}
NEEDS = {"forecast": ["cells"], "surface": ["cells"], "metrics": ["names"]}


def with_tables(body: str) -> str:
    """Prefix the derivations that the SQL names."""
    used: list[str] = []

    def add(name):
        for inner in NEEDS.get(name, []):
            add(inner)
        if name not in used:
            used.append(name)

    for name in CTE:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not used:
        return body.strip()
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in used)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
