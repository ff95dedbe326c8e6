"""Projection, indexing and reshaping between cells, vertical columns and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import cell_label, surface_label, unravel_index
from gridspark.runtime import small

COLUMN_KEY = ("time", "lat", "lon")


def select_variables(cells: DataFrame, names, key=("time", "plevel", "lat", "lon")) -> DataFrame:
    """Coordinates and the named variables only; the pruning reaches the scan."""
    return cells.select(*key, *names)


def slice_levels(df: DataFrame, lo: int, hi: int, vectors=()) -> DataFrame:
    """Levels [lo, hi): a row filter on cells, an array slice on the named vectors."""
    if not vectors:
        return df.where((F.col("plevel") >= lo) & (F.col("plevel") < hi))
    return df.withColumns({v: F.slice(v, lo + 1, hi - lo) for v in vectors})


def select_lat(cells: DataFrame, lat: int) -> DataFrame:
    return cells.where(F.col("lat") == lat)


def with_grid_index(df: DataFrame) -> DataFrame:
    """Latitude and longitude indices as double features."""
    return df.withColumns({"lat_index": F.col("lat").cast("double"),
                           "lon_index": F.col("lon").cast("double")})


def to_columns(cells: DataFrame, variables, plevels: int | None = None, key=COLUMN_KEY) -> DataFrame:
    """One row per vertical column, each variable an array ordered by level.

    All variables travel in one shuffle, and a group has one row per level. A column that
    lacks a level below its highest is refused with an error.
    """
    rows = cells if plevels is None else cells.where(F.col("plevel") < plevels)
    profile = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("plevel", *variables))).alias("profile"))
    return profile.where(_whole(F.col("profile")["plevel"])).select(
        *key, *[F.col("profile")[v].alias(v) for v in variables])


def to_dense_columns(cells: DataFrame, variables, plevels: int, key=COLUMN_KEY) -> DataFrame:
    """Like :func:`to_columns` with a fixed number of levels; absent levels become 0."""
    picks = [
        F.array(*[
            F.coalesce(F.max(F.when(F.col("plevel") == i, F.col(v))), F.lit(0.0))
            for i in range(plevels)
        ]).alias(v)
        for v in variables
    ]
    return cells.groupBy(*key).agg(*picks)


def assemble(columns: DataFrame, vectors, scalars=(), out="features", order=None) -> DataFrame:
    """Append the feature vector and its width; by default vectors first, then scalars."""
    single = set(scalars)
    parts = [F.array(F.col(n).cast("double")) if n in single else F.col(n) for n in order or [*vectors, *scalars]]
    return columns.withColumn(out, F.concat(*parts)).withColumn("width", F.size(out))


def feature_layout(vectors, scalars, plevels: int, order=None) -> dict[str, tuple[int, int]]:
    """Start (0-based) and length of each feature's block in the assembled vector."""
    layout, start, single = {}, 0, set(scalars)
    for name in order or [*vectors, *scalars]:
        width = 1 if name in single else plevels
        layout[name] = (start, width)
        start += width
    return layout


def feature_subset(df: DataFrame, names, layout, col="features", out="features") -> DataFrame:
    """Keep only the blocks of the named features."""
    blocks = [F.slice(col, layout[n][0] + 1, layout[n][1]) for n in names]
    return df.withColumn(out, F.concat(*blocks))


def explode_levels(df: DataFrame, vectors, key=("sample_id",), index="plevel") -> DataFrame:
    """One row per sample and level."""
    zipped = df.select(*key, F.posexplode(F.arrays_zip(*vectors)).alias(index, "_z"))
    return zipped.select(*key, index, *[F.col("_z")[v].alias(v) for v in vectors])


def stack_levels(df: DataFrame, vectors, key=("sample_id",), index="plevel") -> DataFrame:
    """Inverse of :func:`explode_levels`; a missing level is refused with an error."""
    stacked = df.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(index, *vectors))).alias("_s"))
    return stacked.where(_whole(F.col("_s")[index])).select(*key, *[F.col("_s")[v].alias(v) for v in vectors])


def _whole(levels):
    """True, or an error where a level is missing: what follows it would move up."""
    expected = F.sequence(F.lit(0), F.size(levels) - 1)
    gap = F.raise_error(F.concat(F.lit("levels are missing or repeated: "), F.to_json(levels)))
    return F.when(F.transform(levels, lambda i: i.cast("int")) == expected, True).otherwise(gap.cast("boolean"))


def vectors_to_cells(df: DataFrame, vectors, n_lat: int, n_lon: int) -> DataFrame:
    """Vectors by sample id back to cells; rows may come in any order."""
    cells = explode_levels(df, vectors)
    where = unravel_index("sample_id", n_lat, n_lon)
    return cells.select(where["time"].alias("time"), "plevel", where["lat"].alias("lat"),
                        where["lon"].alias("lon"), *vectors)


def cell_labels(cells: DataFrame, feature: str) -> DataFrame:
    return cells.withColumn("label", cell_label(feature))


def surface_labels(surface: DataFrame, feature: str = "slp") -> DataFrame:
    return surface.withColumn("label", surface_label(feature))


def feature_names(levels: DataFrame, features, origin: int = 13) -> DataFrame:
    """One name per feature and level: the feature and its offset ``origin - level``."""
    tags = F.array(*[F.lit(f) for f in features])
    named = levels.select("plevel", F.posexplode(tags).alias("block", "feature"))
    offset = (F.lit(origin) - F.col("plevel")).cast("string")
    return named.withColumn("name", F.concat_ws(" ", "feature", offset))


def rescale(df: DataFrame, cols, factor: float) -> DataFrame:
    """Multiply numeric or vector columns by a factor."""
    vectors = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.withColumns({
        c: F.transform(c, lambda x: x * factor) if c in vectors else F.col(c) * factor
        for c in cols})


def join_fields(truth: DataFrame, prediction: DataFrame, on, col: str) -> DataFrame:
    """Truth and prediction of one variable side by side."""
    return truth.select(*on, F.col(col).alias("target")).join(
        prediction.select(*on, F.col(col).alias("prediction")), list(on))


def difference(truth: DataFrame, prediction: DataFrame, on, col: str) -> DataFrame:
    both = join_fields(truth, prediction, on, col)
    return both.withColumn("difference", F.col("target") - F.col("prediction"))


def paste_features(dfs, key="sample_id") -> DataFrame:
    """Feature tables side by side, matched by sample id."""
    return reduce(lambda left, right: left.join(right, key), dfs)


def zip_join(features: DataFrame, gwfu: DataFrame, gwfv: DataFrame, key="sample_id") -> DataFrame:
    """Features with both targets; ids absent from any table drop out."""
    return paste_features([features, gwfu, gwfv], key)


def join_surface(columns: DataFrame, surface: DataFrame, on=COLUMN_KEY) -> DataFrame:
    return columns.join(surface, list(on))


# Pressure (hPa) of the 40 model levels, top first.
LEVEL_HPA = (
    0.18, 0.56, 0.72, 0.94, 1.21, 1.57, 2.02, 2.60, 3.32, 4.25,
    5.40, 6.85, 8.68, 10.9, 13.8, 17.3, 21.6, 26.8, 33.2, 41.1,
    50.7, 62.2, 76.0, 92.4, 112.0, 135.0, 162.0, 194.0, 231.0, 273.0,
    321.0, 375.0, 436.0, 503.0, 577.0, 655.0, 737.0, 821.0, 902.0, 971.0,
)


def levels_table(spark: SparkSession, lo: int = 0, hi: int = len(LEVEL_HPA), hpa=LEVEL_HPA) -> DataFrame:
    """The level coordinate [lo, hi): level index and pressure."""
    rows = [(i, float(p)) for i, p in enumerate(hpa)][lo:hi]
    return spark.createDataFrame(rows, "plevel INT, hpa DOUBLE")


def with_pressure(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Pressure labels by level index."""
    return df.join(small(levels), "plevel")


def with_level_names(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Pressure labels truncated to whole hPa."""
    return with_pressure(df, levels).withColumn("hpa_label", F.col("hpa").cast("int"))
