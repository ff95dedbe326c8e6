"""Queries that write to the shared folder and read back."""

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridspark.operators import scaler, split
from gridspark.operators.profiles import sources_in_line
from gridspark.operators.reshape import COLUMN_KEY, explode_levels
from gridspark.plans import fixtures as fx
from gridspark.plans.evaluation import rounded
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.modelling import LINEAR_SCORE, linear_scored
from gridspark.plans.profiling import SUMMARY_SQL, summary
from gridspark.plans.registry import query
from gridspark.plans.sampling import FITTED, rounded_state
from gridspark.runtime import scratch_path
from gridspark.sources import grid, tables


@query(sql("SELECT time, plevel, lat, lon, ucomp, temp, time // 20 AS year FROM cells"))
def cube_store(spark, folder):
    path = scratch_path(spark, "cube")
    tables.write_cube(fx.cells(spark, folder).withColumn("year", F.expr("time div 20")), path)
    return tables.read_cube(spark, path).withColumn("year", F.col("year").cast("int"))


@query(sql("SELECT sample_id, CAST(unnest(range(52)) AS INT) AS idx, unnest(features) AS v FROM vectors"))
def vectors_csv(spark, folder):
    path = scratch_path(spark, "csv")
    rows = fx.vectors(spark, folder)
    tables.write_vectors_csv(rows, path, "features", fx.FEATURES, header=True)
    back = tables.read_vectors_csv(spark, path, fx.FEATURES, header=True)
    return back.select("sample_id", F.posexplode("features").alias("idx", "v"))


@query(sql("""SELECT CAST(year(l_shipdate) AS VARCHAR) AS source, l_orderkey AS sample_id, l_linenumber - 1 AS plevel,
    l_extendedprice AS gwfu FROM lineitem"""))
def multi_source(spark, folder):
    """Yearly folders, read as one table with a source tag."""
    path = scratch_path(spark, "years")
    lines = fx.table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("sample_id"),
        (F.col("l_linenumber") - 1).alias("plevel"), F.col("l_extendedprice").alias("gwfu"))
    lines.write.partitionBy("year").parquet(path)
    years = sorted(r.year for r in lines.select("year").distinct().collect())
    return tables.read_sources(spark, {str(y): f"{path}/year={y}" for y in years})


@query(sql(SUMMARY_SQL))
def summary_json(spark, folder):
    path = scratch_path(spark, "summary")
    found = summary(spark, folder)
    tables.write_summary_json(found, path)
    return spark.read.schema(found.schema).json(path)


@query(sql("""SELECT k AS key, v AS value, ver AS version FROM (
    SELECT 'total_samples' AS k, (SELECT count(*) FROM samples) AS v, 1 AS ver
    UNION ALL SELECT 'input_shape', 19, 0 UNION ALL SELECT 'output_shape', 6, 0
    UNION ALL SELECT 'num_test_samples', (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM samples), 1
    UNION ALL SELECT 'num_val_samples', (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM samples), 1
    UNION ALL SELECT 'num_train_samples', (SELECT count(*) - CAST(floor(count(*) * 0.1) AS BIGINT)
      - CAST(floor(count(*) * 0.05) AS BIGINT) FROM samples), 1)"""))
def dataset_metadata(spark, folder):
    rows = fx.samples(spark, folder)
    first = tables.dataset_metadata(rows, ["ucomp", "temp", "slp", "lat", "lon"], fx.LEVELS, fx.TARGETS)
    after = tables.metadata_of(split.split_counts(rows, 0.1, 0.05), version=1)
    return tables.merge_metadata(first, after)


@query(sql(f"SELECT idx, n, round(mean, 8) AS mean, round(m2, 8) AS m2 FROM ({FITTED})"))
def scaler_state(spark, folder):
    path = scratch_path(spark, "scaler")
    scaler.save_scaler(scaler.scaler_fit(fx.vectors(spark, folder), "features"), path)
    return rounded_state(scaler.load_scaler(spark, path))


@query(sql(LINEAR_SCORE))
def scored_store(spark, folder):
    path = scratch_path(spark, "scored")
    tables.write_scored(linear_scored(spark, folder), path)
    rows = spark.read.parquet(path).select(
        "sample_id", F.posexplode(F.arrays_zip("target", "prediction")).alias("plevel", "z"))
    return rounded(rows.select("sample_id", "plevel", "z.target", "z.prediction"), 8, "target", "prediction")


def _pad(text: bytes) -> bytes:
    return struct.pack(">i", len(text)) + text + b"\0" * (-len(text) % 4)


def _netcdf(arrays: dict, dims: dict) -> bytes:
    """A classic netCDF file of double variables that share the given axes."""
    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims))
        out += b"".join(_pad(d.encode()) + struct.pack(">i", n) for d, n in dims.items())
        out += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(arrays))
        for name, begin in zip(arrays, begins):
            label = f"{name} of the derived cube".encode()
            out += _pad(name.encode()) + struct.pack(f">i{len(dims)}i", len(dims), *range(len(dims)))
            out += struct.pack(">ii", 12, 1) + _pad(b"long_name") + struct.pack(">i", 2) + _pad(label)
            out += struct.pack(">iii", 6, arrays[name].size * 8, begin)
        return out

    start = len(header([0] * len(arrays)))
    begins = [start + 8 * sum(a.size for a in list(arrays.values())[:i]) for i in range(len(arrays))]
    return header(begins) + b"".join(a.astype(">f8").tobytes() for a in arrays.values())


def export_netcdf(cells, path: str, names, steps: int) -> None:
    """Write a complete cube as one file per ``steps`` time steps, a task per file.

    The folder may lie in any store that ``sources.grid`` reads.
    """
    store, inner = grid._store(path)
    store.create_dir(inner)

    def save(pdf):
        block = int(pdf["time"].iloc[0]) // steps
        ordered = pdf.sort_values(["time", "plevel", "lat", "lon"])
        dims = {d: int(ordered[d].nunique()) for d in ("time", "plevel", "lat", "lon")}
        arrays = {n: ordered[n].to_numpy().reshape(tuple(dims.values())) for n in names}
        store, inner = grid._store(path)
        with store.open_output_stream(f"{inner}/part{block:05d}.nc") as f:
            f.write(_netcdf(arrays, dims))
        return pd.DataFrame({"block": np.array([block], dtype=np.int32)})

    cells.groupBy(F.expr(f"time div {steps}")).applyInPandas(save, "block INT").count()


def _exported(spark, folder) -> str:
    """The cube as netCDF files of ten steps each."""
    path = scratch_path(spark, "netcdf")
    export_netcdf(fx.cells(spark, folder), path, ["ucomp", "temp"], 10)
    return f"{path}/*.nc"


@query(sql("SELECT time, plevel, lat, lon, ucomp, temp FROM cells"))
def grid_load(spark, folder):
    """Files loaded in parallel as cells and put in line."""
    loaded = grid.read_grid(spark, _exported(spark, folder), ["ucomp", "temp"], steps=4, in_line=True)
    return loaded.drop("source")


@query(sql("SELECT time, lat, lon, plevel AS pos, ucomp, temp FROM cells"))
def grid_columns(spark, folder):
    """Files loaded in parallel as vertical columns and put in line."""
    loaded = grid.read_columns(spark, _exported(spark, folder), ["ucomp", "temp"], steps=4)
    return explode_levels(sources_in_line(loaded), ["ucomp", "temp"], COLUMN_KEY, "pos")


@query(sql("""SELECT time, plevel, lon, ucomp FROM cells WHERE lat = 2 AND plevel >= 3 AND plevel < 6
    AND time BETWEEN 4 AND 47"""))
def grid_band(spark, folder):
    """One latitude and a band of levels: the source reads those bytes only."""
    wanted = {"lat": 2, "plevel": {"from": 3, "to": 6}, "time": {"from": 4, "to": 48}}
    band = grid.read_grid(spark, _exported(spark, folder), ["ucomp"], steps=4, in_line=True, where=wanted)
    return band.select("time", "plevel", "lon", "ucomp")
