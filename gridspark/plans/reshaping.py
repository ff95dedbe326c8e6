"""Queries for projection, indexing, reshaping and joins."""

from pyspark.sql import functions as F

from gridspark.functions import midpoint_norm, ravel_index, unravel_index
from gridspark.operators import reshape as rs
from gridspark.operators.index import global_index
from gridspark.operators.split import row_range
from gridspark.operators.stats import minmax_scaled
from gridspark.plans import fixtures as fx
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.registry import query
from gridspark.runtime import scratch_path
from gridspark.sources import buckets as bk

CELL = ("time", "plevel", "lat", "lon")
SID = "(CAST(time AS BIGINT) * 5 + lat) * 5 + lon"


@query(sql("SELECT time, plevel, lat, lon, ucomp FROM cells"))
def variable_select(spark, folder):
    return rs.select_variables(fx.cells(spark, folder), ["ucomp"])


@query(sql("SELECT * FROM cells WHERE plevel >= 2 AND plevel < 6"))
def level_slice(spark, folder):
    return rs.slice_levels(fx.cells(spark, folder), 2, 6)


@query(sql("""SELECT sample_id, unnest(range(4)) AS pos, unnest(gwfu[2:5]) AS gwfu FROM vectors"""))
def level_slice_vectors(spark, folder):
    sliced = rs.slice_levels(fx.vectors(spark, folder), 1, 5, ["gwfu"])
    return sliced.select("sample_id", F.posexplode("gwfu").alias("pos", "gwfu"))


@query(sql("SELECT * FROM cells WHERE lat = 2"))
def lat_profile(spark, folder):
    return rs.select_lat(fx.cells(spark, folder), 2)


@query(sql(f"SELECT {SID} AS sample_id, plevel, ucomp FROM cells"), name="ravel_index")
def ravel_index_query(spark, folder):
    sid = ravel_index("time", "lat", "lon", fx.N_LAT, fx.N_LON)
    return fx.cells(spark, folder).select(sid.alias("sample_id"), "plevel", "ucomp")


@query(sql("""SELECT sample_id, CAST(sample_id // 150 AS INT) AS time,
    CAST(sample_id % 150 // 15 AS INT) AS lat, CAST(sample_id % 15 AS INT) AS lon FROM samples"""), name="unravel_index")
def unravel_index_query(spark, folder):
    where = unravel_index("sample_id", fx.OBS_LAT, fx.OBS_LON)
    return fx.samples(spark, folder).select("sample_id", *[c.alias(n) for n, c in where.items()])


@query(sql("""SELECT CAST(sample_id // 150 AS INT) AS time, lv AS plevel,
    CAST(sample_id % 150 // 15 AS INT) AS lat, CAST(sample_id % 15 AS INT) AS lon, gwfu[lv + 1] AS gwfu
    FROM vectors, (SELECT CAST(range AS INT) AS lv FROM range(6))"""))
def vectors_to_cells(spark, folder):
    return rs.vectors_to_cells(fx.vectors(spark, folder), ["gwfu"], fx.OBS_LAT, fx.OBS_LON)


@query(sql("""SELECT time, plevel, lat, lon, ucomp, CAST(lat AS DOUBLE) AS lat_index,
    CAST(lon AS DOUBLE) AS lon_index FROM cells"""))
def grid_index_features(spark, folder):
    return rs.with_grid_index(fx.cells(spark, folder).drop("temp"))


@query(sql("""SELECT time, lat, lon, plevel AS pos, ucomp, temp FROM cells"""))
def vertical_columns(spark, folder):
    columns = rs.to_columns(fx.cells(spark, folder), ["ucomp", "temp"])
    return rs.explode_levels(columns, ["ucomp", "temp"], rs.COLUMN_KEY, "pos")


@query(sql("""SELECT s.sample_id AS sample_id, lv AS plevel, coalesce(round(o.gwfu, 6), 0) AS gwfu,
    coalesce(round(o.ucomp, 6), 0) AS ucomp
    FROM (SELECT DISTINCT sample_id FROM observations) s
    CROSS JOIN (SELECT CAST(range AS INT) AS lv FROM range(7))
    LEFT JOIN observations o ON o.sample_id = s.sample_id AND o.plevel = lv"""))
def dense_columns(spark, folder):
    columns = rs.to_dense_columns(fx.observations(spark, folder), ["gwfu", "ucomp"],
                                  fx.OBS_LEVELS, ["sample_id"])
    rows = rs.explode_levels(columns, ["gwfu", "ucomp"])
    return rows.withColumns({c: F.round(c, 6) for c in ("gwfu", "ucomp")})


def _assembled(spark, folder):
    columns = rs.to_columns(fx.cells(spark, folder), ["ucomp", "temp"])
    joined = rs.join_surface(columns, fx.surface(spark, folder))
    return rs.assemble(joined, ["ucomp", "temp"], ["slp", "lat", "lon"])


ASSEMBLED = f"""
    SELECT {SID} AS sample_id, plevel AS idx, ucomp AS v FROM cells
    UNION ALL SELECT {SID}, 8 + plevel, temp FROM cells
    UNION ALL SELECT {SID}, 16, slp FROM surface
    UNION ALL SELECT {SID}, 17, CAST(lat AS DOUBLE) FROM surface
    UNION ALL SELECT {SID}, 18, CAST(lon AS DOUBLE) FROM surface"""


@query(sql(f"SELECT sample_id, CAST(idx AS INT) AS idx, v, 19 AS width FROM ({ASSEMBLED})"))
def assemble_features(spark, folder):
    sid = ravel_index("time", "lat", "lon", fx.N_LAT, fx.N_LON).alias("sample_id")
    return _assembled(spark, folder).select(sid, F.posexplode("features").alias("idx", "v"), "width")


@query(sql(f"""SELECT sample_id, CAST(CASE WHEN idx = 16 THEN 0 WHEN idx < 8 THEN idx + 9 WHEN idx < 16 THEN idx - 7
    ELSE idx END AS INT) AS idx, v, 19 AS width FROM ({ASSEMBLED})"""))
def assemble_in_order(spark, folder):
    """Features as a user lists them: a single one first."""
    sid = ravel_index("time", "lat", "lon", fx.N_LAT, fx.N_LON).alias("sample_id")
    columns = _assembled(spark, folder).drop("features", "width")
    found = rs.assemble(columns, ["temp", "ucomp"], ["slp", "lat", "lon"], order=["slp", "temp", "ucomp", "lat", "lon"])
    return found.select(sid, F.posexplode("features").alias("idx", "v"), "width")


@query(sql(f"""SELECT sample_id, CAST(CASE WHEN idx >= 17 THEN idx - 9 ELSE idx END AS INT) AS idx, v
    FROM ({ASSEMBLED}) WHERE idx < 8 OR idx >= 17"""))
def feature_subset(spark, folder):
    layout = rs.feature_layout(["ucomp", "temp"], ["slp", "lat", "lon"], fx.LEVELS)
    sid = ravel_index("time", "lat", "lon", fx.N_LAT, fx.N_LON).alias("sample_id")
    subset = rs.feature_subset(_assembled(spark, folder), ["ucomp", "lat", "lon"], layout)
    return subset.select(sid, F.posexplode("features").alias("idx", "v"))


@query(sql("""SELECT sample_id, CAST(unnest(range(6)) AS INT) AS plevel, unnest(gwfu) AS gwfu,
    unnest(gwfv) AS gwfv FROM vectors"""))
def explode_levels(spark, folder):
    return rs.explode_levels(fx.vectors(spark, folder), ["gwfu", "gwfv"])


@query(sql("SELECT sample_id, list_sum(gwfu) AS total, len(gwfv) AS width, gwfu[1] AS first, gwfv[6] AS last FROM vectors"))
def stack_levels(spark, folder):
    rows = rs.explode_levels(fx.vectors(spark, folder), ["gwfu", "gwfv"])
    back = rs.stack_levels(rows, ["gwfu", "gwfv"])
    total = F.aggregate("gwfu", F.lit(0.0), lambda t, x: t + x)
    return back.select("sample_id", total.alias("total"), F.size("gwfv").cast("bigint").alias("width"),
                       F.col("gwfu")[0].alias("first"), F.col("gwfv")[5].alias("last"))


@query(sql("""SELECT time, plevel, lat, lon, 'ucomp_' || time || '_' || plevel || '_' || lat || '_' || lon AS label
    FROM cells"""))
def cell_labels(spark, folder):
    return rs.cell_labels(fx.cells(spark, folder), "ucomp").select(*CELL, "label")


@query(sql("SELECT slp, 'slp_' || time || '_' || lat || '_' || lon AS label FROM surface"))
def surface_labels(spark, folder):
    return rs.surface_labels(fx.surface(spark, folder)).select("slp", "label")


@query(sql("""SELECT block, feature, plevel, feature || ' ' || (13 - plevel) AS name
    FROM (SELECT DISTINCT plevel FROM cells) CROSS JOIN (VALUES (0, 'u'), (1, 'v')) AS f(block, feature)"""))
def feature_names(spark, folder):
    found = fx.cells(spark, folder).select("plevel").distinct()
    return rs.feature_names(found, ["u", "v"])


@query(sql("SELECT sample_id, plevel, target * 1e-7 AS target, prediction * 1e-7 AS prediction FROM pairs"))
def rescale(spark, folder):
    return rs.rescale(fx.pairs(spark, folder), ["target", "prediction"], 1e-7)


@query(sql("""SELECT sample_id, gwfu, pos FROM (
    SELECT *, row_number() OVER (ORDER BY gwfu, sample_id) - 1 AS pos FROM samples)
    WHERE pos >= 400 AND pos < 500"""), name="row_range")
def row_range_query(spark, folder):
    placed = global_index(fx.samples(spark, folder), ["gwfu", "sample_id"])
    return row_range(placed, 400, 500)


@query(sql("""SELECT time, plevel, lat, lon, t.ucomp AS target, round(p.ucomp, 9) AS prediction,
    round(t.ucomp - p.ucomp, 9) AS difference
    FROM cells t JOIN forecast p USING (time, plevel, lat, lon)"""))
def difference_field(spark, folder):
    both = rs.difference(fx.cells(spark, folder), fx.forecast(spark, folder), CELL, "ucomp")
    return both.withColumns({c: F.round(c, 9) for c in ("prediction", "difference")})


@query(sql("""SELECT time, plevel, lat, lon, round(CASE WHEN ucomp <= 2 THEN 0 WHEN ucomp >= 60 THEN 1
    WHEN ucomp < 10 THEN (ucomp - 2) / 8 * 0.5 ELSE (ucomp - 10) / 50 * 0.5 + 0.5 END, 9) AS norm FROM cells"""), name="midpoint_norm")
def midpoint_norm_query(spark, folder):
    return fx.cells(spark, folder).select(*CELL, F.round(midpoint_norm("ucomp", 2, 10, 60), 9).alias("norm"))


@query(sql("""SELECT time, plevel, lat, lon, round((ucomp - lo) / (hi - lo), 9) AS norm
    FROM cells, (SELECT min(ucomp) AS lo, max(ucomp) AS hi FROM cells)"""), name="minmax_norm")
def minmax_norm_query(spark, folder):
    return minmax_scaled(fx.cells(spark, folder), "ucomp").select(*CELL, F.round("norm", 9).alias("norm"))


@query(sql("""SELECT sample_id, round(avg(gwfu), 6) AS gwfu, round(avg(ucomp), 6) AS ucomp, o_totalprice AS total
    FROM observations JOIN orders ON o_orderkey = sample_id GROUP BY sample_id, o_totalprice"""))
def paste_join(spark, folder):
    seen = fx.observations(spark, folder)
    totals = fx.samples(spark, folder).withColumnRenamed("gwfu", "total")
    return rs.paste_features([
        seen.groupBy("sample_id").agg(F.round(F.avg("gwfu"), 6).alias("gwfu")),
        seen.groupBy("sample_id").agg(F.round(F.avg("ucomp"), 6).alias("ucomp")),
        totals])


ZIPPED = """SELECT a.sample_id AS sample_id, a.gwfu AS total, round(u.m, 6) AS gwfu, round(v.m, 6) AS gwfv
    FROM samples a
    JOIN (SELECT l_orderkey AS k, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) u
      ON u.k = a.sample_id
    JOIN (SELECT l_orderkey AS k, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) v
      ON v.k = a.sample_id"""


def _features_and_targets(spark, folder):
    lines = fx.table(spark, folder, "lineitem")

    def target(kept, name):
        return lines.where(kept).groupBy(
            F.col("l_orderkey").alias("sample_id")).agg(F.round(F.avg("l_extendedprice"), 6).alias(name))

    features = fx.samples(spark, folder).withColumnRenamed("gwfu", "total")
    return features, target(F.col("l_returnflag") == "A", "gwfu"), target(F.col("l_returnflag") != "A", "gwfv")


@query(sql(ZIPPED))
def zip_join(spark, folder):
    return rs.zip_join(*_features_and_targets(spark, folder))


@query(sql(ZIPPED))
def bucketed_zip_join(spark, folder):
    """Features and targets written in buckets once; the join itself moves nothing."""
    parts = _features_and_targets(spark, folder)
    buckets = bk.buckets_for(parts[0].count(), 100_000)
    names = []
    for part in parts:
        path = scratch_path(spark, "buckets")
        names.append("zip_" + path.rsplit("-", 1)[-1])
        bk.write_bucketed(part, names[-1], path, buckets)
    return bk.paste_bucketed(spark, names)


@query(sql("SELECT time, lat, lon, plevel, ucomp, slp FROM cells JOIN surface USING (time, lat, lon)"))
def surface_join(spark, folder):
    return rs.join_surface(fx.cells(spark, folder).drop("temp"), fx.surface(spark, folder))


@query(sql("""SELECT time, lat, lon, plevel, ucomp, hpa, CAST(trunc(hpa) AS INT) AS hpa_label
    FROM cells JOIN levels USING (plevel)"""))
def level_labels(spark, folder):
    return rs.with_level_names(fx.cells(spark, folder).drop("temp"), fx.levels(spark))
