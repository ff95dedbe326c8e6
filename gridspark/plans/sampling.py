"""Queries for positions, samples, splits, batches and scaling."""

from pyspark.sql import functions as F

from gridspark.operators import index, scaler, split
from gridspark.plans import fixtures as fx
from gridspark.plans.fixtures import with_tables as sql
from gridspark.plans.registry import query

SEED = 7
RANKED = f"""SELECT sample_id, gwfu, row_number() OVER (ORDER BY md5('{SEED}:' || sample_id)) - 1 AS pos
    FROM samples"""


def ranked(spark, folder):
    return index.shuffle_rank(fx.samples(spark, folder), SEED)


@query(sql(f"SELECT sample_id, gwfu FROM samples ORDER BY md5('{SEED}:' || sample_id) LIMIT 1000"))
def sample_exact(spark, folder):
    return index.sample_exact(fx.samples(spark, folder), 1000, SEED)


@query(sql(RANKED))
def shuffle_rank(spark, folder):
    return ranked(spark, folder)


@query(sql("""SELECT sample_id, plevel, round(ucomp, 6) AS ucomp,
    row_number() OVER (ORDER BY plevel, sample_id) - 1 AS pos FROM observations"""))
def global_index(spark, folder):
    rows = fx.observations(spark, folder).select("sample_id", "plevel", F.round("ucomp", 6).alias("ucomp"))
    return index.global_index(rows, ["plevel", "sample_id"])


@query(sql("""SELECT n AS total_samples, CAST(floor(n * 0.1) AS BIGINT) AS num_test_samples,
    CAST(floor(n * 0.05) AS BIGINT) AS num_val_samples,
    n - CAST(floor(n * 0.1) AS BIGINT) - CAST(floor(n * 0.05) AS BIGINT) AS num_train_samples
    FROM (SELECT count(*) AS n FROM samples)"""))
def split_counts(spark, folder):
    return split.split_counts(fx.samples(spark, folder), 0.1, 0.05)


CHUNKED = f"""
    WITH r AS ({RANKED}),
    c AS (SELECT n, CAST(floor(n * 0.1) AS BIGINT) AS te, CAST(floor(n * 0.05) AS BIGINT) AS va
          FROM (SELECT count(*) AS n FROM samples)),
    b AS (SELECT *, n - te - va AS tr, least(te, va, 700) AS b FROM c),
    s AS (SELECT sample_id, gwfu, pos, CASE WHEN pos // b * b < tr THEN 'train'
          WHEN pos // b * b < tr + va THEN 'val' ELSE 'test' END AS split
          FROM r, b WHERE pos < ceil(n / b) * b)
"""


def _chunked(spark, folder, **options):
    rows = fx.samples(spark, folder)
    return split.chunked_split(ranked(spark, folder), rows.count(), 0.1, 0.05, 700, **options)


@query(sql(CHUNKED + "SELECT sample_id, pos, split FROM s"))
def chunked_split(spark, folder):
    return _chunked(spark, folder).drop("gwfu")


@query(sql(CHUNKED + "SELECT sample_id, split, CASE WHEN split = 'test' THEN gwfu END AS gwfu FROM s"))
def split_skip_labels(spark, folder):
    out = _chunked(spark, folder, skip_labels=True, targets=("gwfu",))
    return out.select("sample_id", "split", "gwfu")


@query(sql(f"""SELECT sample_id, pos, CASE WHEN pos < CAST(trunc(n * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS split
    FROM ({RANKED}), (SELECT count(*) AS n FROM samples)"""))
def tail_split(spark, folder):
    n = fx.samples(spark, folder).count()
    return split.tail_split(ranked(spark, folder), n, 0.2).drop("gwfu")


BATCH, CHUNK = 32, 100


@query(sql(f"""
    WITH k AS (SELECT CAST(floor({BATCH} / count(DISTINCT source)) AS BIGINT) AS per FROM vectors),
    r AS (SELECT sample_id, source,
          (row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || sample_id)) - 1) // {CHUNK} AS chunk
          FROM vectors),
    m AS (SELECT *, row_number() OVER (PARTITION BY source, chunk ORDER BY md5('{SEED}/mix:' || sample_id)) - 1 AS rk,
          count(*) OVER (PARTITION BY source, chunk) AS rows FROM r),
    f AS (SELECT sample_id, source, chunk * ({CHUNK} // per) + rk // per AS batch_id
          FROM m, k WHERE rk < rows // per * per),
    n AS (SELECT source, max(batch_id) + 1 AS batches FROM f GROUP BY source)
    SELECT sample_id, source, batch_id + lap * batches AS batch_id
    FROM f JOIN n USING (source), (SELECT unnest(range(8)) AS lap)
    WHERE batch_id + lap * batches < (SELECT 2 * (count(*) // {BATCH}) FROM vectors)"""))
def minibatches(spark, folder):
    """Two epochs of balanced batches; each source starts over when it runs out."""
    rows = fx.vectors(spark, folder).select("sample_id", "source")
    steps = 2 * split.batches_per_epoch(rows.count(), BATCH)
    return split.minibatches(rows, BATCH, CHUNK, SEED, steps=steps)


@query(sql("""SELECT CAST(trunc(n * k / 256) AS BIGINT) AS batches, n AS samples, k AS sources FROM (
    SELECT count(*) FILTER (y = first_y) AS n, count(DISTINCT y) AS k FROM (
      SELECT year(l_shipdate) AS y, min(year(l_shipdate)) OVER () AS first_y FROM lineitem))"""))
def batches_per_epoch(spark, folder):
    per_source = fx.table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").alias("source")).count()
    totals = per_source.agg(F.min_by("count", "source").alias("samples"), F.count("*").alias("sources"))
    row = totals.first()
    batches = split.batches_per_epoch(row.samples * row.sources, 256)
    return totals.withColumn("batches", F.lit(batches).cast("bigint"))


@query(sql(f"""
    WITH b AS (SELECT sample_id, idx, md5('{SEED}:' || sample_id || ':' || idx) AS h
               FROM vectors, (SELECT range AS idx FROM range(52)))
    SELECT sample_id, CAST(idx AS INT) AS idx, round(sqrt(-2 * ln((CAST('0x' || substr(h, 1, 8) AS BIGINT) + 1)
      / 4294967296.0::DOUBLE)) * cos(CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE * 2 * pi()), 8)
      AS v FROM b"""))
def random_control(spark, folder):
    drawn = split.random_control(fx.vectors(spark, folder), SEED, fx.FEATURES)
    return drawn.select("sample_id", F.posexplode("features").alias("idx", "v")).withColumn("v", F.round("v", 8))


@query(sql(f"""SELECT sample_id, pos, CASE WHEN pos < 4500 THEN 'background' ELSE 'test' END AS role
    FROM ({RANKED}) WHERE pos < 9500"""))
def attribution_split(spark, folder):
    return split.attribution_split(ranked(spark, folder)).drop("gwfu")


@query(sql(f"SELECT sample_id, gwfu, pos FROM ({RANKED}) WHERE pos < 3000"))
def eval_subsample(spark, folder):
    return split.eval_subsample(ranked(spark, folder), 2500, 1000)


FITTED = """SELECT CAST(idx AS INT) AS idx, count(v) AS n, avg(v) AS mean, var_pop(v) * count(v) AS m2 FROM (
    SELECT unnest(range(52)) AS idx, unnest(features) AS v FROM vectors) GROUP BY idx"""


def rounded_state(state):
    return state.withColumns({c: F.round(c, 8) for c in ("mean", "m2")})


@query(sql(f"SELECT idx, n, round(mean, 8) AS mean, round(m2, 8) AS m2 FROM ({FITTED})"))
def scaler_fit(spark, folder):
    return rounded_state(scaler.scaler_fit(fx.vectors(spark, folder), "features"))


@query(sql(f"SELECT idx, n, round(mean, 8) AS mean, round(m2, 8) AS m2 FROM ({FITTED})"))
def scaler_partial_fit(spark, folder):
    """Fit both sources apart and merge: the same as one fit of all rows."""
    rows = fx.vectors(spark, folder)
    first = scaler.scaler_fit(rows.where(F.col("source") == 0), "features")
    return rounded_state(scaler.scaler_merge(first, scaler.scaler_fit(rows.where(F.col("source") != 0), "features")))


@query(sql(f"""SELECT sample_id, idx, round((v - mean) / CASE WHEN m2 > 0 THEN sqrt(m2 / n) ELSE 1 END, 8) AS v
    FROM (SELECT sample_id, CAST(unnest(range(52)) AS INT) AS idx, unnest(features) AS v FROM vectors)
    JOIN ({FITTED}) USING (idx)"""))
def scaler_transform(spark, folder):
    rows = fx.vectors(spark, folder)
    scaled = scaler.scaler_transform(rows, scaler.scaler_fit(rows, "features"), "features")
    return scaled.select("sample_id", F.posexplode("features").alias("idx", "v")).withColumn("v", F.round("v", 8))


@query(sql("SELECT sample_id, CAST(unnest(range(52)) AS INT) AS idx, round(unnest(features), 8) AS v FROM vectors"))
def scaler_inverse(spark, folder):
    """Scale and unscale: back to the start."""
    rows = fx.vectors(spark, folder)
    state = scaler.scaler_fit(rows, "features")
    back = scaler.scaler_inverse(scaler.scaler_transform(rows, state, "features"), state, "features")
    return back.select("sample_id", F.posexplode("features").alias("idx", "v")).withColumn("v", F.round("v", 8))


# Element 3 has no number in any row; element 5 lacks one in every fourth.
GAPS = """(SELECT sample_id, CAST(unnest(range(52)) AS INT) AS idx, unnest(features) AS raw FROM vectors)"""
GAPPED = f"""SELECT sample_id, idx, CASE WHEN idx = 3 OR (idx = 5 AND sample_id % 4 = 0) THEN NULL ELSE raw END AS v
    FROM {GAPS}"""


def gapped(spark, folder):
    rows = fx.vectors(spark, folder)
    holes = F.transform("features", lambda x, i: F.when(i == 3, float("nan")).when(
        (i == 5) & (F.pmod("sample_id", F.lit(4)) == 0), None).otherwise(x))
    return rows.select("sample_id", holes.alias("features"))


@query(sql(f"""SELECT idx, count(v) AS n, round(avg(v), 8) AS mean, round(var_pop(v) * count(v), 8) AS m2
    FROM ({GAPPED}) GROUP BY idx"""))
def scaler_fit_gaps(spark, folder):
    return rounded_state(scaler.scaler_fit(gapped(spark, folder), "features"))


@query(sql(f"""WITH s AS (SELECT idx, avg(v) AS mean, var_pop(v) AS var FROM ({GAPPED}) GROUP BY idx)
    SELECT sample_id, idx, round((v - mean) / CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END, 8) AS scaled,
      round(CASE WHEN idx = 3 THEN NULL ELSE v END, 8) AS back FROM ({GAPPED}) JOIN s USING (idx)"""))
def scaler_gaps(spark, folder):
    """Scaled, and scaled back, with an element that has no number: no neighbour moves."""
    rows = gapped(spark, folder)
    state = scaler.scaler_fit(rows, "features")
    scaled = scaler.scaler_transform(rows, state, "features", "scaled")
    back = scaler.scaler_inverse(scaled, state, "scaled", "back")
    both = back.select("sample_id", F.posexplode(F.arrays_zip("scaled", "back")).alias("idx", "_z"))
    return both.select("sample_id", "idx", F.round("_z.scaled", 8).alias("scaled"), F.round("_z.back", 8).alias("back"))
