"""The seven user commands as Spark jobs over shared paths: ingest, extract, split, train,
evaluate, attribute, compare. Each reads tables an earlier one wrote; nothing is passed
by row order, everything by ``sample_id``.
"""

from __future__ import annotations

import glob
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import ravel_index
from gridspark.operators import (
    experiments, histogram, index, metrics, outliers, reshape, scaler, scoring, stats, training,
)
from gridspark.operators import profiles as climate
from gridspark.operators import split as splits
from gridspark.runtime import scratch_path
from gridspark.sources import grid, tables

# Default features in vector order, target variables, levels kept and shown.
FEATURES = ("temp", "hght", "ucomp", "vcomp", "omega", "slp", "lat", "lon")
TARGETS = {"gwfu": "gwfu_cgwd", "gwfv": "gwfv_cgwd"}
PLEVELS = 40
TARGET_LEVELS = 33
PANELS = {13: "10 hPa", 20: "50 hPa", 23: "100 hPa", 27: "200 hPa"}


def ingest(spark: SparkSession, path: str, out: str, variables, surface_variables=("slp",),
           scatter_points: int = 100_000, seed: int = 0) -> None:
    """netCDF files to Parquet cubes, with a summary and distributions of the targets.

    Several files are put end to end in time, in the order of their names.
    """
    cells = grid.read_grid(spark, path, variables, in_line=True)
    tables.write_cube(cells, f"{out}/cells", by="source")
    if surface_variables:
        surface = grid.read_grid(spark, path, surface_variables, in_line=True)
        tables.write_cube(surface, f"{out}/surface", by="source")
    stored = spark.read.parquet(f"{out}/cells")
    # What the files say about their variables; the first file speaks for all.
    meta = grid.read_variables(spark, sorted(glob.glob(path))[0])
    summary = stats.feature_summary(stored, variables, meta)
    if surface_variables:
        flat = spark.read.parquet(f"{out}/surface")
        summary = summary.unionByName(stats.feature_summary(flat, surface_variables, meta, ("time", "lat", "lon")))
    tables.write_summary_json(summary, f"{out}/summary")
    targets = [v for v in TARGETS.values() if v in variables]
    for name in targets:
        kept = outliers.remove_outliers(stored.select(name), name)
        histogram.normalise_histogram(histogram.histogram(kept, name)).write.mode(
            "overwrite").parquet(f"{out}/distribution/{name}")
        stats.box_stats(kept, name).write.mode("overwrite").parquet(f"{out}/box/{name}")
    if len(targets) == 2:
        low = stored.where(F.col("plevel") < TARGET_LEVELS)
        cell = F.concat_ws(":", "time", "plevel", "lat", "lon")
        points, marginals = stats.joint_scatter(low.withColumn("cell", cell), targets[1], targets[0],
                                                scatter_points, seed, "cell")
        points.write.mode("overwrite").parquet(f"{out}/scatter")
        marginals.write.mode("overwrite").parquet(f"{out}/scatter_marginals")


def extract(spark: SparkSession, source: str, out: str, n_lat: int, n_lon: int, features=FEATURES,
            plevels: int = PLEVELS, target_levels: int = TARGET_LEVELS, num_samples: int | None = None,
            shuffle: bool = True, seed: int = 0) -> None:
    """One row per vertical column: features, both targets, and a position.

    ``source`` is an ingested folder, or a glob of netCDF files, which are read as columns
    and need no shuffle to build them.
    """
    vertical = [f for f in features if f not in tables.SINGLE_LEVEL]
    single = [f for f in features if f in tables.SINGLE_LEVEL]
    variables = [*vertical, *TARGETS.values()]
    sample_id = ravel_index("time", "lat", "lon", n_lat, n_lon).alias("sample_id")
    if source.endswith(".nc"):
        surface = ["slp"] if "slp" in single else []
        columns = grid.read_columns(spark, source, [*variables, *surface], in_line=True)
        ids = spark.range(grid.count_columns(source, variables[0])).withColumnRenamed("id", "sample_id")
        columns = index.sample_by_ids(columns.withColumn("sample_id", sample_id), ids, num_samples, seed)
    else:
        cells = spark.read.parquet(f"{source}/cells").withColumn("sample_id", sample_id)
        # The top level has one row per column; only cells of drawn columns are shuffled.
        top = cells.where(F.col("plevel") == 0)
        cells = index.sample_by_ids(cells, top, num_samples, seed)
        columns = reshape.to_columns(cells, variables, max(plevels, target_levels))
        if "slp" in single:
            surface = spark.read.parquet(f"{source}/surface").select("time", "lat", "lon", "slp")
            columns = reshape.join_surface(columns, surface)
    columns = reshape.slice_levels(columns, 0, plevels, vertical)
    columns = reshape.slice_levels(columns, 0, target_levels, TARGETS.values())
    rows = reshape.assemble(columns, vertical, single, order=features).select(
        sample_id, "features", *[F.col(v).alias(t) for t, v in TARGETS.items()])
    # Built once, then ranked: the rank's counting pass reads back the ids alone.
    built = scratch_path(spark, "columns")
    rows.write.parquet(built)
    rows = spark.read.parquet(built)
    # A second seed for the order, or the sample's order would follow its own draw.
    placed = (index.shuffle_rank(rows, f"{seed}/order") if shuffle
              else index.global_index(rows, ["sample_id"]))
    placed.write.mode("overwrite").parquet(f"{out}/samples")
    stored = spark.read.parquet(f"{out}/samples")
    tables.dataset_metadata(stored, features, plevels, target_levels).write.mode(
        "overwrite").parquet(f"{out}/metadata")


def split(spark: SparkSession, source: str, out: str, test_split: float = 0.1, val_split: float = 0.05,
          batch_size: int = 100_000, skip_labels: bool = False, scaler_path: str | None = None) -> None:
    """Train, validation and test rows, and scalers fitted on (or carried on with) train."""
    samples = spark.read.parquet(f"{source}/samples")
    sizes = (samples.count(), test_split, val_split, batch_size)
    labelled = splits.chunked_split(samples, *sizes, skip_labels=skip_labels)
    labelled.write.mode("overwrite").partitionBy("split").parquet(f"{out}/samples")
    # Scalers see the targets even where the written rows leave them out.
    train = splits.chunked_split(samples, *sizes).where(F.col("split") == "train")
    for col in ("features", "gwfu", "gwfv"):
        state = scaler.scaler_fit(train, col)
        if scaler_path:
            state = scaler.scaler_merge(scaler.load_scaler(spark, f"{scaler_path}/{col}"), state)
        scaler.save_scaler(state, f"{out}/scaler/{col}")
    counts = tables.metadata_of(splits.split_counts(samples, test_split, val_split), version=1)
    tables.merge_metadata(spark.read.parquet(f"{source}/metadata"), counts).write.mode(
        "overwrite").parquet(f"{out}/metadata")


def train(spark: SparkSession, sources, scaler_path: str, out: str, target: str = "gwfu",
          batch_size: int = 256, chunk_size: int = 500_000, seed: int = 0, random_inputs: bool = False,
          validation_steps: int | None = None, epochs: int = 10, steps_per_epoch: int | None = 1000,
          **options) -> None:
    """Train on the train rows of one or several split folders in balanced batches.

    ``random_inputs`` trains a control on N(0, 1) draws instead of the scaled features. With
    ``validation_steps`` an epoch is judged on that many batches of the validation rows.
    """
    rows = tables.read_sources(spark, {s: f"{s}/samples" for s in sources})
    x_state = scaler.load_scaler(spark, f"{scaler_path}/features")
    y_state = scaler.load_scaler(spark, f"{scaler_path}/{target}")

    def scaled(part):
        kept = rows.where(F.col("split") == part)
        x = (splits.random_control(kept, seed, x_state.count()) if random_inputs
             else scaler.scaler_transform(kept, x_state, "features"))
        return scaler.scaler_transform(x, y_state, target, "target").select(
            "source", "sample_id", "features", "target")

    batches = splits.minibatches(scaled("train"), batch_size, chunk_size, seed)
    if steps_per_epoch is not None:
        # A source that is longer never gets further than the steps taken.
        batches = batches.where(F.col("batch_id") < epochs * steps_per_epoch)
    val = scaled("val")
    if validation_steps is not None:
        val = splits.minibatches(val, batch_size, chunk_size, seed)
    weights, log = training.train_mlp(batches, val=None if val.isEmpty() else val, val_steps=validation_steps,
                                      seed=seed, epochs=epochs, steps_per_epoch=steps_per_epoch,
                                      checkpoint_path=f"{out}/checkpoints", **options)
    weights.write.mode("overwrite").parquet(f"{out}/weights")
    log.write.mode("overwrite").parquet(f"{out}/log")


def evaluate(spark: SparkSession, source: str, scaler_path: str, model: str, out: str, target: str = "gwfu",
             num_samples: int | None = None, remove_outliers: float | None = None,
             random_inputs: bool = False, bins: int = 1000, panels=PANELS, levels: DataFrame | None = None,
             seed: int = 0) -> None:
    """Scores; metrics, distributions and correlation by level; statistics by sample."""
    rows = spark.read.parquet(f"{source}/samples")
    if num_samples is not None:
        rows = splits.eval_subsample(rows, num_samples)
    x_state = scaler.load_scaler(spark, f"{scaler_path}/features")
    weights = spark.read.parquet(f"{model}/weights")
    y_state = scaler.load_scaler(spark, f"{scaler_path}/{target}")
    if random_inputs:
        # Scaled inputs become N(0, 1) draws, so they bypass the feature scaler.
        drawn = splits.random_control(rows, seed, x_state.count())
        scored = scaler.scaler_inverse(scoring.predict(drawn, weights), y_state, "prediction").select(
            "sample_id", F.col(target).alias("target"), "prediction")
    else:
        scored = scoring.batch_score(rows, weights, x_state, y_state, target)
    tables.write_scored(scored, f"{out}/scored")
    scored = spark.read.parquet(f"{out}/scored")
    pairs = reshape.explode_levels(scored, ["target", "prediction"])
    by_level = metrics.level_metrics(pairs)
    if remove_outliers is not None:
        pairs = outliers.remove_paired_outliers(pairs, remove_outliers)
        by_level = by_level.drop("r_squared").join(metrics.level_r2(pairs), "plevel")
    tables.write_metrics(by_level, f"{out}/level_metrics")
    tables.write_metrics(metrics.sample_stats(scored), f"{out}/sample_metrics")
    tables.write_metrics(histogram.histogram_pair(pairs, bins), f"{out}/distributions")
    levels = reshape.levels_table(spark) if levels is None else levels
    tables.write_metrics(metrics.r2_profile(pairs, levels), f"{out}/r2_profile")
    limits = stats.value_limits(pairs, ["target", "prediction"], symmetric=True, pad=1.2, by=["plevel"])
    tables.write_metrics(metrics.level_panels(pairs, levels, panels).join(limits, "plevel"), f"{out}/panels")


def attribute(spark: SparkSession, source: str, scaler_path: str, model: str, out: str, level: int = 13,
              background: int = 4500, test: int = 5000, block=None, n_permutations: int = 32, k: int = 7,
              along_path: bool = False) -> None:
    """Mean contribution of each feature to one output level, and the top k.

    ``along_path`` takes gradients along the way from the background, ``n_permutations`` draws
    of it for each sample, in place of features replaced one by one.
    """
    rows = spark.read.parquet(f"{source}/samples")
    scaled = scaler.scaler_transform(rows, scaler.load_scaler(spark, f"{scaler_path}/features"), "features")
    parts = splits.attribution_split(scaled, background, test)
    explain = scoring.path_attribution if along_path else scoring.attribution
    found = explain(parts.where("role = 'test'"), parts.where("role = 'background'"),
                    spark.read.parquet(f"{model}/weights"), level, block, n_permutations)
    found.write.mode("overwrite").parquet(f"{out}/attribution")
    top = scoring.attribution_topk(spark.read.parquet(f"{out}/attribution"), k)
    top.write.mode("overwrite").parquet(f"{out}/top")


def profiles(spark: SparkSession, truth, scored, out: str, n_lat: int, n_lon: int, lat: int,
             window: int = climate.WINDOW_STEPS) -> None:
    """Scores to climate profiles: windowed zonal means of truth and prediction, and their difference.

    ``truth`` is one folder of (sample_id, target, …) or a list, put in line as years in that
    order; ``scored`` likewise of (sample_id, prediction, …).
    """
    def cells(paths, col):
        years = [spark.read.parquet(p) for p in ([paths] if isinstance(paths, str) else paths)]
        years = [reshape.vectors_to_cells(y, [col], n_lat, n_lon).withColumnRenamed(col, "value") for y in years]
        return climate.sources_in_line(tables.tagged(years)).drop("source")

    both = climate.profile_difference(cells(truth, "target"), cells(scored, "prediction"),
                                      col="value", lat=lat, window=window)
    both.write.mode("overwrite").parquet(f"{out}/profiles")


def compare(spark: SparkSession, runs: dict[tuple[str, str], str], out: str, registry=experiments.EXPERIMENTS,
            exclusions=experiments.EXCLUSIONS) -> DataFrame:
    """Rank evaluated runs, given as {(experiment, target): folder}, per target and level.

    Also written: the mean, the box statistics, and the matrix of registered experiments by
    level and target, without the excluded pairs.
    """
    tagged = [
        spark.read.parquet(f"{path}/level_metrics")
        .withColumn("experiment", F.lit(name)).withColumn("target", F.lit(target))
        for (name, target), path in runs.items()
    ]
    found = reduce(DataFrame.unionByName, tagged)
    experiments.experiment_rank(found).write.mode("overwrite").parquet(f"{out}/ranks")
    experiments.experiment_mean_r2(found).write.mode("overwrite").parquet(f"{out}/mean_r2")
    experiments.experiment_box(found).write.mode("overwrite").parquet(f"{out}/box")
    experiments.experiment_matrix(
        found, experiments.experiment_registry(spark, registry), experiments.exclusion_table(spark, exclusions),
    ).write.mode("overwrite").parquet(f"{out}/matrix")
    return spark.read.parquet(f"{out}/ranks")
