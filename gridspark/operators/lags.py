"""Temporal lag stacks: each column with its own past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_stack(columns: DataFrame, col: str, step_size: int = 1, start_time: int = 1,
              num_steps: int = 64, key=("lat", "lon"), out: str = "lags",
              block: int | None = None) -> DataFrame:
    """Add an array of ``col`` at time - start_time - k * step_size, k = 0 … num_steps-1.

    Rows without a full history are dropped. The time axis is cut in blocks, each with
    a copy of the history it needs from the block before, so a window never holds more
    than one block of one grid point however long the record is.
    """
    reach = start_time + (num_steps - 1) * step_size
    block = max(block or 4 * reach, reach, 1)
    own = F.floor(F.col("time") / block)
    halo = F.col("time") % block >= block - reach
    copies = F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))
    spread = columns.withColumn("_block", F.explode(copies))
    past = Window.partitionBy(*key, "_block").orderBy("time").rangeBetween(-reach, -start_time)
    seen = F.collect_list(F.struct(F.col("time").alias("t"), F.col(col).alias("v"))).over(past)
    stacked = spread.withColumn("_seen", seen).where(F.floor(F.col("time") / block) == F.col("_block"))
    newest_first = F.filter(F.reverse("_seen"), lambda s: (
        F.col("time") - start_time - s["t"]) % step_size == 0)
    return stacked.withColumn(out, F.transform(newest_first, lambda s: s["v"])).where(
        F.size(out) == num_steps).drop("_block", "_seen")
