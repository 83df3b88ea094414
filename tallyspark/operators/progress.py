"""Training logs: the best epoch so far, and where early stopping would have stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(logs: DataFrame, run: list[str], epoch: str, metric: str, higher: bool = True) -> DataFrame:
    """best (the running best metric) and is_best (this epoch improved it)."""
    sign = 1 if higher else -1
    before = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.col(metric) * sign).over(before)
    now = F.col(metric) * sign
    return logs.withColumn("best", F.greatest(now, top) * sign).withColumn("is_best", F.coalesce(now > top, F.col(metric).isNotNull()))


def stopped_at(logs: DataFrame, run: list[str], epoch: str, metric: str, patience: int = 3, threshold: float = 0.001, higher: bool = True) -> DataFrame:
    """(run, stop): the first epoch with `patience` epochs in a row up to it that don't beat the best before them by the threshold; null if none."""
    sign = 1 if higher else -1
    w = Window.partitionBy(*run).orderBy(epoch)
    top = F.max(F.col(metric) * sign).over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = F.coalesce(F.col(metric) * sign > top + threshold, F.lit(True))
    at = logs.withColumn("__i", improved).withColumn("__n", F.row_number().over(w))
    last = F.max(F.when(F.col("__i"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    waited = at.withColumn("__w", F.col("__n") - last)
    return waited.groupBy(*run).agg(F.min(F.when(F.col("__w") >= patience, F.col(epoch))).alias("stop"))
