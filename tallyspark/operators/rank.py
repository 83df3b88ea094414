"""Candidate ranking: choose the best-scored candidate of each item, and roll accuracies up.

Inputs are long tables, one row a candidate. Items, not rows, are what shuffles: one aggregation with
map-side combine picks the winner, a second one counts. Missing scores rank last; exact ties go to the
smallest candidate index, or by `tie="hash"` to the smallest hash of item and candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalars import lowest_if_missing, ratio
from . import ordinals


def choose(scores: DataFrame, item: list[str], score: str = "logprob", index: str = "cand_idx", carry: list[str] = (), tie: str = "first") -> DataFrame:
    """One row for each item: its winning index as `chosen`, the number of candidates, and `carry` columns (which have to be constant in an item). Exact ties: tie_sizes."""
    s = lowest_if_missing(F.col(score))
    order = F.md5(F.concat_ws("|", *item, index)) if tie == "hash" else F.col(index)
    ranked = scores.select(*item, *carry, F.struct((-s).alias("s"), order.alias("o"), F.col(index).alias("i")).alias("r"))
    best = ranked.groupBy(*item).agg(F.min("r").alias("b"), *[F.first(c).alias(c) for c in carry], F.count("*").alias("candidates"))
    return best.select(*item, *carry, F.col("b.i").alias("chosen"), (-F.col("b.s")).alias("best_score"), "candidates")


def tie_sizes(scores: DataFrame, item: list[str], score: str = "logprob") -> DataFrame:
    """How many candidates share the best score of each item."""
    s = scores.select(*item, lowest_if_missing(F.col(score)).alias("__s"))
    counts = s.groupBy(*item, "__s").agg(F.count("*").alias("ties"))
    return counts.groupBy(*item).agg(F.max(F.struct("__s", "ties")).alias("b")).select(*item, F.col("b.ties").alias("ties"))


def choose_in_array(scores: Column) -> Column:
    """The 0-based index of the greatest element of an array, the first of equal ones; missing elements rank last."""
    clean = F.transform(scores, lowest_if_missing)
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def counters(items: DataFrame, dimensions: list[str], correct: str = "correct", keys: list[str] = ()) -> DataFrame:
    """total and correct for every value of every dimension by itself, in one pass (grouping sets)."""
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("d")
    return items.select(*keys, parts, F.col(correct).cast("long").alias("c")).groupBy(*keys, "d.dimension", "d.value").agg(F.count("*").alias("total"), F.sum("c").alias("correct"))


def accuracy(counted: DataFrame) -> DataFrame:
    return counted.withColumn("accuracy", 100.0 * ratio(F.col("correct"), F.col("total")))


def macro(counted: DataFrame, by: list[str] = ()) -> DataFrame:
    """The unweighted mean of accuracies."""
    return accuracy(counted).groupBy(*by).agg(F.avg("accuracy").alias("macro"), F.count("*").alias("parts"))


def two_level_macro(counted: DataFrame, prefix: Column) -> DataFrame:
    """The mean of the means within each prefix; prefixes without items don't count."""
    inner = accuracy(counted).groupBy(prefix.alias("split")).agg(F.avg("accuracy").alias("a"))
    return inner.agg(F.avg("a").alias("macro"), F.count("*").alias("splits"))


def best_setting(scored: DataFrame, setting: str, metric: str, by: list[str] = ()) -> DataFrame:
    """The setting with the greatest metric, the smallest of equal ones (the first that a scan in order would keep)."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(setting).alias("s"))).alias("b")
    return scored.groupBy(*by).agg(best).select(*by, F.col("b.s").alias(setting), (-F.col("b.m")).alias(metric))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "seq") -> DataFrame:
    """The ordinal from 0 within `by`; order must be total. Where its first column is a number a group is numbered range by range, so a large one isn't one task's work."""
    first = order[0]
    if isinstance(first, str) and isinstance(rows.schema[first].dataType, NumericType) and all(isinstance(c, str) for c in order):
        return ordinals.numbered(rows, by, order, name)
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def rollup_weighted(leaves: DataFrame, ancestors: DataFrame, metric: str = "accuracy", size: str = "size") -> DataFrame:
    """Weighted and unweighted means of leaves for every group above them; ancestors: (leaf, task_group)."""
    j = leaves.join(ancestors, "leaf")  # the planner broadcasts a side that is small
    return j.groupBy("task_group").agg((F.sum(F.col(metric) * F.col(size)) / F.sum(size)).alias("weighted"), F.avg(metric).alias("unweighted"), F.sum(size).cast("long").alias("size"))
