"""Ordinals and running totals inside groups of any size.

A group that is one window is one task's work. Here each group is cut into ranges of the order's first column, at quantiles of all rows
that one pass finds: a range is summed on its own, and what the ranges before it hold is added. Cuts are values, not places, so a row's
range is the same in every run of a plan, and a lost task repeats it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a total is made of rows, and of two totals.
HOW = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def cuts(rows: DataFrame, first: str, parts: int) -> list[float]:
    found = rows.agg(F.percentile_approx(F.col(first).cast("double"), [k / parts for k in range(1, parts)], 10 * parts).alias("c")).first()["c"] or []
    return sorted({c for c in found if c is not None and not math.isnan(c)})


def range_of(value: Column, found: list[float]) -> Column:
    """How many of the cuts lie below a value; null for null. A sum of comparisons, which is compiled: a function of an array would run term by term for each row."""
    below = [(F.lit(c) < value.cast("double")).cast("int") for c in found]
    while len(below) > 1:
        below = [a + b for a, b in zip(below[::2], below[1::2])] + below[len(below) // 2 * 2 :]
    return below[0] if below else F.when(value.isNotNull(), 0)


def running(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """`rows` with each total {name: (column, "sum" or "bit_xor")} over the rows of its group up to it, itself included.

    order: total within a group, nulls first; its first column is a number where parts > 1. With parts = 1 a group is one window: for groups that are known to be small.
    By default there are as many ranges as the session shuffles to, 64 at most: several groups share the tasks. `rows` is read three times, for cuts, totals and sums: store
    what is dear to make."""
    if parts is None:
        parts = min(64, max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if parts <= 1:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({name: HOW[how][0](column).over(w) for name, (column, how) in totals.items()})
    found = cuts(rows, order[0], parts)
    ranged = rows.withColumn("__range", F.coalesce(range_of(F.col(order[0]), found), F.lit(-1)))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows a group
    sums = ranged.groupBy(*by, "__range").agg(*[HOW[how][0](column).alias(f"__t_{name}") for name, (column, how) in totals.items()])
    sums = sums.select(*by, "__range", *[F.coalesce(HOW[how][0](f"__t_{name}").over(earlier), F.lit(0)).alias(f"__b_{name}") for name, (_, how) in totals.items()])
    out = ranged.withColumns({name: HOW[how][0](column).over(within) for name, (column, how) in totals.items()})
    keys = [*by, "__range"]
    out = out.alias("l").join(sums.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return out.select(*[F.col(f"l.{c}") for c in rows.columns], *[HOW[how][1](F.col(f"l.{name}"), F.col(f"r.__b_{name}")).alias(name) for name, (_, how) in totals.items()])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "seq", parts: int | None = None) -> DataFrame:
    """The ordinal from 0 within `by`; order must be total, its first column a number."""
    out = running(rows.withColumn("__one", F.lit(1).cast("long")), by, order, {"__end": ("__one", "sum")}, parts)
    return out.withColumn(name, F.col("__end") - 1).drop("__one", "__end")


def with_next(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, str], parts: int | None = None) -> DataFrame:
    """`rows`, without the last one of each group, with columns {new: old} of the row that follows in order; order as in `numbered`."""
    here = numbered(rows, by, order, "__seq", parts)
    after = here.select(*[F.col(c).alias(f"__n_{c}") for c in by], (F.col("__seq") - 1).alias("__before"), *[F.col(old).alias(new) for new, old in columns.items()])
    on = F.col("__seq") == F.col("__before")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    return here.join(after, on).select(*rows.columns, *columns)
