"""Joins and set operations of the evaluation pipeline, as equi-joins on materialised keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordinals
from .rank import numbered


def positional(left: DataFrame, right: DataFrame, by: list[str], left_order: list, right_order: list) -> DataFrame:
    """Rows with the same ordinal within `by`; the longer side loses its tail. Ordinals need a group together (a subtask); the join is by group and ordinal, so it is even."""
    a, b = numbered(left, by, left_order), numbered(right, by, right_order)
    return a.join(b, [*by, "seq"])


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list) -> DataFrame:
    """Each left row with the first row of its key on the right; left rows without one go."""
    w = Window.partitionBy(*on).orderBy(*order)
    return left.join(right.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), on)


def missing(expected: DataFrame, found: DataFrame, on: list[str], scope: list[str] | None = None) -> DataFrame:
    """Expected rows that weren't found; scope: only where something of the same scope was found."""
    within = expected.join(found.select(*scope).distinct(), scope, "left_semi") if scope else expected
    return within.join(found, on, "left_anti")


def size_check(rows: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """found and expected counts, and whether they agree; expected: (by, expected)."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("found"))
    both = expected.join(counts, by, "full_outer")
    return both.select(*by, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("found", F.lit(0)).cast("long").alias("found")).withColumn("complete", F.col("found") == F.col("expected"))


def later_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; order must be total. An aggregation with map-side combine, so a key with very many rows doesn't gather them."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def priority_union(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All rows of `first`, and those of `second` whose key it lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def or_zero(expected: DataFrame, found: DataFrame, on: list[str], value: str) -> DataFrame:
    return expected.join(found, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def leaderboard(found: DataFrame, model: str, task: str, value: str, tasks: list[str] | None = None) -> DataFrame:
    """(model, macro, present, place): the plain mean over all tasks, a task that a model lacks being 0; equal means share the better place.

    tasks: those that count, all that are found if none are given. One aggregation: only a model's sum and the number of tasks are needed."""
    rows = found.groupBy(model, task).agg(F.max(value).alias("__v")).filter(F.col(task).isNotNull())
    if tasks is not None:
        rows = rows.join(F.broadcast(found.sparkSession.createDataFrame([(t,) for t in sorted(set(tasks))], f"`{task}` string")), task, "left_semi")
    n = F.lit(len(set(tasks)) if tasks is not None else rows.select(task).distinct().count())  # one number
    sums = rows.groupBy(model).agg(F.sum(F.coalesce("__v", F.lit(0.0))).alias("s"), F.count("__v").alias("present"))
    out = sums.select(model, (F.col("s") / n).alias("macro"), "present")
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc(F.round("macro", 12)))))  # a row a model


def sampled_exactly(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows by the order of a hash: the same ones whatever the partitioning."""
    return rows.withColumn("__h", F.md5(key.cast("string"))).orderBy("__h").limit(n).drop("__h")


def split_by_hash(rows: DataFrame, key: Column, by: list[str], valid: float = 0.2) -> DataFrame:
    """split = valid for the ceil(valid n) first rows of each group by hash, else train. Groups are ranked range by range of the hash, so a large one is many tasks' work."""
    h = F.md5(key.cast("string"))
    marked = rows.withColumns({"__head": F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), "__md5": h, "__key": key})
    ranked = ordinals.numbered(marked, by, ["__head", "__md5", "__key"], "__r")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n")).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.ceil(F.col("__n") * F.lit(valid)).alias("__most"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return ranked.join(sizes, on).select(*rows.columns, F.when(F.col("__r") < F.col("__most"), F.lit("valid")).otherwise(F.lit("train")).alias("split"))


def first_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The few-shot sampler: the first n rows of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def trials(human: DataFrame, model: DataFrame, options: list[str], by: list[str] = (), trial: str = "trial") -> DataFrame:
    """(by, trial, human, model): the options' numbers of trials that both sides have, missing ones as 0.

    by: keys of the human side, such as an age bin, each of which meets all trials of the model."""
    numbers = lambda: F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in options])
    return human.select(*by, trial, numbers().alias("human")).join(model.select(trial, numbers().alias("model")), trial).select(*by, trial, "human", "model")


def in_order(rows: DataFrame, column: str, names: list[str], out: str = "place") -> DataFrame:
    """The place of a value in a fixed order, such as that of models in a table; others come last, by name."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return rows.withColumn(out, F.when(at > 0, at - 1).otherwise(F.lit(len(names))).cast("int"))


#: What names of models say about the languages they were trained on, and the order of the combinations in tables.
ENGLISH_MARK = "strict"
LANGUAGES = {"eng": r"en_|^en", "nld": "nld", "zho": "zho"}
ALONE = r"lm-(nld|zho)"
COMBINATIONS = ["eng", "nld", "zho", "eng+nld", "eng+zho", "nld+zho", "eng+nld+zho"]


def training_languages(model: Column) -> Column:
    """The languages that a model's name tells, in the order of `LANGUAGES`: a mark for English alone, one language behind a family's name, or parts of the name."""
    name = F.lower(model)
    alone = F.regexp_extract(name, ALONE, 1)
    parts = F.filter(F.array(*[F.when(name.rlike(p), F.lit(code)) for code, p in LANGUAGES.items()]), lambda x: x.isNotNull())
    found = F.when(name.contains(ENGLISH_MARK), F.array(F.lit("eng"))).when(alone != "", F.array(alone)).otherwise(parts)
    return F.coalesce(found, F.array().cast("array<string>"))


def by_languages(rows: DataFrame, model: str) -> DataFrame:
    """With `languages` and `place`, the place of their combination in tables; other combinations, and names that tell none, come last."""
    return in_order(rows.withColumn("languages", training_languages(F.col(model))).withColumn("__c", F.array_join("languages", "+")), "__c", COMBINATIONS).drop("__c")


def paired(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Two lists of one group side by side, as far as the shorter goes (words and their contexts, rows and their images)."""
    one = F.lit(0).alias("__g")
    return positional(left.select("*", one), right.select("*", one), ["__g"], left_order, right_order).drop("__g")


def split_exactly(rows: DataFrame, key: list[str], valid: float = 0.2) -> DataFrame:
    """split = valid for exactly ceil(valid n) rows, the first by hash of the key, else train: only rows whose hash has the boundary's first bits are sorted."""
    h = F.md5(F.concat_ws("|", *key))
    head = F.conv(F.substring(h, 1, 4), 16, 10).cast("int")
    marked = rows.withColumns({"__h": h, "__b": head})
    counts = sorted((r["__b"], r["n"]) for r in marked.groupBy("__b").agg(F.count("*").alias("n")).collect())  # 65536 numbers at most
    left, edge = math.ceil(valid * sum(n for _, n in counts)), -1
    for b, n in counts:
        edge = b
        if n >= left:
            break
        left -= n
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key))
    at_edge = marked.filter(F.col("__b") == edge).withColumn("split", F.when(rank <= left, F.lit("valid")).otherwise(F.lit("train")))
    rest = marked.filter(F.col("__b") != edge).withColumn("split", F.when(F.col("__b") < edge, F.lit("valid")).otherwise(F.lit("train")))
    return rest.unionByName(at_edge).drop("__h", "__b")
