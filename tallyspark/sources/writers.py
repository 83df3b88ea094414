"""Sinks: prediction documents (lines that together are one JSON document), submissions, reports, splits and score tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank


PLACE = ["part", "uid", "kind", "seq"]  # of a line in its document


def _quoted(c: str):
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def _line(spark: SparkSession, part: int, kind: int, value: str) -> DataFrame:
    """A line before (kind < 0) or behind the others of its part."""
    return spark.range(1).select(F.lit(part).alias("part"), F.lit(None).cast("string").alias("uid") if kind < 0 else F.lit("\U0010ffff").alias("uid"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(value).alias("value"))


def _uid_lines(predictions: DataFrame, part: int) -> DataFrame:
    """(part, uid, kind, seq, value): for each subtask a line that opens it, one for each prediction, and one that closes it."""
    rows = predictions.filter("uid is not null")
    uids = rows.select("uid").distinct()
    first = F.broadcast(uids.agg(F.min("uid").alias("__first")))  # one row
    comma = lambda later: F.when(later, F.lit(",")).otherwise(F.lit(""))
    begin = uids.join(first, F.lit(True)).select("uid", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.concat(comma(F.col("uid") > F.col("__first")), _quoted("uid"), F.lit(':{"predictions":[')).alias("value"))
    each = F.to_json(F.struct(F.concat_ws("_", "uid", "seq").alias("id"), F.col("pred")))
    numbered = rank.numbered(rows.select("uid", "seq", each.alias("value")), ["uid"], ["seq", "value"], "__n")
    middle = numbered.select("uid", F.lit(1).alias("kind"), F.col("__n").alias("seq"), F.concat(comma(F.col("__n") > 0), "value").alias("value"))
    end = uids.select("uid", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit("]}").alias("value"))
    return begin.union(middle).union(end).select(F.lit(part).alias("part"), "uid", "kind", "seq", "value")


def prediction_document(predictions: DataFrame) -> DataFrame:
    """The lines of one JSON document: {uid: {predictions: [{id, pred}]}} in the order of seq.

    A line holds one prediction, so a document may have any size: lines are sorted range by range and written one after the other (write_text); nothing
    gathers them. Rows without a subtask are left out."""
    spark = predictions.sparkSession
    whole = _line(spark, 0, -1, "{").union(_uid_lines(predictions, 0)).union(_line(spark, 0, 3, "}"))
    return whole.orderBy(*PLACE).select("value")


def submission(scores: DataFrame) -> DataFrame:
    """{task: {subtask: score}} of (task, subtask, score)."""
    inner = scores.groupBy("task").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("subtask").alias("key"), F.col("score").alias("value")))))).alias("m"))
    name = F.regexp_extract(F.to_json(F.struct(F.col("task").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return inner.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(":"), F.col("m")))), ","), F.lit("}")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """One file of lines in their order. One task writes them, as they come from the sorted ranges; it holds none of them."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in a folder for each value of `by`, such as split or domain."""
    rows.write.mode("overwrite").partitionBy(*by).json(path)


def write_scores(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_revision(rows: DataFrame, path: str, revision: Column) -> None:
    """Interim results, a folder for each revision; what is there is replaced, so a repeated run counts once."""
    rows.withColumn("revision", revision).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision").parquet(path)


def collated(parts: dict[str, DataFrame], fast: DataFrame | None = None) -> DataFrame:
    """The lines of one JSON document: {task: {uid: {predictions: [...]}}} of (uid, seq, pred) by task, null for a task whose predictions are None;
    fast: (ord, scores) adds fast_eval_results, the maps of scores in the order of the axis."""
    spark = next(x for x in [*parts.values(), fast] if x is not None).sparkSession
    lines = [_line(spark, -1, -1, "{"), _line(spark, len(parts) + 1, 3, "}")]
    for k, (task, predictions) in enumerate(sorted(parts.items())):
        name = ("," if k else "") + json.dumps(task) + ":"
        if predictions is None:
            lines.append(_line(spark, k, -1, name + "null"))
        else:
            lines += [_line(spark, k, -1, name + "{"), _uid_lines(predictions, k), _line(spark, k, 3, "}")]
    if fast is not None:
        part, first = len(parts), F.broadcast(fast.agg(F.min("ord").alias("__first")))  # one row
        each = F.concat(F.when(F.col("ord") > F.col("__first"), F.lit(",")).otherwise(F.lit("")), F.coalesce(F.to_json("scores"), F.lit("null")))
        maps = fast.join(first, F.lit(True)).select(F.lit(part).alias("part"), F.lit("").alias("uid"), F.lit(1).alias("kind"), F.col("ord").cast("long").alias("seq"), each.alias("value"))
        lines += [_line(spark, part, -1, ("," if parts else "") + '"fast_eval_results":['), maps, _line(spark, part, 3, "]")]
    whole = lines[0]
    for x in lines[1:]:
        whole = whole.union(x)
    return whole.orderBy(*PLACE).select("value")


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A small text file of lines made on the driver, such as a report or a results file."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
