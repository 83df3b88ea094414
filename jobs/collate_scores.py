"""Collates predictions of many models with gold answers into a leaderboard.

    python -m jobs.collate_scores --predictions TABLE --gold TABLE --out FOLDER --config jobs/collate_scores.json

Predictions say what a model answered to an item; if it answered twice, the later answer counts. Gold says the answer of each item, its task and
its subtask. An answer is right if it equals the gold one without white space at the ends. A subtask's accuracy is over all its gold
items: one that a model left out is wrong. A task's score is the plain mean of its subtasks, a model's average the plain mean of
all tasks, a task without any answer being 0. `coverage` is the share of gold items that were answered, `complete` whether all were.

    OUT/task=<task>/     (model, subtask, total, answered, correct, score, coverage, complete, place)

subtask is null in a task's own row; the partition `average` has the rows over all tasks. A model has rows for the subtasks and tasks of which it answered
something, and its average. Rows without a model say what there is to answer: the gold items of each subtask, task and of all.
place is the model's place by score in the same subtask, task or average, from 1; equal scores share the better place.

The config says how columns are found: SQL expressions for `model`, `item`, `answer` and `order` (a list; later is greater) of predictions, and for
`item`, `answer`, `task` and `subtask` of gold. `tasks` names the tasks to collate, null all of them. With a list only the
partitions of these tasks are replaced (dynamic partition overwrite) and the averages are made anew from all that are there,
so a repeated or partial run gives what a whole one gives.

Rows with a null model, item or task count nowhere; a null answer is wrong; answers to items that gold lacks are not counted. Of gold items that are there twice the one with the smallest task, subtask and answer counts.
Models and tasks are few, predictions and items are many: they meet in one join by item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import checked, command, log
from tallyspark.functions.scalars import strip
from tallyspark.operators import rank, relate

LOG = log("collate_scores")
AVERAGE = "average"
DEFAULTS = {"predictions": ..., "gold": ..., "tasks": None}
OUTPUT = "model string, subtask string, total long, answered long, correct long, score double, coverage double, complete boolean, place int, task string"


def predicted(rows: DataFrame, said: dict) -> DataFrame:
    """(model, item, answer): the last answer of each model to each item."""
    said = checked(said, {"model": ..., "item": ..., "answer": ..., "order": []})
    order = [F.expr(e).alias(f"order_{k}") for k, e in enumerate(said["order"])]
    each = rows.select(F.expr(said["model"]).cast("string").alias("model"), F.expr(said["item"]).cast("string").alias("item"), *order, F.expr(said["answer"]).cast("string").alias("answer"))
    whole = each.filter("model is not null and item is not null")
    return relate.later_wins(whole, ["model", "item"], [c for c in each.columns if c.startswith("order_")]).select("model", "item", "answer")


def golden(rows: DataFrame, said: dict, tasks: list[str] | None) -> DataFrame:
    """(item, task, subtask, answer): one row an item."""
    said = checked(said, {"item": ..., "answer": ..., "task": ..., "subtask": ...})
    each = rows.select(*[F.expr(said[c]).cast("string").alias(c) for c in ("item", "task", "subtask", "answer")]).filter("item is not null and task is not null")
    one = each.groupBy("item").agg(F.min(F.struct("task", "subtask", "answer")).alias("g")).select("item", "g.*")
    return one.filter(F.col("task").isin(tasks)) if tasks is not None else one


def scores(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(task, subtask, model, total, answered, correct, score): subtasks, then tasks with a null subtask; both also without a model."""
    sizes = gold.groupBy("task", F.coalesce("subtask", F.lit("")).alias("subtask")).agg(F.count("*").alias("total"))
    right = F.coalesce(strip(F.col("p.answer")) == strip(F.col("g.answer")), F.lit(False))
    met = predictions.alias("p").join(gold.alias("g"), F.col("p.item") == F.col("g.item"))
    found = met.groupBy("g.task", F.coalesce("g.subtask", F.lit("")).alias("subtask"), "p.model").agg(F.count("*").alias("answered"), F.count_if(right).alias("correct"))
    sub = found.join(sizes, ["task", "subtask"]).withColumn("score", F.col("correct").cast("double") / F.col("total"))
    whole = sizes.groupBy("task").agg(F.sum("total").alias("total"), F.count("*").alias("parts"))
    sums = sub.groupBy("task", "model").agg(F.sum("answered").alias("answered"), F.sum("correct").alias("correct"), F.sum("score").alias("s")).join(whole, "task")
    none = {"model": F.lit(None).cast("string"), "answered": F.lit(0).cast("long"), "correct": F.lit(0).cast("long"), "score": F.lit(None).cast("double")}
    names = ["task", "subtask", "model", "total", "answered", "correct", "score"]
    null = F.lit(None).cast("string")
    tables = [sub, sizes.withColumns(none), sums.withColumns({"subtask": null, "score": F.col("s") / F.col("parts")}), whole.withColumns(none | {"subtask": null})]
    out = tables[0].select(names)
    for table in tables[1:]:
        out = out.unionByName(table.select(names))
    return out


def finished(rows: DataFrame) -> DataFrame:
    """With coverage, complete and place."""
    w = Window.partitionBy("task", "subtask").orderBy(F.desc_nulls_last(F.round("score", 12)))  # a row a model; sums of doubles may differ in their last bits
    share = F.col("answered").cast("double") / F.col("total")
    return rows.withColumns({"coverage": share, "complete": F.col("answered") == F.col("total"), "place": F.when(F.col("model").isNotNull(), F.rank().over(w))})


def averages(tasks: DataFrame) -> DataFrame:
    """The rows over all tasks, of their own rows: a task that a model lacks counts as 0."""
    there = tasks.filter("model is null").agg(F.count("*").alias("n"), F.sum("total").alias("total")).first()  # two numbers
    null = F.lit(None).cast("string")
    every = {"task": F.lit(AVERAGE), "subtask": null, "total": F.lit(there["total"]).cast("long")}
    sums = tasks.groupBy("model").agg(F.sum("answered").alias("answered"), F.sum("correct").alias("correct"), F.sum("score").alias("score"))
    sums = sums.withColumn("score", F.when(F.col("model").isNotNull(), F.col("score") / F.lit(there["n"])))
    return finished(sums.withColumns(every))


def written(rows: DataFrame, out: str, whole: bool) -> None:
    names = [f.split()[0] for f in OUTPUT.split(", ")]
    writer = rows.select(*names).repartition("task").write.mode("overwrite").partitionBy("task")
    writer.option("partitionOverwriteMode", "static" if whole else "dynamic").parquet(out)


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(out)


def run(spark: SparkSession, predictions: str, gold: str, out: str, given: dict) -> dict:
    """Writes the scores of the config's tasks and the averages over all tasks; returns what it read and wrote."""
    settings, out = checked(given, DEFAULTS), out.rstrip("/")
    tasks = settings["tasks"]
    if tasks is not None and AVERAGE in tasks:
        raise ValueError(f"{AVERAGE} is no task")
    tables = {path: spark.read.parquet(path) for path in (predictions, gold)}
    read = {path: table.count() for path, table in tables.items()}  # Parquet's footers know
    for path, n in read.items():
        LOG.info("read %d rows of %s", n, path)
    answers = golden(tables[gold], settings["gold"], tasks)
    said = predicted(tables[predictions], settings["predictions"])
    written(finished(scores(said, answers)), out, tasks is None)
    there = output(spark, out).filter((F.col("task") != AVERAGE) & F.col("subtask").isNull())
    average = averages(there)
    kept = spark.createDataFrame(average.collect(), average.schema)  # a row a model; the table it was read from is about to change
    written(kept, out, False)
    sizes = {r["task"]: r["n"] for r in output(spark, out).groupBy("task").agg(F.count("*").alias("n")).collect()}  # a row a task
    for name, n in sorted(sizes.items(), key=str):
        LOG.info("%s/task=%s has %d rows", out, name, n)
    return {"tasks": sorted(str(t) for t in sizes if t != AVERAGE), "rows": sum(sizes.values()), "predictions": read[predictions], "gold": read[gold]}


if __name__ == "__main__":
    command("collate_scores", "A leaderboard from predictions and gold answers.", {"predictions": "a Parquet table of answers", "gold": "a Parquet table of right answers", "out": "the output folder"}, run)
