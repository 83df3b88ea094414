"""Reports: pivots with the best marked, trees read from indents, parsers of text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivoted(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row for each `row`, one column for each of the given `columns` (known, so no pass to find them); with the mean of what is there."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.first(value))
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns), F.lit(0.0))
    there = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
    return wide.withColumn("average", F.when(there > 0, total / there))


def best_marked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """is_best: the greatest value of its group, all of equal ones; nulls never are."""
    top = rows.groupBy(*by).agg(F.max(value).alias("__best"))
    return rows.join(top, by).withColumn("is_best", F.coalesce(F.col(value) == F.col("__best"), F.lit(False))).drop("__best")


def cell(value: Column, best: Column, digits: int = 2) -> Column:
    text = F.format_string(f"%.{digits}f", value)
    return F.when(value.isNull(), F.lit("-")).when(best, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def markdown(wide: DataFrame, names: list[str]) -> DataFrame:
    """The lines of a markdown table, header first; a report is small by contract."""
    spark = wide.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "n long, value string")
    body = wide.withColumn("n", (F.row_number().over(Window.orderBy(names[0])) + 1).cast("long")).select("n", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in names]), F.lit(" |")).alias("value"))
    return head.union(body)


def alias_tree(rows: DataFrame, doc: list[str], order: str, alias: str, value: str) -> DataFrame:
    """depth (leading blanks) and the depth-0 task that each row belongs to, in the order of the document."""
    depth = (F.char_length(alias) - F.char_length(F.ltrim(F.col(alias)))).cast("long")
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_depth = rows.withColumn("depth", depth).withColumn("name", F.trim(F.col(alias)))
    return with_depth.withColumn("task", F.last(F.when(F.col("depth") == 0, F.col("name")), ignorenulls=True).over(w)).select(*doc, order, "depth", "name", "task", value)


def average_score(text: Column) -> Column:
    """The number in the line after the first line that begins with ### AVERAGE; null if it is none."""
    return F.regexp_extract(text, r"(?m)^\s*### AVERAGE[^\n]*\n\s*([^\n]*)", 1).try_cast("double")


def key_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, number) of `key: number` lines; other lines give nothing."""
    parts = F.split(F.col(line), ":", 2)
    return lines.filter(F.col(line).contains(":")).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).try_cast("double").alias("number"))


def score_report(accuracies: DataFrame, temperature: float) -> DataFrame:
    """The lines of a text report of (dimension, value, accuracy): a section for each dimension, then the average of the means."""
    w = Window.partitionBy("dimension").orderBy("value")
    lines = accuracies.withColumn("n", F.row_number().over(w)).select(F.concat_ws("\t", "dimension", F.lpad(F.col("n").cast("string"), 9, "0")).alias("k"), F.concat_ws("", F.when(F.col("n") == 1, F.concat(F.lit("### "), F.upper("dimension"), F.lit(" ACCURACY\n"))), "value", F.lit(": "), F.format_string("%.2f", "accuracy")).alias("value"))
    spark = accuracies.sparkSession
    head = spark.range(1).select(F.lit("").alias("k"), F.lit(f"TEMPERATURE: {temperature:.2f}").alias("value"))
    tail = accuracies.agg(F.avg("accuracy").alias("a")).select(F.lit("￿").alias("k"), F.concat(F.lit("### AVERAGE ACCURACY\n"), F.format_string("%.2f", "a")).alias("value"))
    return head.union(lines).union(tail).orderBy("k").select("value")


def best_across(wide: DataFrame, columns: list[str]) -> DataFrame:
    """`best`: the columns that hold the greatest value of their row, all of equal ones; `average`: the mean of the cells as they are shown, with two digits."""
    names = [F.col(f"`{c}`") for c in columns]
    top = F.array_max(F.array(*names))
    best = F.filter(F.array(*[F.when(x == top, F.lit(c)) for c, x in zip(columns, names)]), lambda c: c.isNotNull())
    shown = F.filter(F.array(*[F.when(x.isNotNull(), F.format_string("%.2f", x.cast("double")).cast("double")) for x in names]), lambda x: x.isNotNull())
    mean = F.when(F.size(shown) > 0, F.aggregate(shown, F.lit(0.0), lambda a, x: a + x) / F.size(shown))
    return wide.withColumns({"best": best, "average": mean})


def subtask_means(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The mean over subtasks that have a value, and how many have one."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("subtasks"))


def subtasks(tree: DataFrame, value: str = "acc") -> DataFrame:
    """The rows of an alias tree right below a task that have a value."""
    return tree.filter((F.col("depth") == 1) & F.col(value).isNotNull())


def percentages(found: DataFrame) -> DataFrame:
    """key: value numbers as percentages."""
    return found.withColumn("number", F.col("number") * 100)
