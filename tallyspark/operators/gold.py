"""Predictions against gold: positional joins with the gold text, subtask accuracies, macro averages.

Predictions are (uid, seq, pred), gold rows carry an order of their own; both sides get materialised ordinals, so the
join is an equi-join on (uid, seq) and the longer side loses its tail. Texts are equal if they are after stripping white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip
from .rank import accuracy, counters, macro, numbered



def gold_text(task: str) -> Column:
    """The right answer of a row of this task, as a prediction would give it."""
    made = {
        "minimal_pairs": lambda: F.col("sentence_good"),
        "world_knowledge": lambda: F.col("Target1"),
        "entity_tracking": lambda: F.get(F.col("options"), F.lit(0)),
        "concept_pairs": lambda: F.concat_ws(" ", "prefix_acceptable", "property_phrase"),
        "classification": lambda: F.col("label").cast("string"),
    }
    if task not in made:
        raise NotImplementedError(f"no gold text for {task!r}; there are {sorted(made)}")
    return made[task]()


def subtask_of_file(stem: Column) -> Column:
    """The subtask that a concept file holds: its stem's end, with the names that predictions use."""
    rest = F.regexp_replace(F.regexp_replace(stem, "^[a-z]+_", ""), "-", "_")
    return F.when(rest.isin("base", "wugs", "wugs_dist_before"), rest).otherwise(F.lit("wugs_dist_in_between"))


def judged(predictions: DataFrame, gold: DataFrame, order: list, text: Column, uid: Column | str = "uid") -> DataFrame:
    """(uid, seq, pred, gold, correct) of every prediction that has a gold row at its place; predictions: (uid, seq, pred).

    Both sides are numbered, which reads them three times each: store what is dear to make, above all what was numbered before (functions.folders.stored)."""
    name = F.col(uid) if isinstance(uid, str) else uid
    answers = numbered(gold.select(name.alias("uid"), *order, text.alias("gold")), ["uid"], order).select("uid", "seq", "gold")
    mine = numbered(predictions.select("uid", F.col("seq").alias("__order"), "pred"), ["uid"], ["__order"]).drop("__order")
    return mine.join(answers, ["uid", "seq"]).withColumn("correct", F.coalesce(strip(F.col("pred")) == strip(F.col("gold")), F.lit(False)).cast("int"))


def operations_uid(stem: Column, operations: Column) -> Column:
    """The subtask of a run of rows with the same number of operations, in which places start again."""
    return F.concat_ws("_", stem, operations, F.lit("ops"))


def scored(judgements: DataFrame) -> DataFrame:
    """(uid, total, correct, accuracy) of the subtasks."""
    return accuracy(counters(judgements, ["uid"])).select(F.col("value").alias("uid"), "total", "correct", "accuracy")


def score(judgements: DataFrame) -> DataFrame:
    """(macro, parts): the plain mean over subtasks."""
    return macro(counters(judgements, ["uid"]))


def fast_curve(judgements: DataFrame, revisions: DataFrame) -> DataFrame:
    """(revision, ord, scores): a map from subtask to fraction for each revision, in the order of the axis (revision, ord); null where a revision lacks results."""
    each = judgements.groupBy("revision", "uid").agg(F.avg(F.col("correct").cast("double")).alias("s"))
    maps = each.groupBy("revision").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("uid", "s")))).alias("scores"))
    return revisions.join(maps, "revision", "left").select("revision", "ord", "scores").orderBy("ord")


def named(predictions: DataFrame, items: DataFrame, order: list, whole: bool = False) -> DataFrame:
    """(uid, id, pred) of chosen candidates: the id is the subtask with the ordinal, the text the candidate's sentence (whole) or its completion."""
    places = numbered(items.select("uid", *order, "candidates"), ["uid"], order)
    chosen = places.join(predictions.select("uid", "seq", "chosen"), ["uid", "seq"])
    text = F.get(F.col("candidates"), F.col("chosen").cast("int"))["sentence" if whole else "completion"]
    return chosen.select("uid", F.concat_ws("_", "uid", "seq").alias("id"), text.alias("pred"))
