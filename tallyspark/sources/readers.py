"""Sources: task files, predictions, reports and result documents, each with an explicit schema.

A line's place in its file is data (it is the join key of predictions), so ordered readers keep it as `line_no`.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite

SCHEMAS = {
    "minimal_pairs": "sentence_good string, sentence_bad string, field string, UID string, linguistics_term string",
    "world_knowledge": "Domain string, Context1 string, Context2 string, Target1 string, Target2 string, ContextType string, ContextDiff string, TargetDiff string",
    "entity_tracking": "input_prefix string, options array<string>, numops int",
    "concept_pairs": "prefix_acceptable string, prefix_unacceptable string, property_phrase string",
    "distractors": "question string, target_ans string, distractors array<string>, idx_in_hf_dataset long",
    "captions": "caption_0 string, caption_1 string, collapsed_tag string, tag string, secondary_tag string, image_idx long, image_key string",
}
PREDICTIONS = "map<string, struct<predictions: array<struct<id: string, pred: string>>>>"
SURPRISAL = "struct<metadata: struct<model_name: string, use_bos_only: boolean, total_steps: int, completed_steps: int>, results: array<struct<step: string, word_count: long, target_word: string, context_id: int, context: string, surprisal: double>>>"
FINETUNE = "epoch double, eval_accuracy double, eval_loss double, eval_runtime double, eval_samples long, eval_samples_per_second double, eval_steps_per_second double, total_flos double, train_loss double, train_runtime double, train_samples long, train_samples_per_second double, train_steps_per_second double"


def _stem():
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def jsonl(spark: SparkSession, path: str, task: str | None = None, schema: str | None = None) -> DataFrame:
    """All *.jsonl below a folder, with the stem of the file; other files are passed over."""
    rows = spark.read.schema(schema or SCHEMAS[task]).option("pathGlobFilter", "*.jsonl").json(path)
    return rows.select("*", _stem().alias("stem"))


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, stem, line_no, line) of all lines of the files of a folder, line_no from 0 in each file.

    A file is read in splits, as any text is. One pass counts the lines of each split; what the splits before it in its file hold, and a
    line's place within its own, give its number. Splits are as many as the readers make; no file has to fit a task, and no line is sorted."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__split"), _stem().alias("stem"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    # a split's lines follow one another in a task, so their ids do; both passes plan the same splits of the same files
    counts = lines.groupBy("path", "__split").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("__split")) - F.col("n")  # a row a split
    starts = counts.select("path", "__split", (before - F.col("__first")).alias("__shift"))
    return lines.join(starts, ["path", "__split"]).select("path", "stem", (F.col("__id") + F.col("__shift")).alias("line_no"), "line")


def jsonl_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines with the stem of the file and line_no, from 0 in each file."""
    return numbered_lines(spark, path).select("stem", "line_no", F.from_json("line", schema).alias("r")).select("stem", "line_no", "r.*")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(uid, seq, id, pred) of {uid: {predictions: [{id, pred}]}}; the order of each list is kept as seq."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", PREDICTIONS).alias("m"))
    uids = doc.select(F.explode("m").alias("uid", "p"))
    return uids.select("uid", F.posexplode("p.predictions").alias("seq", "r")).select("uid", F.col("seq").cast("long").alias("seq"), "r.id", "r.pred")


def reading(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The reading table: item is a string and never null; measures are doubles, NaN is null."""
    text = {"item", "word", "prev_item", "prev_word"}
    schema = ", ".join(f"`{c}` {'string' if c in text else 'double'}" for c in columns)
    rows = spark.read.schema(schema).option("header", True).csv(path).fillna({"item": "None"})
    return rows.select(*[c if c in text else finite(F.col(c)).alias(c) for c in columns])


def norms(spark: SparkSession, path: str, months: range = range(16, 31)) -> DataFrame:
    """(word, month, prop) from one column a month; months that the file lacks are passed over."""
    wide = spark.read.option("header", True).csv(path)
    there = [str(m) for m in months if str(m) in wide.columns]
    long = wide.unpivot(["word"], [F.col(f"`{c}`") for c in there], "month", "prop")
    return long.select("word", F.col("month").cast("int").alias("month"), finite(F.col("prop").try_cast("double")).alias("prop"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(images, texts): the numbered image and text columns as arrays."""
    wide = spark.read.option("header", True).csv(path)
    number = lambda c: int("".join(x for x in c if x.isdigit()) or 0)
    pick = lambda kind: sorted((c for c in wide.columns if c.startswith(kind) and c[len(kind) :].isdigit()), key=number)
    return wide.select(F.array(*pick("image")).alias("images"), F.array(*pick("text")).alias("texts"))


def surprisals(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", SURPRISAL).alias("d"))
    rows = doc.select(F.col("d.metadata.model_name").alias("model"), F.explode("d.results").alias("r")).select("model", "r.*")
    return rows.withColumn("surprisal", finite(F.col("surprisal")))


def word_contexts(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(word, context_id, context) of {word: [{context}]}; words of one letter or with too few contexts go."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<struct<context: string>>>")).alias("word", "c"))
    kept = doc.filter((F.char_length("word") > 1) & (F.size("c") >= least))
    return kept.select("word", F.posexplode("c.context").alias("context_id", "context"))


def target_words(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path).select("word")
    raise ValueError(f"{path}: target words come as .txt or .csv")


def tab_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(seq, prediction) of a tab-separated file with a header; blank lines are passed over, a missing second column is empty."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.split("value", r"\r?\n").alias("l"))
    lines = lines.select(F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: F.trim(x) != "").alias("l"))
    at = lines.select(F.posexplode("l").alias("seq", "line"))
    return at.select(F.col("seq").cast("long").alias("seq"), F.coalesce(F.get(F.split("line", "\t", 2), F.lit(1)), F.lit("")).alias("prediction"))


def finetune_results(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of <model>/<language>/<task>/all_results.json with the keys of the path."""
    rows = spark.read.schema(FINETUNE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "all_results.json").json(path)
    part = lambda k: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -k)
    return rows.select(part(4).alias("model"), part(3).alias("language"), part(2).alias("task"), "*")


def harness_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, name, alias, acc) of {"results": {name: {"alias", "acc,none"}}} in the order of each document, which tells the tree."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*results*.json").text(path, wholetext=True)
    doc = whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), F.from_json(F.get_json_object("value", "$.results"), "map<string, struct<alias: string, `acc,none`: double>>").alias("m"))
    keys = F.json_object_keys(F.get_json_object("text", "$.results"))
    at = doc.select("file", "m", F.posexplode(keys).alias("pos", "name"))
    return at.select("file", F.col("pos").cast("long").alias("pos"), "name", F.col("m")[F.col("name")]["alias"].alias("alias"), F.col("m")[F.col("name")]["acc,none"].alias("acc"))


def text_reports(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, value) of .npy files of two dimensions; numpy decodes each file in the task that reads it."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                m = m.reshape(m.shape[0], -1)
                i, j = np.indices(m.shape)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m.size), pa.array(i.ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(m.ravel().astype(np.float64))], ["file", "i", "j", "value"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(run, "file string, i long, j long, value double")


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
