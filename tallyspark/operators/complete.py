"""Completeness of collected results: expected files, sizes, steps and shapes; what fails becomes null, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that every checkpoint has to have surprisals for (a fixed value), by default.
AGE_ROWS = 8005


def expected_paths(spark: SparkSession, root: str, revisions: list[str], parts: list[str], file: str = "predictions.json") -> DataFrame:
    """(revision, part, path) of every file that a complete run has."""
    rows = [(r, p, f"{root}/{r}/{p}/{file}" if file else f"{root}/{r}/{p}") for r in revisions for p in parts]
    return spark.createDataFrame(rows, "revision string, part string, path string")


def listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path) of the files below a folder, without the scheme; nothing is read of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def missing_paths(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select("path").distinct(), "path", "left_anti")


def valid_revisions(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(revision, files, missing, valid)."""
    there = found.select("path").distinct().withColumn("there", F.lit(1))
    return expected.join(there, "path", "left").groupBy("revision").agg(F.count("*").alias("files"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("missing")).withColumn("valid", F.col("missing") == 0)


def step_check(rows: DataFrame, steps: DataFrame, size: int = AGE_ROWS, step: str = "step") -> DataFrame:
    """(step, expected, found, complete) of each expected step, and of steps that nobody expected with expected 0."""
    counts = rows.groupBy(step).agg(F.count("*").alias("found"))
    wanted = steps.select(step).distinct().withColumn("expected", F.lit(size).cast("long"))
    both = wanted.join(counts, step, "full_outer").select(step, F.coalesce("expected", F.lit(0).cast("long")).alias("expected"), F.coalesce("found", F.lit(0).cast("long")).alias("found"))
    return both.withColumn("complete", F.col("expected") == F.col("found"))


def all_complete(check: DataFrame) -> DataFrame:
    """One row: whether every row of a check is complete; without rows it is not."""
    return check.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("complete"))


def shape_check(cells: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """(by, rows, columns, complete): the shape of matrices given as (i, j, value), against expected (by, rows, columns); a missing value is no number."""
    shape = cells.groupBy(by).agg((F.max("i") + 1).alias("found_rows"), (F.max("j") + 1).alias("found_columns"), F.count("value").alias("numbers"), F.count("*").alias("cells"))
    both = expected.join(shape, by, "left")
    good = (F.col("rows") == F.col("found_rows")) & (F.col("columns") == F.col("found_columns")) & (F.col("cells") == F.col("rows") * F.col("columns")) & (F.col("numbers") == F.col("cells"))
    return both.select(by, F.coalesce("found_rows", F.lit(0).cast("long")).cast("long").alias("rows"), F.coalesce("found_columns", F.lit(0).cast("long")).cast("long").alias("columns"), F.coalesce(good, F.lit(False)).alias("complete"))


def parsed_or_null(value: Column, schema: str) -> Column:
    """A JSON document, or null where the text is none or a field has another type than the schema's."""
    whole = F.from_json(value, f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    return F.when(whole["__broken"].isNull(), whole.dropFields("__broken"))


def document_or_null(spark: SparkSession, path: str, schema: str, good=None) -> DataFrame:
    """(path, document): the parsed JSON document of a file, null where the file is missing, isn't JSON, or the check (a condition on `document`) fails."""
    asked = spark.createDataFrame([(path,)], "path string")
    folder, _, name = path.rpartition("/")
    try:
        files = spark.read.option("pathGlobFilter", name).text(folder or ".", wholetext=True).select(F.lit(path).alias("path"), parsed_or_null(F.col("value"), schema).alias("document"))
    except Exception as e:  # a missing folder is a missing file; anything else is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return asked.withColumn("document", F.from_json(F.lit(None).cast("string"), schema))
    out = asked.join(files, "path", "left")
    kept: Column = F.col("document")
    return out.withColumn("document", F.when(good(kept), kept) if good is not None else kept)


def available(candidates: DataFrame, catalogue: DataFrame, on: list[str]) -> DataFrame:
    """The candidate tasks for which a config is there."""
    return candidates.join(catalogue.select(*on).distinct(), on, "left_semi")
