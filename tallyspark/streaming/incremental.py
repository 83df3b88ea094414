"""Incremental counters: predictions arrive as files, accuracies stay up to date.

The state is (total, correct) for each key; sums merge in any order, so no watermark is needed. Every micro-batch
writes its own counters under its number; a batch that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a Parquet table as a stream of its columns; the table is a folder to which files are added, or a single file.

    A stream takes a single file by a pattern only, so the last character of its path is made one."""
    rows = spark.read.parquet(path)
    first = rows.select("_metadata.file_name").first()
    name = path.rstrip("/").rsplit("/", 1)[-1]
    place = f"{path.rstrip('/')[:-1]}[{name[-1]}]" if first is not None and first[0] == name else path
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(place)


def run_available(source: DataFrame, count: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Handles all files that are there and stops; a later call goes on from the checkpoint. Returns the query, which has ended and knows its progress."""

    def batch(rows: DataFrame, number: int) -> None:
        count(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def totals(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The sums over all batches so far."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    return rows.groupBy(*keys).agg(F.sum("total").cast("long").alias("total"), F.sum("correct").cast("long").alias("correct"))


def windowed(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums in tumbling windows with a watermark; works on streams and on tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def remaining(revisions: DataFrame, done: DataFrame) -> DataFrame:
    """Revisions that have no results yet, by key and not by position."""
    return revisions.join(done.select("revision").distinct(), "revision", "left_anti")
