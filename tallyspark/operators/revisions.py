"""The revision axis: checkpoints by words seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def names(track: str = "strict") -> list[str]:
    """1M to 9M, 10M to 100M by tens, and beyond the small track 200M to 1000M by hundreds."""
    millions = [*range(1, 10), *range(10, 101, 10), *([] if track == "small" else range(200, 1001, 100))]
    return [f"chck_{m}M" for m in millions]


def axis(spark: SparkSession, track: str = "strict") -> DataFrame:
    """(ord, revision, word_count)."""
    array = F.array(*map(F.lit, names(track)))
    at = spark.range(1).select(F.posexplode(array).alias("ord", "revision"))
    return at.withColumn("word_count", (F.regexp_extract("revision", r"(\d+)M", 1).cast("long") * 1_000_000))
