"""Helpers of the operators: shared folder, materialised tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def bounded(spark: SparkSession) -> None:
    """Small Arrow batches where the session has Spark's default: batches of texts then need a few MB at both ends."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")):
        now = str(spark.conf.get(key))
        if now.rstrip("b") == default.rstrip("b"):
            spark.conf.set(key, value)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, df: DataFrame) -> str:
    """A name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket(of: Column, modulus: int) -> Column:
    """crc32(text form) mod modulus, the fold of the labelled operators."""
    return F.crc32(of.cast("string").cast("binary")) % F.lit(modulus)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as rows (a, b) of longs; component: the smallest node reachable.

    Alternates the large-star and small-star steps. Every step is one shuffle with map-side
    minima, so a node with very many neighbours does not gather them; each round is
    checkpointed, and the number of rounds grows with the logarithm of the size.
    """
    two_way = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        side = two_way(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = side.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        joined = side.join(low, side.a == low.k)
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = checkpointed(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = checkpointed(star(star(now, True), False))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
