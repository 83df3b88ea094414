"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Equal rows are counted and told apart by their ordinals, so a lost task draws the same again, and copies go
different ways. Rows are dealt to source partitions by a hash of their content and ordinal. For every source partition the number of rows
that it sends to each shard is drawn from the multivariate hypergeometric distribution, one
partition after the other out of what the shards still have room for: the law of a uniform permutation,
with shard sizes exact. Each partition permutes its rows and cuts them by its row of the matrix; after the exchange
each shard permutes again, in cells of bounded size, which gives the slots. Partitions hold about `ROWS_A_PARTITION` rows, and more where there
would be more than `MOST_PARTITIONS` of them: a partition is sorted, not held, so it may grow, while the matrix, which the driver draws
from the partitions' row counts, stays within a few hundred thousand numbers however many rows there are.

Law `rows`: shard sizes differ by one at most. Null texts count as empty. Rows that agree in everything are
interchangeable; ids may repeat or be null. An empty table gives an empty result. Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, stored

ROWS_A_PARTITION = 100_000  # on average
COPIES_A_ROW = 10_000  # of more equal rows, each so many are made in a task of their own
MATRIX = 1_000_000  # numbers of a matrix that is broadcast (8 MB); a larger one is joined by a shuffle
LEAST_PARTITIONS = 64
MOST_PARTITIONS = 20_000


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric variate: how many of n drawn are good; of any size, in time that doesn't depend on it."""
    if not n or not good or not bad:
        return min(good, n)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return large(rng, good, bad, n)


def large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same by ratio of uniforms: points of a table's hat around the mode, each kept with the odds of its probability to that of the mode."""
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)) + 0.5)
    # a hat of this width lies above the square root of every probability's odds (log-concave, so a width by the spread is enough)
    width, centre = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e)), n * (good / total) + 0.5
    at_mode = _ln(good, bad, n, mode)
    while True:
        u = 1.0 - rng.random()
        k = math.floor(centre + width * (rng.random() - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= _ln(good, bad, n, k) - at_mode:
            return k


def _ln(good: int, bad: int, n: int, k: int) -> float:
    """The logarithm of a probability, but for a constant."""
    return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))


def communication(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard; columns sum to sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        row, rest = [], sum(room)
        for s in range(shards):
            rest -= room[s]
            k = draw(rng, room[s], rest, n)
            row.append(k)
            n -= k
        room = [a - b for a, b in zip(room, row)]
        out.append(row)
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with __o, the ordinal among equal rows. Nothing is sorted or gathered: they are counted, with map-side combine, and made again."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES_A_ROW}")))
    few = counts.filter(F.col("__n") <= COPIES_A_ROW).withColumn("__block", F.lit(0).cast("long"))
    many = counts.filter(F.col("__n") > COPIES_A_ROW).withColumn("__block", block).repartition(partitions(rows.sparkSession), *rows.columns, "__block")
    last = F.least(F.col("__n"), (F.col("__block") + 1) * COPIES_A_ROW) - 1
    return few.union(many).withColumn("__o", F.explode(F.sequence(F.col("__block") * COPIES_A_ROW, last))).drop("__n", "__block")


def shuffled(rows: DataFrame, shards: int = 16, seed: int = 20240611, rows_a_partition: int = ROWS_A_PARTITION) -> DataFrame:
    """`rows` with shard and slot (gapless from 0 in each shard); all columns together tell rows apart."""
    spark, key = rows.sparkSession, [F.col(c) for c in rows.columns]
    rows = stored(numbered(rows))
    total = rows.count()
    parts = min(MOST_PARTITIONS, max(LEAST_PARTITIONS, -(-total // rows_a_partition)))
    h = [F.xxhash64(*key, F.col("__o"), F.lit(seed + k)) for k in range(3)]
    base = rows.withColumns({"__p": F.pmod(h[0], F.lit(parts)), "__a": h[1], "__b": h[2]})
    counts = {r["__p"]: r["n"] for r in base.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    drawn = [{"p": p, "ends": np.cumsum(row).tolist()} for p, row in enumerate(communication([counts.get(p, 0) for p in range(parts)], shards, seed))]
    matrix = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(drawn)), "array<struct<p:bigint,ends:array<bigint>>>")))
    matrix = F.broadcast(matrix) if parts * shards <= MATRIX else matrix
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__a", *key, "__o")) - 1
    cells = max(1, -(-total // shards // rows_a_partition))
    sent = base.withColumn("__r", rank).join(matrix, F.col("__p") == F.col("p")).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("__r"))).cast("int"))
    sent = stored(sent.withColumn("__c", F.pmod(F.col("__b"), F.lit(cells)).cast("int")).drop("__p", "__a", "__r", "p", "ends"))
    sizes = sent.groupBy("shard", "__c").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "__c", (F.sum("n").over(Window.partitionBy("shard").orderBy("__c")) - F.col("n")).alias("__before"))
    if shards * cells <= 100_000:
        before = F.broadcast(before)
    within = F.row_number().over(Window.partitionBy("shard", "__c").orderBy("__b", *key, "__o")) - 1
    return sent.withColumn("__w", within).join(before, ["shard", "__c"]).withColumn("slot", (F.col("__before") + F.col("__w")).cast("long")).drop("__b", "__c", "__w", "__before", "__o")


def shard_documents(docs: DataFrame, shards: int = 16, **how) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled(facts, shards, **how)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
