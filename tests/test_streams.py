"""Streams of training logs: whatever the batches, the last word on each run is that of the batch operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import progress
from tallyspark.streaming import incremental, progress_stream

SCHEMA = "model string, step int, score double, version long, extra string"


def made(seed, runs=12):
    """Logs with late, repeated and corrected rows."""
    r = random.Random(seed)
    rows = []
    for k in range(runs):
        level = 0.0
        for e in range(r.randrange(1, 15)):
            level += r.choice([0.1, 0.0005, 0.0, -0.1, -0.05])
            rows.append((f"run{k}", e, None if r.random() < 0.05 else round(level, 4), 1, "x"))
            if r.random() < 0.3:
                rows.append((f"run{k}", e, round(level + r.uniform(-0.2, 0.2), 4), r.choice([0, 2, 3]), "y"))
    rows += r.sample(rows, len(rows) // 5)  # repeats
    r.shuffle(rows)
    return rows + [(None, 1, 0.5, 1, ""), ("run0", None, 9.0, 1, "")]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def by_batch(spark, rows, higher):
    """What the batch operators say of the latest revisions."""
    best = {}
    for m, e, s, v, _ in rows:
        if m is not None and e is not None and ((m, e) not in best or v > best[m, e][0]):
            best[m, e] = (v, s)
    df = spark.createDataFrame([(m, e, s) for (m, e), (_, s) in best.items()], "run string, epoch int, metric double")
    stops = {x.run: x.stop for x in progress.stopped_at(df, ["run"], "epoch", "metric", higher=higher).collect()}
    last = {}
    for x in progress.best_so_far(df, ["run"], "epoch", "metric", higher).collect():
        if x.run not in last or x.epoch > last[x.run][0]:
            last[x.run] = (x.epoch, x.best)
    size = {}
    for m, _ in best:
        size[m] = size.get(m, 0) + 1
    return {m: (size[m], b, stops[m]) for m, (_, b) in last.items()}


@pytest.mark.parametrize("seed, higher", [(1, True), (2, False)])
def test_whatever_the_batches(spark, tmp_path, seed, higher):
    rows = made(seed)
    # of equal revisions of an epoch that differ, the first one seen counts: let there be none
    first = {}
    rows = [(m, e, first.setdefault((m, e, v), s), v, x) for m, e, s, v, x in rows]
    want = by_batch(spark, rows, higher)
    for name, cuts in (("one", [len(rows)]), ("many", [1, 7, 30, len(rows) // 2, len(rows)])):
        source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
        lo = 0
        for hi in cuts:
            write(spark, rows[lo:hi], source)
            lo = hi
            stream = incremental.parquet_stream(spark, source, 2)
            progress_stream.run_available(progress_stream.followed(stream, *map(F.col, ("model", "step", "score", "version")), higher=higher), out, state)
        got = {r.run: (r.epochs, r.best, r.stop) for r in progress_stream.latest(spark, out).collect()}
        assert got == want
        seen = {r.run: r.seen for r in progress_stream.latest(spark, out).collect()}
        assert sum(seen.values()) == len(rows) - 2
        at = {r.run: (r.best, r.best_epoch) for r in progress_stream.latest(spark, out).collect()}
        assert all((b is None) == (e is None) for b, e in at.values())


def test_runs_share_the_calls_of_their_state(spark, tmp_path):
    """Many short runs are a few tables of state, not a call each; a later batch judges only the runs that it touches."""
    rows = [(f"r{k}", e, float((k * 7 + e * 3) % 11), 1, 0) for k in range(20_000) for e in range(3)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    columns = list(map(F.col, ("model", "step", "score", "version")))
    for part in (rows, [("r5", 3, 99.0, 1, 0), ("r5", 0, -1.0, 2, 0), ("new", 1, 2.0, 1, 0)]):
        write(spark, part, source)
        progress_stream.run_available(progress_stream.followed(incremental.parquet_stream(spark, source), *columns), out, state)
    stored = spark.read.format("statestore").load(state)
    assert stored.count() <= progress_stream.BUCKETS
    got = {r.run: r for r in progress_stream.latest(spark, out).collect()}
    assert len(got) == 20_001 and all(got[f"r{k}"].best == max((k * 7 + e * 3) % 11 for e in range(3)) for k in range(20_000) if k != 5)
    assert (got["r5"].epochs, got["r5"].best, got["r5"].best_epoch, got["r5"].seen, got["new"].best) == (4, 99.0, 3, 5, 2.0)
    assert {r.run for r in spark.read.parquet(out).filter("batch > 0").collect()} == {"r5", "new"}


def test_judge():
    nan = math.nan
    j = lambda m, **k: progress_stream.judge(__import__("numpy").arange(len(m)), __import__("numpy").array(m, float), **({"patience": 2, "threshold": 0.0, "sign": 1} | k))
    assert j([]) == (None, None, None) and j([nan]) == (None, None, None)
    assert j([1, 2, 2, 2]) == (2.0, 1, 3) and j([3, 2, 1], sign=-1) == (1.0, 2, None)
    assert j([1, 1.05, 1.1], threshold=0.2) == (1.1, 2, 2)


def test_windows_of_a_stream(spark, tmp_path):
    """Counts by hour: a stream with a watermark gives those of the table, once their windows are closed."""
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "ab"[m % 2], float(m)) for h in range(5) for m in range(0, 60, 7)]
    table = spark.createDataFrame(rows, "t string, k string, value double").select(F.to_timestamp("t").alias("ts"), "k", "value")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r.window.start, r.k): (r.n, r.total) for r in incremental.windowed(table, "ts", "k").collect()}
    assert len(want) == 10
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got: dict = {}

    def batch(df, number):
        got.update({(r.window.start, r.k): (r.n, r.total) for r in df.collect()})

    incremental.windowed(stream, "ts", "k").writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got == want
