"""Best-so-far and early stopping of training runs while their logs arrive.

The state holds each run's epochs with their metrics, and the revision that gave each: as many rows as the run has epochs. Results may come late, out
of order, more than once or corrected; a row counts if its revision is later than what its epoch has. After each micro-batch the
runs that it touched are judged anew, so whatever the batches, a run's last output is what the batch operators say of its latest revisions.

A call of a stateful function costs about a millisecond, so runs share keys: a key is one of BUCKETS hashes of a run's name, and its state the table
of its runs. A bucket without news is neither read nor written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "run string, epochs int, best double, best_epoch int, stop int, seen long"
STATE = "held binary"  # an Arrow table of HELD
HELD = pa.schema([("run", pa.string()), ("epoch", pa.int32()), ("revision", pa.int64()), ("metric", pa.float64()), ("seen", pa.int64())])
BUCKETS = 4096


def judge(epochs: np.ndarray, metrics: np.ndarray, patience: int, threshold: float, sign: int) -> tuple[float | None, int | None, int | None]:
    """(best, its epoch, the epoch of the stop) of a run in order of epochs; the first of equal bests. A missing metric is no improvement where one was before it."""
    value = np.where(np.isnan(metrics), -np.inf, metrics * sign)
    before = np.append(-np.inf, np.maximum.accumulate(value)[:-1]) if len(value) else value
    improved = ~np.isfinite(before) | (~np.isnan(metrics) & (value > before + threshold)) | np.isnan(metrics)
    last = np.maximum.accumulate(np.where(improved, np.arange(len(value)), -1)) if len(value) else value
    waited = np.flatnonzero(np.arange(len(value)) - last >= patience)
    stop = int(epochs[waited[0]]) if len(waited) else None
    if not len(value) or not np.isfinite(value.max()):
        return None, None, stop
    k = int(value.argmax())
    return float(metrics[k]), int(epochs[k]), stop


def followed(logs: DataFrame, run: Column, epoch: Column, metric: Column, revision: Column, patience: int = 3, threshold: float = 0.001, higher: bool = True) -> DataFrame:
    """(run, epochs, best, best_epoch, stop, seen) of the runs of each micro-batch of a stream of logs; seen: rows of the run so far.

    Rows without a run or epoch count nowhere. revision: a number; of two rows of one epoch the later one counts, of equal ones the first."""
    sign = 1 if higher else -1
    rows = logs.select(run.cast("string").alias("run"), epoch.cast("int").alias("epoch"), metric.cast("double").alias("metric"), revision.cast("long").alias("revision")).filter("run is not null and epoch is not null")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else HELD.empty_table().to_pandas()
        new = pd.concat(parts).assign(seen=1)
        new["revision"] = new.revision.fillna(-(2**62)).astype("int64")
        both = pd.concat([old, new[old.columns]], ignore_index=True) if len(old) else new[old.columns].reset_index(drop=True)
        code = pd.factorize(both.run)[0]
        touched = np.zeros(code.max() + 1, bool)
        touched[code[len(old) :]] = True
        order = np.lexsort((-both.revision.to_numpy(), both.epoch.to_numpy(), code))  # stable: of equal revisions the first stays first
        both, code = both.iloc[order], code[order]
        epoch = both.epoch.to_numpy()
        starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (epoch[1:] != epoch[:-1])))
        seen = np.add.reduceat(both.seen.to_numpy(np.int64), starts)
        both, code = both.iloc[starts].assign(seen=seen), code[starts]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as writer:
            writer.write_table(pa.Table.from_pandas(both, HELD, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
        names, epoch, metric = both.run.to_numpy(), both.epoch.to_numpy(np.int64), both.metric.to_numpy(float)
        ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
        out = []
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            if touched[code[lo]]:
                out.append((names[lo], hi - lo, *judge(epoch[lo:hi], metric[lo:hi], patience, threshold, sign), seen[lo:hi].sum()))
        run, n, best, at, stop, total = zip(*out)
        yield pd.DataFrame({"run": run, "epochs": pd.array(n, "Int32"), "best": pd.array(best, "Float64"), "best_epoch": pd.array(at, "Int32"), "stop": pd.array(stop, "Int32"), "seen": total})

    return rows.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")


def run_available(updates: DataFrame, out: str, checkpoint: str) -> None:
    """Takes what is there and stops. Each micro-batch writes its runs under its number; one that is repeated replaces what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    updates.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last word on every run so far."""
    rows = spark.read.schema(OUT + ", batch long").option("basePath", out).parquet(f"{out}/batch=*")
    names = [f.split()[0] for f in OUT.split(", ")]
    last = F.max(F.struct("batch", *names[1:])).alias("l")
    return rows.groupBy("run").agg(last).select("run", *[f"l.{c}" for c in names[1:]])
