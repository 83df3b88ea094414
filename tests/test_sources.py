"""Sources and scorers: fallbacks, column checks, images, inputs that fail alone, leaderboards."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.scalars import learning_rate
from tallyspark.operators import relate, score, stats
from tallyspark.sources import datasets, readers


def test_dataset_fallbacks(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("q", "a")], "question string, answer string").write.parquet(f"{root}/one/default/train.parquet")
    spark.createDataFrame([("x", "b")], "question string, answer string").write.parquet(f"{root}/two/fr/test.parquet")
    take = lambda name, configs, needed=(): datasets.dataset_or_none(spark, root, name, configs, needed)
    assert take("one", ["fr", "default"]).first().question == "q" and take("two", ["fr", "default"]).first().split == "test"
    assert take("two", ["de"]) is None and take("three", ["de", "default"]) is None
    assert take("one", ["default"], ["question"]) is not None
    with pytest.raises(ValueError, match="no column label"):
        take("one", ["default"], ["question", "label"])


def test_a_failed_input_is_missing_alone(spark):
    def model(batch):
        if (batch.x < 0).any():
            raise RuntimeError("no such input")
        return batch.x * 2.0

    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, -1, 3, -4, 5])], "k int, x double").coalesce(1)
    assert {r.k: r.logprob for r in score.batched(model)(df).collect()} == {0: 2.0, 1: None, 2: 6.0, 3: None, 4: 10.0}
    none = score.batched(lambda b: 1 / 0)(df).collect()
    assert len(none) == 5 and all(r.logprob is None for r in none)


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0), (2, 0, -4.0), (2, 1, None)], "k int, pos int, logprob double")
    assert {r.k: (r.logprob, r.n_tokens) for r in score.sequence_scores(rows, ["k"]).collect()} == {1: (-3.0, 2), 2: (-4.0, 2)}
    assert {r.k: r.logprob for r in score.sequence_scores(rows, ["k"], inside=F.col("pos") > 0).collect()} == {1: -2.0, 2: 0.0}


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG1")
    (tmp_path / "b.txt").write_bytes(b"text")
    got = readers.images(spark, str(tmp_path)).collect()
    assert len(got) == 2 or [bytes(r.content) for r in got] == [b"\x89PNG1"]
    assert b"\x89PNG1" in {bytes(r.content) for r in got}


def test_schedule(spark):
    at = lambda s: spark.range(1).select(learning_rate(F.lit(s), 1100, 100, 2.0)).first()[0]
    assert at(0) == 0 and at(50) == 1.0 and abs(at(100) - 2.0) < 1e-12 and abs(at(600) - 1.1) < 1e-12 and abs(at(1100) - 0.2) < 1e-12
    assert abs(at(350) - 2 * (0.1 + 0.9 * (1 + math.cos(math.pi / 4)) / 2)) < 1e-12


def test_residual(spark):
    rows = spark.createDataFrame([(float(x), 3.0 * x + 1 + (x % 2)) for x in range(10)], "x double, y double")
    got = [r.r for r in stats.residual(rows, "y", ["x"], "r").collect()]
    assert abs(sum(got)) < 1e-9 and abs(sum(a * x for a, x in zip(got, range(10)))) < 1e-9 and max(map(abs, got)) < 1


def test_leaderboard(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 1.5), ("c", "x", 0.75), ("c", "y", 0.75), ("d", "z", None), ("e", None, 9.0)], "m string, t string, v double")
    got = {r.m: (r.macro, r.present, r.place) for r in relate.leaderboard(rows, "m", "t", "v").collect()}
    assert got == {"a": (0.5, 2, 1), "b": (0.5, 1, 1), "c": (0.5, 2, 1), "d": (0.0, 0, 4)}
    only = {r.m: r.macro for r in relate.leaderboard(rows, "m", "t", "v", ["x", "w"]).collect()}
    assert only == {"a": 0.5, "b": 0.75, "c": 0.375}
