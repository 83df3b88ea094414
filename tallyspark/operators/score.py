"""Scores: where they come from, and how token scores become candidate scores.

A scorer is any function from a DataFrame with one row a candidate to the same rows with `logprob`. Inference itself is outside:
scores are a column, a surrogate, or come from a function over pandas batches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, hash_score


LOG = logging.getLogger("tallyspark.score")


class Scorer(Protocol):
    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def precomputed(column: str) -> Scorer:
    return lambda candidates: candidates.withColumn("logprob", finite(F.col(column).cast("double")))


def surrogate(*key: str) -> Scorer:
    """A repeatable stand-in for a model: minus the hash of the key."""
    return lambda candidates: candidates.withColumn("logprob", -hash_score(F.concat_ws("-", *key)))


def batched(score: Callable[[pd.DataFrame], pd.Series]) -> Scorer:
    """A model behind a function over batches of rows. Where a batch fails its rows are scored one by one, and those that fail alone score NaN, which is null here."""

    def one_by_one(batch: pd.DataFrame) -> list[float]:
        out = []
        for k in range(len(batch)):
            try:
                out.append(float(score(batch.iloc[[k]]).iloc[0]))
            except Exception as e:  # a model's own errors: an input that it can't score isn't a failed job
                LOG.warning("a row couldn't be scored: %s", e)
                out.append(float("nan"))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = score(batch).astype(float)
            except Exception as e:
                LOG.warning("a batch of %d rows failed: %s", len(batch), e)
                found = one_by_one(batch)
            yield batch.assign(logprob=found)

    def scorer(candidates: DataFrame) -> DataFrame:
        schema = candidates.select("*", F.lit(None).cast("double").alias("logprob")).schema
        return candidates.mapInPandas(run, schema).withColumn("logprob", finite(F.col("logprob")))

    return scorer


def exploded(items: DataFrame, item: list[str]) -> DataFrame:
    """One row a candidate of canonical data: item columns, uid, label, cand_idx and the candidate's fields."""
    return items.select(*item, "uid", "label", F.posexplode("candidates").alias("cand_idx", "c")).select(*item, "uid", "label", "cand_idx", "c.*")


def at_temperatures(scores: DataFrame, temperatures: list[float]) -> DataFrame:
    """Every score divided by each temperature: (…, temp, logprob)."""
    grid = F.explode(F.array(*map(F.lit, temperatures))).alias("temp")
    return scores.select("*", grid).withColumn("logprob", F.col("logprob") / F.col("temp"))


def sequence_scores(tokens: DataFrame, key: list[str], value: str = "logprob", inside: Column | None = None) -> DataFrame:
    """The sum over the tokens of each candidate, or over those inside the phrase."""
    x = F.col(value) if inside is None else F.when(inside, F.col(value)).otherwise(0.0)
    return tokens.groupBy(*key).agg(F.sum(x).alias("logprob"), F.count("*").alias("n_tokens"))


def word_surprisal(tokens: DataFrame, key: list[str], probability: str) -> DataFrame:
    """-ln of the product of sub-token probabilities, as a sum of logarithms; a zero gives infinity."""
    p = F.col(probability)
    return tokens.groupBy(*key).agg((-F.sum(F.when(p > 0, F.ln(p)).otherwise(F.lit(float("-inf"))))).alias("surprisal"))
