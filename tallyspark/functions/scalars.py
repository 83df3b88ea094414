"""Scalar expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")


def hash_score(of: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of the md5: the surrogate of a model's score, and the order of samples."""
    return F.conv(F.substring(F.md5(of.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def strip(of: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(of, r"(?U)^\s+|\s+$", "")


def tokens(of: Column) -> Column:
    """White-space tokens, none of them empty."""
    return F.filter(F.split(of, r"\s+"), lambda t: t != "")


def finite(of: Column) -> Column:
    """NaN as null: at the source's boundary missing is null."""
    return F.when(F.isnan(of), F.lit(None)).otherwise(of)


def lowest_if_missing(of: Column) -> Column:
    """Null and NaN rank below every number."""
    return F.nanvl(F.coalesce(of.cast("double"), F.lit(NEVER)), F.lit(NEVER))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b as a double; `empty` where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty).cast("double"))


def step_number(of: Column) -> Column:
    """A training step's name as a number: 10M, 2.5k or 300; null where there is none."""
    number = F.regexp_extract(of, r"(?i)(\d+(?:\.\d+)?)\s*([KMB]?)", 1)
    unit = F.upper(F.regexp_extract(of, r"(?i)(\d+(?:\.\d+)?)\s*([KMB]?)", 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * factor)


def learning_rate(step: Column, total: int, warmup: int, peak: float, least_share: float = 0.1) -> Column:
    """A cosine schedule with linear warm-up."""
    done = (step - warmup) / float(max(1, total - warmup))
    cosine = (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * done)) / 2
    return F.when(step < warmup, F.lit(peak) * step / float(max(1, warmup))).otherwise(F.lit(peak) * F.greatest(F.lit(least_share), least_share + (1 - least_share) * cosine))
