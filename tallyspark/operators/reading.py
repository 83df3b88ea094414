"""The reading-time report: what a word's surprisal adds to regressions of eleven measures.

All regressions of a report are one aggregation of products by measure (stats.nested_fits), after one of means; only moments reach the driver, and the report has a row a measure.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats

# The measures and predictors of the reading table.
MEASURES = ["RTfirstfix", "RTfirstpass", "RTgopast", "RTrightbound", "self_paced_reading_time", "ELAN", "LAN", "N400", "P600", "EPNP", "PNP"]
MAIN = ["Subtlex_log10", "length", "context_length"]
SPILLOVER = [*MAIN, "prev_length", "prev_pred"]
REPORT = "measure string, coefficient double, t double, p double, r2 double, delta_r2 double, aic double, delta_aic double, partial double, n long"


def powers(rows: DataFrame, measures: list[str], mains: list[str], added: str = "pred") -> list[dict]:
    """A row for each measure: the model with mains, their products and `added`, against the one without `added`.

    As each model takes the rows that are complete for it, the baseline may have more rows than the model. Two passes over the rows for all measures."""
    wide, names = stats.with_interactions(rows, mains)
    fits, out = stats.nested_fits(wide, measures, names, added), []
    for m in measures:
        base, full = fits[m]
        out.append({
            "measure": m, "coefficient": float(full["coef"][-1]), "t": float(full["t"][-1]), "p": float(full["p"][-1]), "r2": full["r2"], "delta_r2": full["r2"] - base["r2"],
            "aic": full["aic"], "delta_aic": full["aic"] - base["aic"], "partial": (full["r2"] - base["r2"]) / (1 - base["r2"]) if base["r2"] < 1 else 0.0, "n": int(full["n"]),
        })
    return out


def table(spark: SparkSession, found: list[dict]) -> DataFrame:
    rows = [tuple(None if isinstance(v, float) and not math.isfinite(v) else v for v in r.values()) for r in found]
    return spark.createDataFrame(rows, REPORT)


def eye_tracking_score(found: list[dict]) -> float:
    """100 times the mean partial R2 of the measures of eye movements."""
    part = [r["partial"] for r in found if "RT" in r["measure"]]
    return 100 * sum(part) / len(part)


def self_paced_score(found: list[dict]) -> float:
    """100 times the partial R2 of the last self-paced measure, from the regressions with spill-over."""
    return 100 * [r["partial"] for r in found if "self" in r["measure"]][-1]


def correlation_lines(rows: DataFrame, measures: list[str], pred: str = "pred") -> DataFrame:
    """The lines of the correlation file: measure, tab, r with four digits; one pass over all measures."""
    long = rows.select(F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))])).alias("measure", "v"), pred)
    place = {m: k for k, m in enumerate(measures)}
    at = F.element_at(F.create_map(*[x for m, k in place.items() for x in (F.lit(m), F.lit(k))]), F.col("measure"))
    r = stats.pearson(long, F.col("v"), F.col(pred), ["measure"])
    return r.orderBy(at).select(F.concat_ws("\t", "measure", F.coalesce(F.format_string("%.4f", "r"), F.lit("nan"))).alias("value"))


def report_lines(eye: float, self_paced: float) -> list[str]:
    return [f"EYE TRACKING SCORE: {eye:.2f}", f"SELF-PACED READING SCORE: {self_paced:.2f}"]


def prediction_rows(rows: DataFrame) -> DataFrame:
    """The rows of the prediction file: Index, Sentence, Word, Logprob, Prev_Logprob."""
    return rows.select(F.col("index").alias("Index"), F.col("item").alias("Sentence"), F.col("word").alias("Word"), F.col("pred").alias("Logprob"), F.col("prev_pred").alias("Prev_Logprob"))
