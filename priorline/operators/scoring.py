"""Proper scores, calibration and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.functions.calendar import monday
from priorline.functions.probability import brier, log_loss

BINS = 10
Z_95 = 1.959963984540054
DIGITS = 6


def score_summary(rows: DataFrame, by: list[str], p: str = "p", won: str = "won") -> DataFrame:
    """Count, Brier score, log loss and accuracy by ``by``, and over all with nulls for it."""
    c, w = F.col(p), F.col(won)
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(brier(c, w)), DIGITS).alias("brier"),
        F.round(F.avg(log_loss(c, w)), DIGITS).alias("log_loss"),
        F.round(F.avg(((c >= 0.5) == w).cast("double")), DIGITS).alias("accuracy"),
    ]
    return rows.rollup(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def reliability_bins(rows: DataFrame, p: str = "p", won: str = "won", bins: int = BINS) -> DataFrame:
    number = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(won).cast("double")).alias("rate"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def calendar_blocks(rows: DataFrame, value: Column, season: str, day: str) -> DataFrame:
    """Sum and count of ``value`` by season and Monday week."""
    return rows.groupBy(season, monday(F.col(day)).alias("week")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def paired_delta(rows: DataFrame, delta: Column, by: list[str]) -> DataFrame:
    """Mean, standard error and normal 95% interval of a paired difference."""
    spread = Z_95 * F.sqrt(F.var_samp("_d") / F.count("_d"))
    grouped = rows.withColumn("_d", delta).groupBy(*by)
    return grouped.agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), (F.avg("_d") - spread).alias("low"), (F.avg("_d") + spread).alias("high"))
