"""Calibration counts over streams: the same bins, kept up to date by event time.

The reference computes batches only; aggregates that need no order over scores carry over to streams unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def windowed_bins(events: DataFrame, time_col: str, confidence: Column, correct: Column, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows (window, bin, n, hits, mass), from which accuracy, mean confidence and calibration error follow by sums."""
    unit = T.confidence_unit(confidence)
    rows = events.withWatermark(time_col, late).select(F.window(time_col, every).alias("window"), unit.alias("unit"), correct.cast("long").alias("hit"))
    rows = rows.where("unit is not null and hit is not null")
    return rows.groupBy("window", T.calibration_bin(F.col("unit")).alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("unit").alias("mass"))


def error_of(bins: DataFrame) -> DataFrame:
    """Calibration error of each window from its (batch) bins."""
    gap = F.abs(F.col("mass") - F.col("hits"))
    return bins.groupBy("window").agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
