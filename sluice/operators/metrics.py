"""Activity of tables: totals, latest values, and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """Count, sum, greatest and last value of each table and action; combined before the shuffle."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"), F.max_by(value, at).alias("last_value"), F.max(at).alias("last_at"))


def growth(samples: DataFrame, by: str, value: str, at: str, since: Column, top: int = 20) -> DataFrame:
    """What grew most since a time: last less first value of the window, and the slope a second."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    window = samples.where(F.col(at) >= since)
    grown = window.groupBy(by).agg((F.max_by(value, at) - F.min_by(value, at)).alias("increase"), F.regr_slope(F.col(value).cast("double"), seconds).alias("slope"))
    return grown.orderBy(F.desc("increase"), by).limit(top)
