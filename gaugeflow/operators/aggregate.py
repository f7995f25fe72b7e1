"""Downsampling of irregular readings to one row per asset and minute."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.config import ASSET, MINUTE, MINUTE_STATS, READING_TIME
from gaugeflow.functions.expr import truncate

STATISTICS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "active_rate": F.avg,
}


def minute_aggregate(readings: DataFrame, keys: Sequence[str] = (ASSET,),
                     time_col: str = READING_TIME,
                     stats: Mapping[str, Sequence[str]] = MINUTE_STATS) -> DataFrame:
    """Group readings by minute; minutes without readings do not appear.

    All statistics combine on the map side, so the shuffle carries minutes, not
    readings, and a minute with very many readings stays cheap.
    """
    return (
        readings
        .groupBy(*keys, truncate("minute", time_col).alias(MINUTE))
        .agg(F.count("*").alias("readings"),
             *[STATISTICS[stat](column).alias(f"{column}_{stat}")
               for column, wanted in stats.items() for stat in wanted])
    )


def minute_summary(minutes: DataFrame) -> DataFrame:
    return minutes.agg(
        F.count("*").alias("minutes"),
        F.min(MINUTE).alias("first_minute"), F.max(MINUTE).alias("last_minute"),
        F.round(F.avg("readings"), 2).alias("average_readings"),
        F.min("readings").alias("min_readings"), F.max("readings").alias("max_readings"))
