"""Profiling and data-quality aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.config import ASSET, READING_TIME


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order (top-k on every task, no full sort)."""
    return df.orderBy(*order_by).limit(rows)


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: name, rows, NULL cells; a single pass over the data."""
    counts = df.agg(F.count("*").alias("row_count"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot("row_count", list(df.columns), "column_name", "null_count")


def schema_profile(df: DataFrame) -> DataFrame:
    """Column name, type and whether its name suggests a time, with NULL counts."""
    types = dict(df.dtypes)
    described = null_counts(df)
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    name = F.lower("column_name")
    return described.select(
        "column_name",
        F.element_at(kind, F.col("column_name")).alias("column_type"),
        (name.contains("time") | name.contains("date")).alias("time_candidate"),
        "row_count", "null_count")


def warehouse_summary(readings: DataFrame, time_col: str = READING_TIME,
                      keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Rows, time span, days with data and rows beyond the first per asset and timestamp.

    Two counts of distinct values would expand every row twice.  Counting per
    timestamp first, then per day, shuffles each timestamp once.
    """
    per_time = readings.groupBy(*keys, time_col).agg(F.count("*").alias("n"))
    per_day = (per_time.groupBy(F.to_date(time_col).alias("day"))
               .agg(F.sum("n").alias("n"), F.count(time_col).alias("distinct_times"),
                    F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time")))
    return per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.min("first_time").alias("first_timestamp"),
        F.max("last_time").alias("last_timestamp"),
        F.count("day").alias("observed_days"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(F.sum("distinct_times"), F.lit(0)))
        .alias("duplicate_timestamps"))


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{name}") for c in columns
                    for name, f in (("min", F.min), ("max", F.max))])
