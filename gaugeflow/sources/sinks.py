"""Layer tables, Parquet exports and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_parquet(df: DataFrame, path: str, time_col: str | None = None) -> None:
    """ZSTD Parquet, replaced as a whole; partitioned by day when a time is given.

    Rows are clustered by day before the write, so each day ends up in a few
    files; AQE splits a day that is much larger than the others.
    """
    partitions = []
    if time_col:
        df = df.withColumn("event_date", F.to_date(time_col)).hint("rebalance", "event_date")
        partitions = ["event_date"]
    (df.write.mode("overwrite").option("compression", "zstd")
       .partitionBy(*partitions).parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header, in one file: for aggregated reports only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per task: for data of any size."""
    (df.write.mode("overwrite").option("header", True)
       .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
