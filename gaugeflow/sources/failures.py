"""Failure intervals: the documented breakdowns readings are labelled against."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, types as T

from gaugeflow.config import ASSET
from gaugeflow.session import local_table

FAILURE_SCHEMA = T.StructType([
    T.StructField(ASSET, T.IntegerType(), False),
    T.StructField("event_id", T.IntegerType(), False),
    T.StructField("failure_type", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType(), False),
    T.StructField("end_time", T.TimestampNTZType(), False),
])

# --- fixed values: the documented failures of the published study ------------
STUDY_FAILURES = (
    (0, 1, "Air Leak", "Air System",
     datetime(2022, 6, 4, 10, 19, 24, 300000), datetime(2022, 6, 4, 14, 22, 39, 188000)),
    (0, 2, "Oil Leak", "Compressor",
     datetime(2022, 7, 11, 10, 10, 18, 948000), datetime(2022, 7, 14, 10, 22, 8, 46000)),
)


def failure_table(spark: SparkSession, rows: Iterable[tuple] = STUDY_FAILURES) -> DataFrame:
    return local_table(spark, list(rows), FAILURE_SCHEMA)
