"""Joins of time-stamped rows with intervals of the same asset."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.config import ASSET, MINUTE
from gaugeflow.functions.expr import micros

# An interval table is broadcast only up to this many rows (about 2 MB), and only
# while no asset has so many intervals that probing them per row would cost.
BROADCAST_ROWS = 20_000
BROADCAST_PER_ASSET = 256
BUCKET_SECONDS = 6 * 3600


def fits_broadcast(intervals: DataFrame, keys: Sequence[str] = (ASSET,),
                   limit: int = BROADCAST_ROWS, per_key: int = BROADCAST_PER_ASSET) -> bool:
    """Whether the table is small enough to broadcast; reads at most ``limit + 1`` rows."""
    seen = Counter(intervals.select(*keys).limit(limit + 1).collect())
    return seen.total() <= limit and max(seen.values(), default=0) <= per_key


def match_intervals(rows: DataFrame, intervals: DataFrame, low: str, high: str, *,
                    keys: Sequence[str] = (ASSET,), time_col: str = MINUTE,
                    include_high: bool = False,
                    broadcast_rows: int = BROADCAST_ROWS,
                    bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Inner join on ``keys`` with ``low <= time < high`` (``<= high`` on request).

    A small interval table is broadcast and probed by asset: the rows are never
    shuffled.  Beyond ``broadcast_rows`` both sides meet on (asset, time bucket);
    an interval is listed once per bucket it touches and a row lies in exactly
    one bucket, so no pair is produced twice and a busy asset is spread over
    time.  A bucket that is still hot is split by adaptive skew handling.
    """
    t = F.col(time_col)
    upper = (t <= F.col(high)) if include_high else (t < F.col(high))
    inside = (t >= F.col(low)) & upper
    if fits_broadcast(intervals, keys, broadcast_rows):
        right = F.broadcast(intervals)
        names = list(keys)
    else:
        width = F.lit(bucket_seconds * 1_000_000)
        bucket = "_bucket"
        first, last = F.floor(micros(low) / width), F.floor(micros(high) / width)
        right = (intervals.filter(F.col(low) <= F.col(high))
                 .withColumn(bucket, F.explode(F.sequence(first, last))))
        rows = rows.withColumn(bucket, F.floor(micros(time_col) / width))
        names = [*keys, bucket]
    joined = rows.join(right, names, "inner").filter(inside)
    return joined.drop("_bucket")


def count_in_intervals(rows: DataFrame, intervals: DataFrame, low: str, high: str,
                       id_cols: Sequence[str], *, keys: Sequence[str] = (ASSET,),
                       time_col: str = MINUTE, name: str = "observations",
                       **options) -> DataFrame:
    """Rows per interval, both bounds included; an empty interval counts 0."""
    counts = (match_intervals(rows.select(*keys, time_col), intervals, low, high,
                              keys=keys, time_col=time_col, include_high=True, **options)
              .groupBy(*keys, *id_cols).agg(F.count("*").alias(name)))
    return (intervals.join(counts, [*keys, *id_cols], "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0))))
