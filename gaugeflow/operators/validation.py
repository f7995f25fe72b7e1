"""Checks of the windows before failures: telemetry, labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gaugeflow.config import ASSET, MINUTE, TARGETS
from gaugeflow.functions.expr import hours_between, minutes_between
from gaugeflow.operators.intervals import match_intervals
from gaugeflow.operators.labels import lookback_windows
from gaugeflow.operators.metrics import PAIR, horizon_windows
from gaugeflow.operators.prefix import exact_median


def window_coverage(rows: DataFrame, failures: DataFrame, horizons: dict[str, float],
                    keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Observed rows, span and largest gap in every failure's windows.

    The longest window holds the shorter ones, so rows are matched and put in
    order once per failure.  Empty windows count 0 and have NULL times and gap.
    """
    longest = max(horizons.values())
    ids = [*keys, "event_id"]
    windows = lookback_windows(failures.select(*ids, "start_time"), longest)
    matched = match_intervals(rows.select(*keys, MINUTE), windows, "window_start",
                              "start_time", keys=keys)
    in_order = W.partitionBy(*ids, "start_time").orderBy(MINUTE)
    grid = horizon_windows(failures, horizons, keys)
    starts = F.array(*[
        F.struct(F.lit(h).alias("horizon"),
                 (F.col("start_time") - F.make_dt_interval(secs=F.lit(hours * 3600.0)))
                 .alias("low")) for h, hours in horizons.items()])
    gaps = (matched.withColumn("_previous", F.lag(MINUTE).over(in_order))
            .withColumn("_w", F.explode(starts))
            .filter(F.col(MINUTE) >= F.col("_w.low"))
            .withColumn("_gap", F.when(F.col("_previous") >= F.col("_w.low"),
                                       minutes_between("_previous", MINUTE))))
    seen = gaps.groupBy(*ids, F.col("_w.horizon").alias("horizon")).agg(
        F.count("*").alias("observed"), F.min(MINUTE).alias("first_observed"),
        F.max(MINUTE).alias("last_observed"),
        F.coalesce(F.max("_gap"), F.lit(0.0)).alias("largest_gap_minutes"))
    expected = F.col("hours") * 60
    observed = F.coalesce(F.col("observed"), F.lit(0))
    return grid.join(seen, [*ids, "horizon"], "left").select(
        *ids, "horizon",
        expected.cast("long").alias("expected_minutes"), observed.alias("observed_minutes"),
        (observed / expected * 100).alias("coverage_percent"),
        "first_observed", "last_observed",
        hours_between("first_observed", "start_time").alias("earliest_lead_hours"),
        "largest_gap_minutes")


def largest_gap(rows: DataFrame, failures: DataFrame, horizons: dict[str, float],
                keys: Sequence[str] = (ASSET,)) -> DataFrame:
    return window_coverage(rows, failures, horizons, keys).select(
        *keys, "event_id", "horizon", "largest_gap_minutes")


def prediction_behaviour(alerts: DataFrame, failures: DataFrame, horizons: dict[str, float],
                         keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Probabilities and alerts of each model inside each failure's window."""
    ids = [*keys, "event_id", *PAIR]
    rows = match_intervals(
        alerts.select(*keys, MINUTE, *PAIR, "failure_probability", "alert_threshold", "alert"),
        horizon_windows(failures, horizons, keys), "window_start", "start_time",
        keys=[*keys, "horizon"])
    stats = rows.groupBy(*ids).agg(
        F.count("*").alias("observations"), F.sum("alert").alias("alerts"),
        (F.avg("alert") * 100).alias("alert_rate_percent"),
        F.avg("failure_probability").alias("mean_probability"),
        F.max("failure_probability").alias("max_probability"),
        F.max("alert_threshold").alias("threshold"),
        F.max(F.when(F.col("alert") == 1, hours_between(MINUTE, "start_time")))
        .alias("first_warning_hours"))
    medians = exact_median(rows, ids, "failure_probability", "median_probability")
    return stats.join(medians, ids, "left")


def positive_distribution(rows: DataFrame, failures: DataFrame, hours: float = 24,
                          targets: dict[str, str] = TARGETS,
                          keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Where positive labels lie in the day before a failure, per target."""
    names = list(targets.values())
    matched = match_intervals(
        rows.select(*keys, MINUTE, *names),
        lookback_windows(failures.select(*keys, "event_id", "start_time"), hours),
        "window_start", "start_time", keys=keys)
    ids = [*keys, "event_id", "start_time"]
    positive = (matched.unpivot([*ids, MINUTE], names, "target", "positive")
                .filter(F.col("positive") == 1))
    return (positive.groupBy(*ids, "target")
            .agg(F.count("*").alias("positive_rows"), F.min(MINUTE).alias("earliest_positive"),
                 F.max(MINUTE).alias("latest_positive"))
            .withColumns({
                "earliest_lead_hours": hours_between("earliest_positive", "start_time"),
                "latest_lead_hours": hours_between("latest_positive", "start_time")})
            .drop("start_time"))
