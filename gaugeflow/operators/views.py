"""Result tables shaped for a maintenance console."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from gaugeflow.config import ASSET, DRIFT_COLUMNS, MINUTE, MODEL_COLUMNS
from gaugeflow.functions.expr import lookup, shift_hours
from gaugeflow.operators.decisions import first_useful_warning, savings
from gaugeflow.operators.episodes import episode_summary
from gaugeflow.operators.intervals import match_intervals
from gaugeflow.operators.labels import lookback_windows, merged_lookbacks
from gaugeflow.operators.monitoring import monitoring_status


def time_window(decisions: DataFrame, failures: DataFrame | None = None, mode: str = "full",
                keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Rows of one time view; both ends of a window are included.

    ``warning``: the day up to each given failure; ``latest``: the last 48 hours
    of data; ``full``: everything.  A row comes once, however many failures are near.
    """
    if mode == "warning":
        windows = merged_lookbacks(failures, 24, keys)
        return match_intervals(decisions, windows, "window_start", "start_time", keys=keys,
                               include_high=True).drop("window_start", "start_time")
    if mode == "latest":
        newest = decisions.agg(F.max(MINUTE)).scalar()
        return (decisions.withColumn("_newest", newest)
                .filter(F.col(MINUTE) >= shift_hours("_newest", -48)).drop("_newest"))
    if mode == "full":
        return decisions
    raise ValueError(f"unknown time view: {mode}")


def latest(decisions: DataFrame, keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """The newest row of each asset: its time by partial aggregation, then the row at it."""
    newest = decisions.groupBy(*keys).agg(F.max(MINUTE).alias(MINUTE))
    return decisions.join(newest, [*keys, MINUTE], "left_semi")


def failure_window(decisions: DataFrame, failures: DataFrame, hours: float = 24,
                   keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Risk series before each failure; the failure's own start is left out."""
    windows = lookback_windows(failures.select(*keys, "event_id", "start_time"), hours)
    return match_intervals(
        decisions.select(*keys, MINUTE, "maintenance_priority_score", "risk_level",
                         "early_warning_score", "near_failure_score", "anomaly_percentile"),
        windows, "window_start", "start_time", keys=keys).drop("window_start", "start_time")


def kpis(decisions: DataFrame, episodes: DataFrame, costs: DataFrame, failures: DataFrame,
         keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Headline figures as one row; the lead is the longest, 0 without a warning."""
    lead = first_useful_warning(decisions, failures, keys=keys).agg(
        F.coalesce(F.max("lead_hours"), F.lit(0.0)))
    return (episode_summary(episodes)
            .withColumn("warning_hours", lead.scalar())
            .withColumn("avoided_cost", savings(costs).select("avoided_cost").scalar()))


def episode_table(episodes: DataFrame) -> DataFrame:
    return episodes.withColumn("failure_related",
                               lookup("failure_related", {1: "Yes", 0: "No"}))


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """The chosen columns, fractional numbers rounded half-even."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.bround(c, digits).alias(c) if isinstance(kinds[c], T.FractionalType) else F.col(c)
        for c in columns])


def model_table(comparison: DataFrame) -> DataFrame:
    return rounded(comparison, MODEL_COLUMNS, 3)


def drift_table(report: DataFrame) -> DataFrame:
    return rounded(report, DRIFT_COLUMNS, 4)


def drift_summary(report: DataFrame) -> DataFrame:
    return monitoring_status(report)


def weekly_series(weekly: DataFrame) -> DataFrame:
    return weekly.select("week_start", "mean_failure_probability",
                         (F.col("alert_rate_percent") / 100).alias("alert_rate"))
