"""Score fusion, risk level, recommended action and cost roll-up."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from gaugeflow.config import (ALERT_LEVELS, ASSET, COST_SCENARIOS, EARLY_MODEL, MEDIUM_SCORE,
                              MINUTE, NEAR_MODEL, PRIORITY_WEIGHTS, RISK_ACTIONS,
                              RISK_PERCENTILE, SENSOR_COLUMNS, SIGNAL_LABELS, CostScenario)
from gaugeflow.functions.expr import (clip, first_largest, hours_between, lookup,
                                      threshold_component)
from gaugeflow.operators.intervals import match_intervals
from gaugeflow.operators.labels import lookback_windows
from gaugeflow.session import local_table


def select_predictions(alerts: DataFrame, pair: tuple[str, str], prefix: str,
                       keys: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
    horizon, model = pair
    return (alerts.filter((F.col("horizon") == horizon) & (F.col("model") == model))
            .select(*keys, F.col("failure_probability").alias(f"{prefix}_score"),
                    F.col("alert_threshold").alias(f"{prefix}_threshold"),
                    F.col("alert").alias(f"{prefix}_alert")))


def fuse_predictions(rows: DataFrame, alerts: DataFrame, since: datetime,
                     early: tuple[str, str] = EARLY_MODEL, near: tuple[str, str] = NEAR_MODEL,
                     keys: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
    """Sensor rows of the production period beside the early and the near model.

    Only rows with both predictions remain.  All three inputs share the same
    keys, so each is shuffled once and both joins reuse that partitioning.
    """
    recent = rows.filter(F.col(MINUTE) >= F.lit(since).cast("timestamp_ntz"))
    return (recent.select(*keys, *SENSOR_COLUMNS)
            .join(select_predictions(alerts, early, "early_warning", keys), list(keys))
            .join(select_predictions(alerts, near, "near_failure", keys), list(keys)))


def add_components(fused: DataFrame) -> DataFrame:
    return fused.withColumns({
        "early_component": threshold_component("early_warning_score",
                                               "early_warning_threshold"),
        "near_component": threshold_component("near_failure_score", "near_failure_threshold"),
        "anomaly_component": F.col("anomaly_percentile") / 100.0,
    })


def add_priority(df: DataFrame, early: float = PRIORITY_WEIGHTS[0],
                 near: float = PRIORITY_WEIGHTS[1],
                 anomaly: float = PRIORITY_WEIGHTS[2]) -> DataFrame:
    """Weighted composite on a 0-100 scale, one decimal, half-even."""
    score = (F.lit(early) * F.col("early_component") + F.lit(near) * F.col("near_component")
             + F.lit(anomaly) * F.col("anomaly_component")) * 100
    return df.withColumn("maintenance_priority_score", F.bround(clip(score, 0.0, 100.0), 1))


def add_risk_level(df: DataFrame, percentile: float = RISK_PERCENTILE,
                   score: float = MEDIUM_SCORE) -> DataFrame:
    """The first rule that holds decides."""
    abnormal = F.col("anomaly_percentile") >= percentile
    early = F.col("early_warning_alert") == 1
    return df.withColumn("risk_level", (
        F.when(F.col("near_failure_alert") == 1, "Critical")
        .when(early & abnormal, "Critical")
        .when(early, "High")
        .when(abnormal | (F.col("maintenance_priority_score") >= score), "Medium")
        .otherwise("Low")))


def add_action(df: DataFrame) -> DataFrame:
    return df.withColumn("recommended_action", lookup("risk_level", RISK_ACTIONS))


def add_primary_signal(df: DataFrame) -> DataFrame:
    """The largest absolute deviation, in raw units; ties go to the first listed."""
    c = F.col
    sizes = (c("motor_current_mean") - c("motor_current_avg_6h"), c("flow_deviation_6h"),
             c("oil_temp_long_trend"), c("tp3_mean") - c("tp3_avg_6h"),
             c("reservoirs_mean") - c("reservoir_avg_6h"))
    return df.withColumn("primary_warning_signal", first_largest(
        [(label, F.abs(size)) for label, size in zip(SIGNAL_LABELS, sizes)]))


def decide(fused: DataFrame) -> DataFrame:
    """All decision columns on top of the fused rows."""
    return add_primary_signal(add_action(add_risk_level(add_priority(add_components(fused)))))


def risk_distribution(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("risk_level").agg(F.count("*").alias("rows"))


def first_useful_warning(decisions: DataFrame, failures: DataFrame, hours: float = 24,
                         keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Earliest High or Critical row in the window before each failure, with its lead."""
    alerts = decisions.filter(F.col("risk_level").isin(*ALERT_LEVELS)).select(*keys, MINUTE)
    ids = [*keys, "event_id", "start_time"]
    matched = match_intervals(alerts, lookback_windows(failures.select(*ids), hours),
                              "window_start", "start_time", keys=keys)
    return (matched.groupBy(*ids).agg(F.min(MINUTE).alias("first_warning"))
            .withColumn("lead_hours", hours_between("first_warning", "start_time"))
            .drop("start_time"))


def cost_rollup(episodes: DataFrame, failures: DataFrame,
                scenarios: Sequence[CostScenario] = COST_SCENARIOS) -> DataFrame:
    """Scenario costs of all given failures; inspections are paid per alert episode.

    Downtime and repair fall due once per failure, on every asset that has one.
    """
    table = local_table(
        episodes.sparkSession,
        [(s.name, s.downtime_hours, s.downtime_hours * s.hourly_rate, s.repair_cost,
          s.inspection_cost) for s in scenarios],
        "scenario string, downtime_hours double, downtime_cost double, repair_cost double, "
        "per_episode double")
    return (table.withColumn("_n", episodes.agg(F.count("*")).scalar())
            .withColumn("_f", failures.agg(F.count("*")).scalar())
            .select("scenario", *[(F.col(c) * F.col("_f")).alias(c) for c in (
                        "downtime_hours", "downtime_cost", "repair_cost")],
                    (F.col("per_episode") * F.col("_n")).alias("inspection_cost"))
            .withColumn("total_cost", F.col("downtime_cost") + F.col("repair_cost")
                        + F.col("inspection_cost")))


def savings(costs: DataFrame, reactive: str = COST_SCENARIOS[0].name,
            predictive: str = COST_SCENARIOS[1].name) -> DataFrame:
    def of(name, column):
        return F.max(F.when(F.col("scenario") == name, F.col(column)))

    return costs.agg(
        (of(reactive, "total_cost") - of(predictive, "total_cost")).alias("avoided_cost"),
        (of(reactive, "downtime_hours") - of(predictive, "downtime_hours"))
        .alias("hours_avoided"))
