"""Threshold calibration, ranking metrics and alert metrics per horizon and model.

All operators take the long prediction table and handle every (horizon, model)
in one grouped job.  The number of such pairs is set by the program's lists of
horizons and models, which is what allows their small tables to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeflow.config import ASSET, MINUTE
from gaugeflow.functions.expr import flag, hours_between
from gaugeflow.operators.intervals import match_intervals
from gaugeflow.operators.prefix import exact_quantiles, prefix_sums

PAIR = ("horizon", "model")


def calibrate_threshold(calibration: DataFrame, quantile: float = 0.99,
                        keys: Sequence[str] = PAIR) -> DataFrame:
    """Alert budget: the probability that ``1 - quantile`` of normal rows exceed."""
    normal = calibration.filter(F.col("actual") == 0)
    return (exact_quantiles(normal, keys, "failure_probability", [quantile], few_keys=True)
            .select(*keys, F.col("quantiles")[0].alias("alert_threshold")))


def apply_threshold(predictions: DataFrame, thresholds: DataFrame,
                    keys: Sequence[str] = PAIR) -> DataFrame:
    return (predictions.join(F.broadcast(thresholds), list(keys))
            .withColumn("alert", flag(F.col("failure_probability") >= F.col("alert_threshold"))))


def ranking_metrics(predictions: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Average precision and tie-aware ROC-AUC over the distinct probabilities.

    Average precision steps down the distinct scores and weights each precision
    by the recall gained there; it is not the trapezoid under the curve.
    Without positives the precision is 0 and the ROC-AUC is NULL.
    """
    steps = prefix_sums(predictions, keys, "failure_probability",
                        {"pos": F.sum("actual"), "all": F.count("*")})
    pos, total_pos = F.col("pos"), F.col("total_pos")
    total_neg = F.col("total_all") - total_pos
    pos_at_or_above = total_pos - F.col("cum_pos") + pos
    all_at_or_above = F.col("total_all") - F.col("cum_all") + F.col("all")
    neg = F.col("all") - pos
    neg_below = (F.col("cum_all") - F.col("cum_pos")) - neg
    pairs = total_pos.cast("double") * total_neg
    return (steps.groupBy(*keys).agg(
        F.sum(F.when(total_pos > 0, pos * (pos_at_or_above / all_at_or_above) / total_pos)
              .otherwise(0.0)).alias("pr_auc"),
        F.sum(F.when(pairs > 0, pos * (neg_below + neg / 2.0) / pairs)).alias("roc_auc")))


def pr_auc(predictions: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return ranking_metrics(predictions, keys).select(*keys, "pr_auc")


def roc_auc(predictions: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return ranking_metrics(predictions, keys).select(*keys, "roc_auc")


def classification_metrics(alerts: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and alert rates in percent."""
    alert, actual = F.col("alert"), F.col("actual")
    counts = alerts.groupBy(*keys).agg(
        F.count("*").alias("test_rows"),
        F.sum(actual).alias("test_positive"),
        F.sum(alert).alias("alerts"),
        F.count_if((alert == 1) & (actual == 1)).alias("hits"))
    hits, pos, raised, n = (F.col(c) for c in ("hits", "test_positive", "alerts", "test_rows"))

    def ratio(a, b):
        return a / F.when(b > 0, b)

    return counts.select(
        *keys, "test_rows", "test_positive", "alerts", "hits",
        F.coalesce(ratio(hits, raised), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(hits, pos), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(hits * 2.0, raised + pos), F.lit(0.0)).alias("f1"),
        (ratio(raised, n) * 100).alias("alert_rate_percent"),
        (ratio(raised - hits, n - pos) * 100).alias("false_alert_rate_percent"),
        (ratio(hits, pos) * 100).alias("failure_window_alert_percent"))


def horizon_windows(failures: DataFrame, horizons: dict[str, float],
                    keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Each failure once per horizon with the window that ends at its start."""
    wanted = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(float(hours)).alias("hours"))
                       for h, hours in horizons.items()])
    return (failures.select(*keys, "event_id", "start_time", F.explode(wanted).alias("_h"))
            .select(*keys, "event_id", "start_time", "_h.horizon", "_h.hours")
            .withColumn("window_start",
                        F.col("start_time") - F.make_dt_interval(secs=F.col("hours") * 3600)))


def first_warning(alerts: DataFrame, failures: DataFrame, horizons: dict[str, float],
                  keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Earliest alert in each failure's window and its lead; no row without an alert."""
    raised = alerts.filter(F.col("alert") == 1).select(*keys, MINUTE, "horizon", "model")
    matched = match_intervals(raised, horizon_windows(failures, horizons, keys),
                              "window_start", "start_time", keys=[*keys, "horizon"])
    return (matched.groupBy(*keys, "event_id", "horizon", "model", "start_time")
            .agg(F.min(MINUTE).alias("first_alert"))
            .withColumn("lead_hours", hours_between("first_alert", "start_time"))
            .drop("start_time"))


def train_counts(train: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Training rows and positives per horizon."""
    return (train.agg(F.count("*").alias("train_rows"),
                      *[F.sum(t).alias(h) for h, t in targets.items()])
            .unpivot("train_rows", list(targets), "horizon", "train_positive"))


def model_comparison(alerts: DataFrame, failures: DataFrame, train: DataFrame,
                     targets: dict[str, str], horizons: dict[str, float],
                     keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """One row per horizon and model: every metric of the test split.

    Over a fleet the first warning is the longest lead among its failures.
    """
    leads = (first_warning(alerts, failures, horizons, keys)
             .groupBy(*PAIR).agg(F.max("lead_hours").alias("first_warning_hours")))
    thresholds = alerts.groupBy(*PAIR).agg(F.max("alert_threshold").alias("threshold"))
    wanted = ["horizon", "model", "train_rows", "train_positive", "test_rows", "test_positive",
              "threshold", "pr_auc", "roc_auc", "precision", "recall", "f1",
              "alert_rate_percent", "false_alert_rate_percent", "failure_window_alert_percent",
              "first_warning_hours"]
    return (classification_metrics(alerts)
            .join(ranking_metrics(alerts), list(PAIR))
            .join(thresholds, list(PAIR))
            .join(train_counts(train, targets), ["horizon"])
            .join(leads, list(PAIR), "left")
            .select(*wanted))


def union_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
