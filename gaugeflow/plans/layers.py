"""The batch pipeline: every layer computed once, written, and read back.

Each layer is a table in the target folder, replaced as a whole by a run.
Reading a layer back cuts the plan, so later layers neither recompute nor hold
earlier ones, and a lost executor only repeats the work of the current layer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.config import (ANOMALY_FEATURES, ASSET, DRIFT_FEATURES, EARLY_MODEL,
                              FAILURE_FEATURES, MINUTE, NEAR_MODEL, RANGED, READING_TIME,
                              STUDY_2022, TARGETS, Calendar)
from gaugeflow.operators import (aggregate, anomaly, attribution, decisions, episodes, intervals,
                                 labels, metrics, models, monitoring, prep, profile, rolling,
                                 validation)
from gaugeflow.session import use_utc
from gaugeflow.sources import sinks

HORIZONS = {"6h": 6.0, "12h": 12.0, "24h": 24.0}
# beyond this many days of windows a layer is read whole
MANY_DAYS = 10_000


@dataclass(frozen=True)
class Layers:
    """Folder of layer tables."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def put(self, name: str, df: DataFrame, time_col: str | None = None) -> DataFrame:
        sinks.write_parquet(df, self.path(name), time_col)
        return self.get(name)

    def get(self, name: str, since: datetime | None = None,
            until: datetime | None = None) -> DataFrame:
        """A layer; the bounds leave out whole days, so that their folders are not opened.

        Rows of the days in which the bounds fall all come; a time filter does the rest.
        """
        table = self.spark.read.parquet(self.path(name))
        if since is not None:
            table = table.filter(F.col("event_date") >= F.lit(since.date()))
        if until is not None:
            table = table.filter(F.col("event_date") <= F.lit(until.date()))
        return table.drop("event_date")

    def during(self, name: str, windows: DataFrame, low: str, high: str) -> DataFrame:
        """A layer's rows of the days that any of the windows touches; others are not opened.

        Which days these are is known only when the windows have been worked out, so their folders
        are chosen while the job runs (dynamic partition pruning). A window may be of any asset; the
        join with the windows themselves does the rest.
        """
        days = windows.filter(F.col(low) <= F.col(high)).select(F.explode(F.sequence(
            F.to_date(low), F.to_date(high))).alias("event_date")).distinct()
        if days.limit(MANY_DAYS + 1).count() > MANY_DAYS:
            return self.get(name)
        table = self.spark.read.parquet(self.path(name))
        return table.join(F.broadcast(days), "event_date", "left_semi").drop("event_date")

    def report(self, name: str, df: DataFrame, one_file: bool = True) -> DataFrame:
        """A result table: Parquet for later steps and CSV for people.

        ``one_file`` is for tables whose rows are bounded by a list of models or
        features; a table that grows with the fleet keeps one file per task.
        """
        table = self.put(name, df)
        write = sinks.write_report if one_file else sinks.write_csv
        write(table, self.path(f"reports/{name}"))
        return table


def build_profile(layers: Layers, readings: DataFrame, failures: DataFrame) -> None:
    """What the source holds: columns, totals, value ranges, readings per failure."""
    layers.report("profile_columns", profile.schema_profile(readings))
    layers.report("warehouse_summary", profile.warehouse_summary(readings))
    layers.report("sensor_ranges", profile.value_ranges(readings, RANGED))
    layers.report("failure_reading_counts", intervals.count_in_intervals(
        readings, failures, "start_time", "end_time", ["event_id"], time_col=READING_TIME,
        name="readings"), one_file=False)


def build_features(layers: Layers, readings: DataFrame, failures: DataFrame) -> DataFrame:
    """Minute aggregate with labels, then the rolling feature layer."""
    failures = layers.put("failure_events", failures)
    minutes = layers.put("sensor_minute", aggregate.minute_aggregate(readings), MINUTE)
    labelled = layers.put("sensor_failure_features", labels.label_minutes(minutes, failures),
                          MINUTE)
    return layers.put("sensor_rolling_features", rolling.rolling_features(labelled), MINUTE)


def build_anomalies(layers: Layers, calendar: Calendar = STUDY_2022,
                    features: Sequence[str] = ANOMALY_FEATURES, trees: int = anomaly.TREES,
                    sample: int = anomaly.SAMPLE) -> DataFrame:
    """Isolation forest on the healthy baseline, threshold, percentile, join back."""
    table = layers.get("sensor_rolling_features")
    rows = prep.scoring_rows(table, calendar.min_coverage)
    is_healthy = prep.healthy(calendar.baseline_end)
    baseline = prep.scoring_rows(layers.get(
        "sensor_rolling_features", until=calendar.baseline_end),
        calendar.min_coverage).filter(is_healthy)
    medians = prep.fit_medians(baseline, features)
    scaler = prep.fit_scaler(prep.impute(baseline, medians), features)
    ready = prep.standardize(prep.impute(rows, medians), scaler)
    nodes = layers.put("anomaly_nodes", anomaly.fit_isolation_forest(
        ready.filter(is_healthy), features, trees=trees, sample=sample))
    scored = layers.put("anomaly_raw_scores", anomaly.score_isolation_forest(
        ready, nodes, features).select(
        ASSET, MINUTE, "anomaly_score", is_healthy.cast("int").alias("is_healthy")), MINUTE)
    threshold = layers.put("anomaly_threshold", anomaly.score_threshold(
        scored.filter(F.col("is_healthy") == 1)))
    steps = anomaly.percentile_steps(scored.filter(F.col("is_healthy") == 1))
    anomaly.AnomalyModel(tuple(features), medians, scaler, nodes, steps,
                         threshold.first()["alert_threshold"], calendar.baseline_end).save(
        layers.path("anomaly_model"))
    scores = layers.put("anomaly_scores", anomaly.baseline_percentile(
        anomaly.flag_anomalies(scored, threshold), "is_healthy").drop("is_healthy"), MINUTE)
    return layers.put("sensor_anomaly_features", anomaly.attach_scores(table, scores), MINUTE)


def build_predictions(layers: Layers, calendar: Calendar = STUDY_2022,
                      features: Sequence[str] = FAILURE_FEATURES,
                      specs: Sequence[models.ModelSpec] = models.MODEL_SPECS) -> DataFrame | None:
    """Classifiers for every horizon, calibrated alerts and the comparison table.

    Several models are trained at a time, each by jobs of its own; their
    predictions meet in one long table and all metrics come from grouped jobs.
    """
    failures = layers.get("failure_events")
    rows = prep.chrono_split(
        prep.modelling_rows(layers.get("sensor_anomaly_features"), calendar.min_coverage),
        calendar.train_end, calendar.calibration_end)
    fitted, predictions = models.train_and_score(rows, features, TARGETS, specs)
    if predictions is None:
        return None
    predictions = layers.put("all_predictions", predictions.filter(F.col("split") != "train"),
                             MINUTE)
    thresholds = layers.put("alert_thresholds", metrics.calibrate_threshold(
        predictions.filter(F.col("split") == "calibration")))
    alerts = layers.put("failure_predictions", metrics.apply_threshold(
        predictions.filter(F.col("split") == "test").drop("split"), thresholds), MINUTE)
    limits = {(r["horizon"], r["model"]): r["alert_threshold"] for r in thresholds.collect()}
    for f in fitted:
        models.save_model(layers.spark, f, model_path(layers, f.horizon, f.name),
                          limits.get((f.horizon, f.name)), calendar.train_end,
                          calendar.calibration_end)
    layers.report("model_comparison", metrics.model_comparison(
        alerts, failures.filter(F.col("event_id") == calendar.focus_event),
        rows.filter(F.col("split") == "train"), TARGETS, HORIZONS))
    return alerts


def model_path(layers: Layers, horizon: str, name: str) -> str:
    return layers.path(f"models/{horizon}/{name.lower().replace(' ', '-')}")


def build_explanations(layers: Layers, calendar: Calendar = STUDY_2022,
                       explained: Sequence[tuple[tuple[str, str], float]] = (
                           (EARLY_MODEL, 24), (NEAR_MODEL, 1))) -> None:
    """Attributions of the stored models in the hours before each focus failure.

    Per model: its attributions, their importance, the first alert with what drove it,
    and a summary. The test rows are scaled and imputed with the model's own constants.
    """
    focus = layers.get("failure_events").filter(F.col("event_id") == calendar.focus_event)
    test = prep.chrono_split(prep.modelling_rows(
        layers.get("sensor_anomaly_features", since=calendar.calibration_end),
        calendar.min_coverage), calendar.train_end, calendar.calibration_end
    ).filter(F.col("split") == "test")
    for (horizon, name), hours in explained:
        fitted, _ = models.load_model(layers.spark, model_path(layers, horizon, name))
        ready = fitted.prepare(test.select(ASSET, MINUTE, *fitted.features))
        window = attribution.explanation_window(ready, focus, hours)
        if fitted.scaled:
            found = attribution.linear_attribution(
                window, ready, models.coefficients(fitted), (ASSET, MINUTE))
        else:
            leaves = layers.put(f"explanations/{horizon}/leaves", attribution.forest_leaves(
                fitted.model, layers.spark))
            found = attribution.tree_attribution(window, leaves, fitted.features,
                                                 (ASSET, MINUTE), fitted.model.getNumTrees)
        found = layers.put(f"explanations/{horizon}/attributions", found, MINUTE)
        layers.report(f"explanations/{horizon}/importance", attribution.importance(found))
        alerts = layers.get("failure_predictions", since=calendar.calibration_end).filter(
            (F.col("horizon") == horizon) & (F.col("model") == name))
        first = layers.report(
            f"explanations/{horizon}/first_alerts", attribution.first_alert_explanation(
                found, attribution.first_alerts(alerts, focus, hours)), one_file=False)
        layers.report(f"explanations/{horizon}/summary",
                      attribution.explanation_summary(first, name), one_file=False)


def build_validation(layers: Layers, calendar: Calendar = STUDY_2022) -> None:
    """Coverage and gaps before the failures, model behaviour and labels before the focus."""
    failures = layers.get("failure_events")
    focus = failures.filter(F.col("event_id") == calendar.focus_event)

    def before(name: str, events: DataFrame) -> DataFrame:
        return layers.during(name, labels.lookback_windows(events, max(HORIZONS.values())),
                             "window_start", "start_time")

    rows, focus_rows = (prep.modelling_rows(before("sensor_anomaly_features", e),
                                            calendar.min_coverage) for e in (failures, focus))
    alerts = before("failure_predictions", focus)
    for name, table in (
            ("window_coverage", validation.window_coverage(rows, failures, HORIZONS)),
            ("largest_gap", validation.largest_gap(rows, failures, HORIZONS)),
            ("prediction_behaviour", validation.prediction_behaviour(alerts, focus, HORIZONS)),
            ("positive_distribution", validation.positive_distribution(focus_rows, focus))):
        layers.report(f"validation/{name}", table, one_file=False)


def build_decisions(layers: Layers, calendar: Calendar = STUDY_2022) -> DataFrame:
    """Risk levels, alert episodes and the cost roll-up."""
    focus = layers.get("failure_events").filter(F.col("event_id") == calendar.focus_event)
    rows = prep.modelling_rows(
        layers.get("sensor_anomaly_features", since=calendar.calibration_end),
        calendar.min_coverage)
    table = layers.put("maintenance_decisions", decisions.decide(decisions.fuse_predictions(
        rows, layers.get("failure_predictions"), calendar.calibration_end)), MINUTE)
    merged = layers.report("maintenance_alert_episodes", episodes.flag_failure_related(
        episodes.alert_episodes(episodes.alert_rows(table)), focus), one_file=False)
    layers.report("maintenance_cost_simulation", decisions.cost_rollup(merged, focus))
    return table


def build_monitoring(layers: Layers, calendar: Calendar = STUDY_2022,
                     features: Sequence[str] = DRIFT_FEATURES,
                     model: tuple[str, str] = EARLY_MODEL) -> DataFrame:
    """Drift report over the monitored features and the weekly table."""
    start, end = (F.lit(t).cast("timestamp_ntz")
                  for t in (calendar.calibration_end, calendar.baseline_end))
    sides = [prep.modelling_rows(layers.get("sensor_anomaly_features", **days).filter(within),
                                 calendar.min_coverage)
             for days, within in (({"until": calendar.baseline_end}, F.col(MINUTE) < end),
                                  ({"since": calendar.calibration_end}, F.col(MINUTE) >= start))]
    split = monitoring.drift_split(sides[0].unionByName(sides[1]), calendar.baseline_end,
                                   calendar.calibration_end)
    report = layers.report("feature_drift_monitoring", monitoring.drift_report(
        monitoring.drift_values(split, features)))
    horizon, name = model
    predictions = layers.get("failure_predictions", since=calendar.calibration_end).filter(
        (F.col("horizon") == horizon) & (F.col("model") == name))
    layers.report("weekly_model_monitoring", monitoring.weekly_monitoring(
        split.filter(F.col("side") == "production"), predictions))
    return report


def run_all(spark: SparkSession, folder: str, readings: DataFrame, failures: DataFrame,
            calendar: Calendar = STUDY_2022, **training) -> Layers:
    layers = Layers(use_utc(spark), folder)
    build_profile(layers, readings, failures)
    build_features(layers, readings, failures)
    build_anomalies(layers, calendar)
    if build_predictions(layers, calendar, **training) is None:
        return layers
    build_validation(layers, calendar)
    build_explanations(layers, calendar)
    build_decisions(layers, calendar)
    build_monitoring(layers, calendar)
    return layers
