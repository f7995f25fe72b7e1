from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check_oracle import compare, duck
from gaugeflow.config import CSV_COLUMNS
from gaugeflow.operators import anomaly, labels, models
from gaugeflow.plans.eventlog import CALENDAR, EventLogStudy
from gaugeflow.plans.layers import run_all
from gaugeflow.session import shared_folder
from gaugeflow.sources.telemetry import csv_schema, load_readings

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@needs_data
def test_every_layer_is_written(spark):
    study = EventLogStudy(spark, str(DATA))
    layers = run_all(spark, shared_folder(spark, "study"), study.readings, study.failures, CALENDAR,
                     specs=[models.LOGISTIC.with_params(maxIter=5),
                            models.RANDOM_FOREST.with_params(numTrees=5, maxDepth=4)])
    minutes = layers.get("sensor_minute").count()
    assert layers.get("sensor_anomaly_features").count() == minutes
    assert len(layers.get("sensor_anomaly_features").columns) == 40 + 7 + 50 + 3
    assert layers.get("model_comparison").count() == 6
    test_rows = layers.get("model_comparison").agg(F.max("test_rows")).first()[0]
    assert layers.get("failure_predictions").count() == 6 * test_rows
    assert layers.get("maintenance_decisions").count() == test_rows
    episodes = layers.get("maintenance_alert_episodes")
    cost = {r["scenario"]: r["inspection_cost"]
            for r in layers.get("maintenance_cost_simulation").collect()}
    assert cost["Predictive maintenance"] == 500.0 * episodes.count()
    assert layers.get("feature_drift_monitoring").count() == 15
    weekly = layers.get("weekly_model_monitoring").agg(F.sum("observations")).first()[0]
    assert weekly == test_rows
    baseline = layers.get("anomaly_scores").filter("minute_timestamp < '2024-01-09'")
    assert 0.5 <= baseline.agg(F.avg("anomaly_flag")).first()[0] * 100 <= 1.5
    assert (Path(layers.path("reports/model_comparison")) / "_SUCCESS").exists()
    focus = study.focus.count()
    for horizon, features in (("24h", 57), ("6h", 57)):
        summary = layers.get(f"explanations/{horizon}/summary")
        assert {"model", "hours_before_failure", "failure_probability", "threshold",
                "top_driver_1", "top_driver_3"} <= set(summary.columns)
        assert summary.count() <= focus
        assert layers.get(f"explanations/{horizon}/importance").count() in (0, features)
    assert layers.get("explanations/24h/importance").count() == 57
    assert layers.get("validation/window_coverage").count() == 3 * study.failures.count()
    assert layers.get("warehouse_summary").first()["row_count"] == study.readings.count()
    stored = anomaly.AnomalyModel.load(spark, layers.path("anomaly_model"))
    assert stored.baseline_end == CALENDAR.baseline_end
    again = stored.score(layers.get("sensor_rolling_features").filter("coverage_6h >= 0.04"))
    kept = layers.get("anomaly_scores").select("asset_id", "minute_timestamp", "anomaly_score",
                                               "anomaly_flag", "anomaly_percentile")
    assert again.exceptAll(kept).count() == 0 == kept.exceptAll(again).count()
    plan = layers.get("sensor_anomaly_features", since=CALENDAR.calibration_end
                      )._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    windows = labels.lookback_windows(layers.get("failure_events").filter("event_id = 2"), 24)
    near = layers.during("sensor_anomaly_features", windows, "window_start", "start_time")
    days = {d for r in windows.collect() for d in (r["window_start"].date(), r["start_time"].date())}
    assert {r[0] for r in near.select(F.to_date("minute_timestamp")).distinct().collect()} <= days
    assert near.count() == layers.get("sensor_anomaly_features").filter(
        F.to_date("minute_timestamp").isin(days)).count() > 0
    assert "dynamicpruning" in near._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["warehouse_summary", "label_dense_incidents", "zscore_features",
                                  "baseline_percentile", "model_comparison", "alert_episodes",
                                  "drift_report"])
def test_query_equals_its_sql(spark, name):
    query, sql = entry_points.queries()[name], entry_points.oracle_sql()[name]
    assert compare(query(spark, str(DATA)), duck(str(DATA)), sql) == []


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_csv_header_is_renamed(spark, tmp_path):
    values = {c: str(i) for i, c in enumerate(CSV_COLUMNS)}
    values["timestamp"] = "2022-04-01T00:00:01.5"
    for name, header in (("one", list(CSV_COLUMNS)), ("other", list(reversed(CSV_COLUMNS)))):
        path = tmp_path / f"{name}.csv"
        path.write_text(",".join(header) + "\n" + ",".join(values[c] for c in header) + "\n")
        row = load_readings(spark, str(path)).first()
        assert row["asset_id"] == 0 and row["timestamp"].microsecond == 500000
        assert (row["tp2"], row["dv_electric"], row["gps_quality"]) == (1.0, 10, 20.0)
    assert csv_schema().fieldNames() == list(CSV_COLUMNS)
