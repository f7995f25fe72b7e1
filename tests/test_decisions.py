from conftest import at
from gaugeflow.functions.expr import first_largest, threshold_component
from gaugeflow.operators import decisions, episodes, validation, views
from gaugeflow.session import local_table
from gaugeflow.sources.failures import failure_table
from pyspark.sql import functions as F


def test_threshold_component(spark):
    rows = [(0.3, 0.6, 0.25), (0.6, 0.6, 0.5), (1.2, 0.6, 1.0), (1.3, 0.6, 1.0), (0.4, 0.0, 0.4),
            (1.4, -1.0, 1.0)]
    df = local_table(spark, rows, "s double, t double, wanted double")
    assert all(r["c"] == r["wanted"] for r in
               df.withColumn("c", threshold_component("s", "t")).collect())


def test_risk_cascade(spark):
    rows = [(1, 0, 0.0, 0.0, "Critical"), (0, 1, 95.0, 0.0, "Critical"), (0, 1, 94.9, 99.0, "High"),
            (0, 0, 95.0, 0.0, "Medium"), (0, 0, 0.0, 45.0, "Medium"), (0, 0, 94.9, 44.9, "Low")]
    df = local_table(spark, rows, "near_failure_alert int, early_warning_alert int, "
                                  "anomaly_percentile double, maintenance_priority_score double, "
                                  "wanted string")
    out = decisions.add_action(decisions.add_risk_level(df)).collect()
    assert all(r["risk_level"] == r["wanted"] for r in out)
    assert out[0]["recommended_action"].startswith("Inspect immediately")


def test_largest_signal_ties_and_nulls(spark):
    rows = [(1.0, 2.0, 2.0, "b"), (0.0, 0.0, 0.0, "a"), (None, 0.5, 0.4, "b"),
            (None, None, None, None)]
    df = local_table(spark, rows, "a double, b double, c double, wanted string")
    out = df.withColumn("s", first_largest([(n, F.col(n)) for n in "abc"])).collect()
    assert all(r["s"] == r["wanted"] for r in out)


def alerts(spark, *minutes, asset=0):
    return local_table(spark, [(asset, at(m), float(i), 0.1, 0.2, 50.0)
                               for i, m in enumerate(minutes)],
                       "asset_id int, minute_timestamp timestamp_ntz, "
                       "maintenance_priority_score double, early_warning_score double, "
                       "near_failure_score double, anomaly_percentile double")


def test_episode_gap_and_midnight(spark):
    second = 1 / 60
    minutes = [10, 70, 130 + second, 1400, 1439, 1441, 1501, 2880, 2940, 3000 + second]
    out = (episodes.alert_episodes(alerts(spark, *minutes)).orderBy("alert_episode_id").collect())
    assert [(r["alert_episode_id"], r["episode_start"], r["episode_end"], r["observations"])
            for r in out] == [
        (1, at(10), at(70), 2), (2, at(130 + second), at(130 + second), 1),
        (3, at(1400), at(1501), 4), (4, at(2880), at(2940), 2),
        (5, at(3000 + second), at(3000 + second), 1)]
    assert out[2]["max_priority_score"] == 6.0


def test_no_alerts_no_episodes(spark):
    none = alerts(spark, 1).filter("asset_id = 9")
    assert episodes.alert_episodes(none).count() == 0
    costs = {r["scenario"]: r["total_cost"] for r in
             decisions.cost_rollup(episodes.alert_episodes(none), spark.range(1)).collect()}
    assert costs == {"Reactive maintenance": 42000.0, "Predictive maintenance": 15000.0}


def test_cost_of_the_published_study(spark):
    fourteen = spark.range(14)
    costs = decisions.cost_rollup(fourteen, spark.range(1))
    assert {r["scenario"]: r["total_cost"] for r in costs.collect()} == {
        "Reactive maintenance": 42000.0, "Predictive maintenance": 22000.0}
    saved = decisions.savings(costs).first()
    assert (saved["avoided_cost"], saved["hours_avoided"]) == (20000.0, 8.0)
    fleet = decisions.savings(decisions.cost_rollup(fourteen, spark.range(3))).first()
    assert (fleet["avoided_cost"], fleet["hours_avoided"]) == (74000.0, 24.0)


def test_episode_overlaps_failure_window(spark):
    spans = [(0, at(0), at(1440)), (0, at(1500), at(2000)), (0, at(2880), at(2890)),
             (0, at(2879), at(2950)), (0, at(5000), at(5001))]
    df = local_table(spark, [(a, i, s, e) for i, (a, s, e) in enumerate(spans)],
                     "asset_id int, alert_episode_id bigint, episode_start timestamp_ntz, "
                     "episode_end timestamp_ntz")
    failures = failure_table(spark, [(0, 2, "k", "p", at(2880), at(3000))])
    for limit in (100, 0):
        out = episodes.flag_failure_related(df, failures, broadcast_rows=limit)
        assert [r["failure_related"] for r in out.orderBy("alert_episode_id").collect()] == [
            1, 1, 0, 1, 0]


def test_window_coverage_gaps(spark):
    start = 3000
    rows = local_table(spark, [(0, at(m)) for m in (start - 1400, start - 300, start - 290,
                                                   start - 100, start)],
                       "asset_id int, minute_timestamp timestamp_ntz")
    failures = failure_table(spark, [(0, 1, "k", "p", at(start), at(start + 9)),
                                     (1, 1, "k", "p", at(start), at(start + 9))])
    out = {(r["asset_id"], r["horizon"]): r for r in validation.window_coverage(
        rows, failures, {"1h": 1.0, "6h": 6.0, "24h": 24.0}).collect()}
    assert out[0, "24h"]["observed_minutes"] == 4
    assert out[0, "24h"]["largest_gap_minutes"] == 1100.0
    assert out[0, "6h"]["largest_gap_minutes"] == 190.0
    assert out[0, "6h"]["earliest_lead_hours"] == 5.0
    assert out[0, "1h"]["observed_minutes"] == 0 and out[0, "1h"]["largest_gap_minutes"] is None
    assert out[1, "24h"]["coverage_percent"] == 0.0


def test_time_views(spark):
    df = local_table(spark, [(0, at(m)) for m in (0, 60, 1500, 1501, 9000)],
                     "asset_id int, minute_timestamp timestamp_ntz")
    failures = failure_table(spark, [(0, 2, "k", "p", at(1500), at(1600))])
    kept = views.time_window(df, failures, "warning").orderBy("minute_timestamp").collect()
    assert [r["minute_timestamp"] for r in kept] == [at(60), at(1500)]
    near = failure_table(spark, [(0, 2, "k", "p", at(1500), at(1600)),
                                 (0, 3, "k", "p", at(2220), at(2300))])  # 12 hours later
    kept = views.time_window(df, near, "warning").orderBy("minute_timestamp").collect()
    assert [r["minute_timestamp"] for r in kept] == [at(60), at(1500), at(1501)]
    assert views.time_window(df, mode="latest").count() == 1
    assert views.latest(df).first()["minute_timestamp"] == at(9000)
