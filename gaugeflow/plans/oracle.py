"""The catalogue's queries as plain SQL, written against the raw tables.

Common table expressions mirror the layers; ``build`` puts in the ones a query
needs.  Fractional results are cut to six digits as on the Spark side.
"""

from __future__ import annotations

import re

from gaugeflow.config import (ANALOG, ANOMALY_FEATURES, COST_SCENARIOS, DIGITAL,
                              DRIFT_FEATURES, EARLY_MODEL, FAILURE_FEATURES, MINUTE_STATS, NEAR_MODEL,
                              RISK_ACTIONS, SENSOR_COLUMNS, TARGETS, ZSCORE_SIGNALS)
from gaugeflow.operators.rolling import (BY_ALIAS, DEVIATION_SIGNALS, PERIOD_AVERAGES,
                                         RANGE_COLUMNS, TREND_SIGNALS, rolling_spec)
from gaugeflow.plans.catalog import LINEAR_WEIGHTS, RANGED
from gaugeflow.plans.eventlog import CALENDAR, HORIZONS, MIN_COVERAGE_1H, SCORES, fleet_failures

KEYS = "asset_id, minute_timestamp"
READING_COLUMNS = [*ANALOG, *DIGITAL, "gps_speed", "gps_quality"]


def cut(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.501) / 1e6 AS {name}"


def ts(value) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def hours(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 3.6e9"


CTES: dict[str, str] = {}

CTES["telemetry"] = """
SELECT ts AS "timestamp", CAST(user_id % 4 AS INTEGER) AS asset_id,
  value / 10.0::DOUBLE AS tp2, 8.0::DOUBLE + k / 100.0::DOUBLE AS tp3,
  value / 20.0::DOUBLE AS h1, k / 50.0::DOUBLE AS dv_pressure,
  8.0::DOUBLE + (user_id % 100) / 100.0::DOUBLE AS reservoirs, value AS oil_temperature,
  CASE WHEN event_type IN ('view', 'click') THEN value / 100.0::DOUBLE END AS flowmeter,
  k / 10.0::DOUBLE AS motor_current,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS comp,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS dv_electric,
  CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS towers,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS mpg,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS lps,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS pressure_switch,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS oil_level,
  CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS caudal_impulses,
  k * 1.0::DOUBLE AS gps_speed,
  CASE WHEN k > 10 THEN 1 ELSE 0 END AS gps_quality
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events) e
"""

CTES["failures"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({a}, {e}, '{kind}', '{part}', {ts(start)}, {ts(end)})"
    for a, e, kind, part, start, end in fleet_failures()
) + ") AS f(asset_id, event_id, failure_type, component, start_time, end_time)"

CTES["focus"] = f"SELECT * FROM failures WHERE event_id = {CALENDAR.focus_event}"

SQL_STATS = {"mean": "avg", "min": "min", "max": "max", "std": "stddev_pop",
             "active_rate": "avg"}
MINUTE_COLUMNS = [(f"{c}_{stat}", f"{SQL_STATS[stat]}({c})")
                  for c, stats in MINUTE_STATS.items() for stat in stats]
CTES["minutes"] = (
    "SELECT asset_id, date_trunc('minute', \"timestamp\") AS minute_timestamp, "
    "count(*) AS readings, " + ", ".join(f"{e} AS {n}" for n, e in MINUTE_COLUMNS)
    + " FROM telemetry GROUP BY 1, 2")


def exists(condition: str, name: str, table: str = "failures") -> str:
    return (f"CAST(CASE WHEN EXISTS (SELECT 1 FROM {table} f WHERE f.asset_id = m.asset_id "
            f"AND {condition}) THEN 1 ELSE 0 END AS INTEGER) AS {name}")


def label_columns(table: str) -> str:
    t = "m.minute_timestamp"
    parts = [exists(f"{t} BETWEEN f.start_time AND f.end_time", "failure_active", table)]
    for h in HORIZONS:
        parts.append(exists(f"f.start_time > {t} AND f.start_time <= {t} + "
                            f"INTERVAL {h[:-1]} HOUR", TARGETS[h], table))
    parts.append(exists(f"{t} > f.end_time AND {t} <= f.end_time + INTERVAL 24 HOUR",
                        "post_failure_24h", table))
    parts.append(f"(SELECT min(epoch_us(f.start_time) - epoch_us({t})) FROM {table} f "
                 f"WHERE f.asset_id = m.asset_id AND f.start_time > {t}) / 3.6e9 "
                 "AS hours_to_next_failure")
    return ", ".join(parts)


ELIGIBLE = ("CAST(CASE WHEN failure_active = 0 AND post_failure_24h = 0 THEN 1 ELSE 0 END "
            "AS INTEGER) AS eligible_for_model")
CTES["labelled"] = (f"SELECT *, {ELIGIBLE} FROM "
                    f"(SELECT m.*, {label_columns('failures')} FROM minutes m)")

SQL_WINDOW_STATS = {"count": "count", "avg": "avg", "std": "stddev_pop", "max": "max"}
SQL_FRAMES = {"15m": "INTERVAL 15 MINUTE", "1h": "INTERVAL 1 HOUR", "6h": "INTERVAL 6 HOUR"}
CTES["rolling"] = (
    "SELECT *, " + ", ".join(
        f"{SQL_WINDOW_STATS[stat]}({source}) OVER w{frame} AS {out}"
        for out, (stat, source, frame) in rolling_spec().items())
    + " FROM labelled WINDOW " + ", ".join(
        f"w{name} AS (PARTITION BY asset_id ORDER BY minute_timestamp "
        f"RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW)"
        for name, interval in SQL_FRAMES.items()))

TREND = {}
for alias in TREND_SIGNALS:
    TREND[f"{alias}_short_trend"] = f"{alias}_avg_15m - {alias}_avg_1h"
    TREND[f"{alias}_long_trend"] = f"{alias}_avg_1h - {alias}_avg_6h"
TREND["compressor_activity_change"] = "compressor_activity_1h - compressor_activity_6h"
DEVIATION = {f"{a}_deviation_6h": f"{BY_ALIAS[a].mean} - {a}_avg_6h" for a in DEVIATION_SIGNALS}
ZSCORE = {f"{a}_zscore_6h": f"({BY_ALIAS[a].mean} - {a}_avg_6h) "
                            f"/ CASE WHEN {a}_std_6h > 1e-9 THEN {a}_std_6h END"
          for a in ZSCORE_SIGNALS}
INSTABILITY = {"pressure_balance_gap": "abs(tp3_mean - reservoirs_mean)",
               **{n: f"{c}_max - {c}_min" for n, c in RANGE_COLUMNS.items()}}
COVERAGE = {"coverage_1h": "observations_1h / 61.0::DOUBLE",
            "coverage_6h": "observations_6h / 361.0::DOUBLE"}
DERIVED = {**TREND, **DEVIATION, **ZSCORE, **INSTABILITY, **COVERAGE}

LABELS = ["failure_active", *TARGETS.values(), "post_failure_24h"]
WHOLE = ["asset_id", "minute_timestamp", "readings", *LABELS, "eligible_for_model"]
COUNTS = [out for out, (stat, _, _) in rolling_spec().items() if stat == "count"]
FRACTIONS = [n for n, _ in MINUTE_COLUMNS] + [
    out for out, (stat, _, _) in rolling_spec().items() if stat != "count"]
CTES["features"] = ("SELECT " + ", ".join(
    [*WHOLE, *COUNTS, cut("hours_to_next_failure", "hours_to_next_failure"),
     *[cut(c, c) for c in FRACTIONS], *[cut(e, n) for n, e in DERIVED.items()]])
    + " FROM rolling")

CTES["scored"] = f"""
SELECT * EXCLUDE (r), r / 10007.0::DOUBLE AS anomaly_score,
  floor(r * 10000 / 10007.0::DOUBLE) / 100.0::DOUBLE AS anomaly_percentile,
  CAST(CASE WHEN r >= 9000 THEN 1 WHEN r IS NOT NULL THEN 0 END AS INTEGER) AS anomaly_flag
FROM (SELECT *, CASE WHEN coverage_6h >= {CALENDAR.min_coverage} THEN
        (epoch_us(minute_timestamp) // 60000000 * 31 + asset_id * 7919) % 10007 END AS r
      FROM features)
"""
CTES["scoring"] = f"SELECT * FROM scored WHERE coverage_6h >= {CALENDAR.min_coverage}"
HEALTHY = (f"minute_timestamp < {ts(CALENDAR.baseline_end)} AND failure_active = 0 "
           "AND failure_next_24h = 0 AND post_failure_24h = 0")
CTES["baseline"] = f"SELECT * FROM scoring WHERE {HEALTHY}"
CTES["modelling"] = (f"SELECT * FROM scored WHERE eligible_for_model = 1 AND coverage_6h >= "
                     f"{CALENDAR.min_coverage} AND anomaly_score IS NOT NULL")
CTES["split"] = f"""
SELECT *, CASE WHEN minute_timestamp < {ts(CALENDAR.train_end)} THEN 'train'
  WHEN minute_timestamp < {ts(CALENDAR.calibration_end)} THEN 'calibration'
  ELSE 'test' END AS split FROM modelling
"""
CTES["predictions"] = " UNION ALL ".join(
    f"SELECT {KEYS}, split, '{h}' AS horizon, '{model}' AS model, {TARGETS[h]} AS actual, "
    f"((epoch_us(minute_timestamp) // 60000000 * {a} + asset_id * {b} + {int(n)}) % {m}) "
    f"/ {float(m)}::DOUBLE AS failure_probability FROM split"
    for h, n in HORIZONS.items() for model, (a, b, m) in SCORES.items())
CTES["thresholds"] = """
SELECT horizon, model, quantile_cont(failure_probability, 0.9) AS alert_threshold
FROM predictions WHERE split = 'calibration' AND actual = 0 GROUP BY 1, 2
"""
CTES["alerts"] = f"""
SELECT {KEYS}, horizon, model, actual, failure_probability, alert_threshold,
  CAST(CASE WHEN failure_probability >= alert_threshold THEN 1 ELSE 0 END AS INTEGER) AS alert
FROM predictions JOIN thresholds USING (horizon, model) WHERE split = 'test'
"""


def pick(pair, prefix):
    h, model = pair
    return (f"SELECT {KEYS}, failure_probability AS {prefix}_score, "
            f"alert_threshold AS {prefix}_threshold, alert AS {prefix}_alert "
            f"FROM alerts WHERE horizon = '{h}' AND model = '{model}'")


CTES["early"] = pick(EARLY_MODEL, "early_warning")
CTES["near"] = pick(NEAR_MODEL, "near_failure")
CTES["fused"] = (f"SELECT {KEYS}, {', '.join(SENSOR_COLUMNS)}, early.* EXCLUDE ({KEYS}), "
                 f"near.* EXCLUDE ({KEYS}) FROM modelling "
                 f"JOIN early USING ({KEYS}) JOIN near USING ({KEYS}) "
                 f"WHERE minute_timestamp >= {ts(CALENDAR.calibration_end)}")


def component(p):
    s, t = f"{p}_score", f"{p}_threshold"
    return (f"least(greatest(CASE WHEN {t} <= 0 THEN {s} ELSE {s} / {t} / 2.0::DOUBLE END, "
            "0.0::DOUBLE), 1.0::DOUBLE)")


CTES["components"] = (f"SELECT *, {component('early_warning')} AS early_component, "
                      f"{component('near_failure')} AS near_component, "
                      "anomaly_percentile / 100.0::DOUBLE AS anomaly_component FROM fused")
CTES["priority"] = """
SELECT *, round_even(least(greatest((0.45::DOUBLE * early_component
  + 0.35::DOUBLE * near_component + 0.2::DOUBLE * anomaly_component) * 100, 0.0::DOUBLE),
  100.0::DOUBLE), 1) AS maintenance_priority_score FROM components
"""
SIGNALS_SQL = {
    "Motor current instability": "abs(motor_current_mean - motor_current_avg_6h)",
    "Airflow deviation": "abs(flow_deviation_6h)",
    "Oil temperature trend": "abs(oil_temp_long_trend)",
    "TP3 pressure deviation": "abs(tp3_mean - tp3_avg_6h)",
    "Reservoir pressure deviation": "abs(reservoirs_mean - reservoir_avg_6h)",
}
TOP = f"greatest({', '.join(SIGNALS_SQL.values())})"
CTES["decided"] = (
    "SELECT *, " + "CASE risk_level " + " ".join(
        f"WHEN '{level}' THEN '{action}'" for level, action in RISK_ACTIONS.items())
    + " END AS recommended_action, CASE " + " ".join(
        f"WHEN {e} = {TOP} THEN '{n}'" for n, e in SIGNALS_SQL.items())
    + """ END AS primary_warning_signal FROM (SELECT *, CASE
  WHEN near_failure_alert = 1 THEN 'Critical'
  WHEN early_warning_alert = 1 AND anomaly_percentile >= 95 THEN 'Critical'
  WHEN early_warning_alert = 1 THEN 'High'
  WHEN anomaly_percentile >= 95 OR maintenance_priority_score >= 45 THEN 'Medium'
  ELSE 'Low' END AS risk_level FROM priority)""")
CTES["urgent"] = "SELECT * FROM decided WHERE risk_level IN ('High', 'Critical')"
CTES["merged"] = """
SELECT asset_id, alert_episode_id, min(minute_timestamp) AS episode_start,
  max(minute_timestamp) AS episode_end,
  max(maintenance_priority_score) AS max_priority_score,
  max(early_warning_score) AS peak_early_warning_score,
  max(near_failure_score) AS peak_near_failure_score,
  max(anomaly_percentile) AS peak_anomaly_percentile, count(*) AS observations
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY asset_id ORDER BY minute_timestamp)
        AS BIGINT) AS alert_episode_id
      FROM (SELECT *, CASE WHEN lag(minute_timestamp) OVER w IS NULL
              OR minute_timestamp - lag(minute_timestamp) OVER w > INTERVAL 60 MINUTE
              THEN 1 ELSE 0 END AS fresh
            FROM urgent WINDOW w AS (PARTITION BY asset_id ORDER BY minute_timestamp)))
GROUP BY 1, 2
"""
CTES["episodes"] = """
SELECT m.*, CAST(CASE WHEN EXISTS (SELECT 1 FROM focus f WHERE f.asset_id = m.asset_id
  AND m.episode_start < f.start_time AND m.episode_end >= f.start_time - INTERVAL 24 HOUR)
  THEN 1 ELSE 0 END AS INTEGER) AS failure_related FROM merged m
"""
CTES["per_failure"] = " UNION ALL ".join(
    f"SELECT '{s.name}' AS scenario, asset_id, event_id, {s.downtime_hours}::DOUBLE AS hours, "
    f"{s.hourly_rate}::DOUBLE AS rate, {s.repair_cost}::DOUBLE AS repair, "
    f"{s.inspection_cost}::DOUBLE AS inspection FROM focus" for s in COST_SCENARIOS)
CTES["costs"] = """
SELECT scenario, downtime_hours, downtime_cost, repair_cost, inspection_cost,
  downtime_cost + repair_cost + inspection_cost AS total_cost
FROM (SELECT scenario, sum(hours) AS downtime_hours, sum(hours * rate) AS downtime_cost,
        sum(repair) AS repair_cost,
        max(inspection) * (SELECT count(*) FROM episodes) AS inspection_cost
      FROM per_failure GROUP BY 1)"""

# --- monitoring ---------------------------------------------------------------
CTES["sided"] = f"""
SELECT *, CASE WHEN minute_timestamp < {ts(CALENDAR.baseline_end)} THEN 'baseline'
  WHEN minute_timestamp >= {ts(CALENDAR.calibration_end)} THEN 'production' END AS side
FROM modelling WHERE minute_timestamp < {ts(CALENDAR.baseline_end)}
  OR minute_timestamp >= {ts(CALENDAR.calibration_end)}
"""
CTES["drift_values"] = " UNION ALL ".join(
    f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM sided "
    f"WHERE {c} IS NOT NULL" for c in DRIFT_FEATURES)
CTES["moments"] = """
SELECT feature, avg(value) FILTER (side = 'baseline') AS baseline_mean,
  avg(value) FILTER (side = 'production') AS production_mean,
  stddev_samp(value) FILTER (side = 'baseline') AS baseline_std,
  stddev_samp(value) FILTER (side = 'production') AS production_std
FROM drift_values GROUP BY 1
"""
CTES["bounds"] = """
SELECT feature, list_sort(list_distinct(quantile_cont(value,
  [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS b
FROM drift_values WHERE side = 'baseline' GROUP BY 1
"""
CTES["inner_bounds"] = "SELECT feature, unnest(b[2:len(b) - 1]) AS x FROM bounds"
CTES["bins"] = """
SELECT feature, n, bin, count(*) FILTER (side = 'baseline') AS e,
  count(*) FILTER (side = 'production') AS a
FROM (SELECT v.feature, v.side, len(b.b) AS n, (SELECT count(*) FROM inner_bounds i
        WHERE i.feature = v.feature AND i.x < v.value) AS bin
      FROM drift_values v JOIN bounds b USING (feature))
GROUP BY 1, 2, 3
"""
CTES["psi"] = """
SELECT feature, CASE WHEN max(n) < 3 THEN 0.0::DOUBLE ELSE sum((a - e) * ln(a / e)) END AS psi
FROM (SELECT feature, n, greatest(e / sum(e) OVER f, 0.0001::DOUBLE) AS e,
        greatest(a / sum(a) OVER f, 0.0001::DOUBLE) AS a
      FROM bins WINDOW f AS (PARTITION BY feature))
GROUP BY 1
"""
CTES["ks"] = """
SELECT feature, max(nb) AS baseline_rows, max(np) AS production_rows,
  max(abs(cb / nb::DOUBLE - cp / np::DOUBLE)) AS ks_statistic
FROM (SELECT feature, sum(b) OVER w AS cb, sum(p) OVER w AS cp,
        CAST(sum(b) OVER f AS BIGINT) AS nb, CAST(sum(p) OVER f AS BIGINT) AS np
      FROM (SELECT feature, value, count(*) FILTER (side = 'baseline') AS b,
              count(*) FILTER (side = 'production') AS p FROM drift_values GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature))
GROUP BY 1
"""
CTES["ks_scaled"] = """
SELECT *, sqrt(n) * ks_statistic + 1 / (6 * sqrt(n))
  + (sqrt(n) * ks_statistic - 1) / (4 * n) AS x
FROM (SELECT *, round_even(baseline_rows * production_rows
        / CAST(baseline_rows + production_rows AS DOUBLE), 0) AS n FROM ks)
"""
CTES["ks_p"] = """
SELECT feature, max(ks_statistic) AS ks_statistic, CASE WHEN max(ks_statistic) <= 0 THEN 1.0
  ELSE least(greatest(2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END
    * exp(-2.0::DOUBLE * k * k * x * x)), 0.0::DOUBLE), 1.0::DOUBLE) END AS ks_pvalue
FROM ks_scaled, range(1, 101) r(k) GROUP BY 1
"""
CTES["report"] = """
SELECT m.*, psi, CASE WHEN psi IS NULL THEN 'Unknown' WHEN psi < 0.10 THEN 'Stable'
  WHEN psi < 0.25 THEN 'Moderate' ELSE 'High' END AS drift_level, ks_statistic, ks_pvalue
FROM moments m LEFT JOIN psi USING (feature) LEFT JOIN ks_p USING (feature)
"""
CTES["status"] = """
SELECT *, CASE WHEN high_features >= 3 THEN 'Retraining review recommended'
  WHEN high_features >= 1 THEN 'Investigate feature drift'
  WHEN moderate_features >= 3 THEN 'Monitor closely' ELSE 'Stable' END AS monitoring_status
FROM (SELECT count(*) FILTER (drift_level = 'High') AS high_features,
        count(*) FILTER (drift_level = 'Moderate') AS moderate_features,
        count(*) FILTER (drift_level = 'Stable') AS stable_features FROM report)
"""
CTES["weekly"] = f"""
SELECT CAST(date_trunc('week', minute_timestamp) AS TIMESTAMP) AS week_start,
  count(*) AS observations, avg(early_warning_score) AS mean_failure_probability,
  max(early_warning_score) AS max_failure_probability,
  avg(anomaly_score) AS mean_anomaly_score, avg(anomaly_percentile) AS mean_anomaly_percentile,
  CAST(sum(failure_next_24h) AS BIGINT) AS true_risk_minutes,
  avg(early_warning_alert) * 100 AS alert_rate_percent
FROM sided LEFT JOIN early USING ({KEYS}) WHERE side = 'production' GROUP BY 1
"""

# --- metrics ------------------------------------------------------------------
CTES["tested"] = "SELECT * EXCLUDE (split) FROM predictions WHERE split = 'test'"
CTES["steps"] = """
SELECT *, sum(pos) OVER up AS tp, sum(n) OVER up AS k, sum(pos) OVER f AS p,
  sum(n) OVER f - sum(pos) OVER f AS q, sum(n - pos) OVER down - (n - pos) AS neg_below
FROM (SELECT horizon, model, failure_probability AS s, sum(actual) AS pos, count(*) AS n
      FROM tested GROUP BY 1, 2, 3)
WINDOW up AS (PARTITION BY horizon, model ORDER BY s DESC),
  down AS (PARTITION BY horizon, model ORDER BY s), f AS (PARTITION BY horizon, model)
"""
CTES["ranking"] = """
SELECT horizon, model, CASE WHEN max(p) > 0 THEN sum(pos * (tp / k::DOUBLE) / p) ELSE 0 END
  AS pr_auc, CASE WHEN max(p) > 0 AND max(q) > 0
  THEN sum(pos * (neg_below + (n - pos) / 2.0::DOUBLE) / (p::DOUBLE * q)) END AS roc_auc
FROM steps GROUP BY 1, 2
"""
CTES["confusion"] = """
SELECT horizon, model, count(*) AS test_rows, CAST(sum(actual) AS BIGINT) AS test_positive,
  CAST(sum(alert) AS BIGINT) AS alerts, count(*) FILTER (alert = 1 AND actual = 1) AS hits
FROM alerts GROUP BY 1, 2
"""
CTES["scores"] = """
SELECT *, coalesce(hits / nullif(alerts, 0)::DOUBLE, 0) AS precision,
  coalesce(hits / nullif(test_positive, 0)::DOUBLE, 0) AS recall,
  coalesce(2.0::DOUBLE * hits / nullif(alerts + test_positive, 0), 0) AS f1,
  alerts / nullif(test_rows, 0)::DOUBLE * 100 AS alert_rate_percent,
  (alerts - hits) / nullif(test_rows - test_positive, 0)::DOUBLE * 100
    AS false_alert_rate_percent,
  hits / nullif(test_positive, 0)::DOUBLE * 100 AS failure_window_alert_percent
FROM confusion
"""
CTES["horizon_windows"] = " UNION ALL ".join(
    f"SELECT asset_id, event_id, start_time, '{h}' AS horizon, {int(n)} AS hours, "
    f"start_time - INTERVAL {int(n)} HOUR AS window_start FROM failures"
    for h, n in HORIZONS.items())
CTES["in_window"] = f"""
SELECT a.*, w.event_id, w.start_time FROM alerts a JOIN horizon_windows w
  ON a.asset_id = w.asset_id AND a.horizon = w.horizon
  AND a.minute_timestamp >= w.window_start AND a.minute_timestamp < w.start_time
WHERE w.event_id = {CALENDAR.focus_event}
"""
CTES["first_alerts"] = f"""
SELECT asset_id, event_id, horizon, model, min(minute_timestamp) AS first_alert,
  {hours('min(start_time)', 'min(minute_timestamp)')} AS lead_hours
FROM in_window WHERE alert = 1 GROUP BY 1, 2, 3, 4
"""
CTES["train_counts"] = " UNION ALL ".join(
    f"SELECT '{h}' AS horizon, count(*) AS train_rows, CAST(sum({t}) AS BIGINT) "
    f"AS train_positive FROM split WHERE split = 'train'" for h, t in TARGETS.items())
CTES["comparison"] = """
SELECT horizon, model, train_rows, train_positive, test_rows, test_positive,
  alert_threshold AS threshold, pr_auc, roc_auc, precision, recall, f1, alert_rate_percent,
  false_alert_rate_percent, failure_window_alert_percent, first_warning_hours
FROM scores JOIN ranking USING (horizon, model) JOIN thresholds USING (horizon, model)
JOIN train_counts USING (horizon) LEFT JOIN (SELECT horizon, model,
  max(lead_hours) AS first_warning_hours FROM first_alerts GROUP BY 1, 2)
USING (horizon, model)
"""
COMPARISON_FRACTIONS = ["threshold", "pr_auc", "roc_auc", "precision", "recall", "f1",
                        "alert_rate_percent", "false_alert_rate_percent",
                        "failure_window_alert_percent", "first_warning_hours"]

# --- attribution --------------------------------------------------------------


def scaled(source: str, fit: str) -> str:
    """Median imputation and scaling fitted on ``fit``, applied to ``source``."""
    filled = ", ".join(f"coalesce(s.{c}, m.{c}) AS {c}" for c in ANOMALY_FEATURES)
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in ANOMALY_FEATURES)
    stats = ", ".join(f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 THEN 1 "
                      f"ELSE stddev_pop({c}) END AS {c}_s" for c in ANOMALY_FEATURES)
    z = ", ".join(f"({c} - {c}_m) / {c}_s AS {c}" for c in ANOMALY_FEATURES)
    return (f"SELECT {KEYS}, {z} FROM (SELECT s.asset_id, s.minute_timestamp, {filled} "
            f"FROM {source} s, (SELECT {medians} FROM {fit}) m), "
            f"(SELECT {stats} FROM (SELECT {filled} FROM {fit} s, "
            f"(SELECT {medians} FROM {fit}) m))")


CTES["train"] = "SELECT * FROM split WHERE split = 'train'"
CTES["test"] = "SELECT * FROM split WHERE split = 'test'"
CTES["test_scaled"] = scaled("test", "train")
CTES["background"] = ("SELECT " + ", ".join(f"avg({c}) AS {c}" for c in ANOMALY_FEATURES)
                      + " FROM test_scaled")
CTES["explained_rows"] = """
SELECT s.* FROM test_scaled s JOIN focus f ON s.asset_id = f.asset_id
  AND s.minute_timestamp >= f.start_time - INTERVAL 24 HOUR
  AND s.minute_timestamp < f.start_time
"""
CTES["attributions"] = " UNION ALL ".join(
    f"SELECT {KEYS}, '{c}' AS feature, s.{c} AS feature_value, "
    f"{LINEAR_WEIGHTS[c]}::DOUBLE * (s.{c} - b.{c}) AS attribution "
    "FROM explained_rows s, background b" for c in ANOMALY_FEATURES)
CTES["early_first"] = f"""
SELECT asset_id, event_id, max(alert_threshold) AS threshold, min(minute_timestamp) AS alert_timestamp,
  arg_min(failure_probability, minute_timestamp) AS failure_probability,
  {hours('min(start_time)', 'min(minute_timestamp)')} AS hours_before_failure
FROM in_window WHERE alert = 1 AND horizon = '{EARLY_MODEL[0]}' AND model = '{EARLY_MODEL[1]}'
GROUP BY 1, 2
"""
CTES["explanation"] = """
SELECT a.asset_id, event_id, alert_timestamp, feature, feature_value, attribution,
  abs(attribution) AS absolute_impact, failure_probability, threshold, hours_before_failure
FROM attributions a JOIN early_first e
  ON a.asset_id = e.asset_id AND a.minute_timestamp = e.alert_timestamp
"""


def build(select: str) -> str:
    """Prefix the common table expressions that a statement refers to."""
    needed: dict[str, str] = {}

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name, body in CTES.items():
            if (name not in above and name not in needed
                    and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text)):
                visit(body, (*above, name))
                needed[name] = body

    visit(select, ())
    head = ",\n".join(f"{name} AS ({body.strip()})" for name, body in needed.items())
    return f"WITH {head}\n{select}" if needed else select


def fractions(select: str, *names: str) -> str:
    """The statement with the named columns cut to six digits."""
    replaced = ", ".join(cut(n, n) for n in names)
    return build(f"SELECT * REPLACE ({replaced}) FROM ({select})")


ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, *cut_columns: str) -> None:
    ORACLES[name] = fractions(select, *cut_columns) if cut_columns else build(select)


# --- sources, sinks, profiling ------------------------------------------------
DOUBLE_READINGS = [*ANALOG, "gps_speed"]
oracle("scan_csv_rejects", """
SELECT CASE extract(second FROM ts) WHEN 7 THEN 'time' WHEN 11 THEN 'number' ELSE 'good' END
  AS kind, count(*) AS rows
FROM events GROUP BY 1""")
for name in ("telemetry_project", "scan_csv_roundtrip", "sink_parquet_roundtrip"):
    oracle(name, "SELECT * FROM telemetry", *DOUBLE_READINGS)
SEEN = """
SELECT CAST(user_id % 4 AS INTEGER) AS asset_id, CAST(event_id AS INTEGER) AS event_id,
  'Strong Error' AS failure_type, event_type AS component, ts AS start_time,
  ts + to_minutes(CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)) AS end_time
FROM events WHERE event_type = 'error' AND value >= 50"""
oracle("failure_events", SEEN)
oracle("failure_durations", "SELECT *, round((epoch_us(end_time) - epoch_us(start_time)) / 3.6e9, 2)"
       f" AS duration_hours FROM ({SEEN})", "duration_hours")
EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"}
oracle("profile_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{kind}' AS column_type, "
    f"contains('{c}', 'time') OR contains('{c}', 'date') AS time_candidate, "
    f"count(*) AS row_count, count(*) - count({c}) AS null_count FROM events"
    for c, kind in EVENT_TYPES.items()))
oracle("profile_preview", 'SELECT * FROM (SELECT * FROM telemetry ORDER BY "timestamp", asset_id '
       "LIMIT 5)", *DOUBLE_READINGS)
oracle("profile_nulls", " UNION ALL ".join(
    f"SELECT count(*) AS row_count, '{c}' AS column_name, count(*) - count({c}) AS null_count "
    "FROM telemetry" for c in ['"timestamp"', "asset_id", *READING_COLUMNS]).replace(
        "'\"timestamp\"'", "'timestamp'"))
oracle("warehouse_summary", """
SELECT count(*) AS row_count, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp,
  count(DISTINCT CAST("timestamp" AS DATE)) AS observed_days,
  count(*) - count(DISTINCT (asset_id, "timestamp")) AS duplicate_timestamps FROM telemetry""")
oracle("sensor_ranges", "SELECT " + ", ".join(
    f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in RANGED) + " FROM telemetry",
    *[f"{c}_{end}" for c in RANGED for end in ("min", "max")])
oracle("failure_reading_counts", """
SELECT f.*, (SELECT count(*) FROM telemetry t WHERE t.asset_id = f.asset_id
  AND t."timestamp" BETWEEN f.start_time AND f.end_time) AS readings FROM failures f""")

# --- minutes and labels -------------------------------------------------------
oracle("minute_aggregate", "SELECT * FROM minutes", *[n for n, _ in MINUTE_COLUMNS])
oracle("minute_summary", """
SELECT count(*) AS minutes, min(minute_timestamp) AS first_minute,
  max(minute_timestamp) AS last_minute, round(avg(readings), 2) AS average_readings,
  min(readings) AS min_readings, max(readings) AS max_readings FROM minutes""",
       "average_readings")
oracle("label_failure_active", f"SELECT {KEYS}, failure_active FROM labelled")
oracle("label_failure_next", f"SELECT {KEYS}, {', '.join(TARGETS.values())} FROM labelled")
oracle("label_post_failure", f"SELECT {KEYS}, post_failure_24h FROM labelled")
oracle("label_hours_to_next", f"SELECT {KEYS}, hours_to_next_failure FROM labelled",
       "hours_to_next_failure")
oracle("label_eligible", f"SELECT {KEYS}, eligible_for_model FROM labelled")
CTES["incidents"] = """
SELECT asset_id, "timestamp" AS start_time,
  "timestamp" + to_minutes(CAST(gps_speed AS INTEGER)) AS end_time
FROM telemetry WHERE pressure_switch = 1 AND oil_temperature >= 50
"""
oracle("label_dense_incidents", f"SELECT *, {ELIGIBLE} FROM (SELECT {KEYS}, "
       f"{label_columns('incidents')} FROM minutes m)", "hours_to_next_failure")
oracle("label_distribution", "SELECT " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in [*LABELS, "eligible_for_model"])
    + " FROM labelled")
oracle("prefailure_profile", """
SELECT f.asset_id, f.event_id, f.failure_type,
  round(avg(oil_temperature_mean), 2) AS avg_oil_temperature,
  round(max(oil_temperature_max), 2) AS max_oil_temperature,
  round(avg(motor_current_mean), 2) AS avg_motor_current,
  round(avg(tp3_mean), 2) AS avg_tp3_pressure,
  round(avg(reservoirs_mean), 2) AS avg_reservoir_pressure,
  round(avg(flowmeter_mean), 2) AS avg_flowmeter
FROM failures f JOIN minutes m ON m.asset_id = f.asset_id
  AND m.minute_timestamp >= f.start_time - INTERVAL 24 HOUR
  AND m.minute_timestamp < f.start_time
GROUP BY 1, 2, 3""", "avg_oil_temperature", "max_oil_temperature", "avg_motor_current",
       "avg_tp3_pressure", "avg_reservoir_pressure", "avg_flowmeter")

# --- rolling features ---------------------------------------------------------
for name, wanted in (("rolling_count", "count"), ("rolling_avg", "avg"), ("rolling_std", "std"),
                     ("rolling_max", "max")):
    outs = [out for out, (stat, _, _) in rolling_spec().items() if stat == wanted]
    oracle(name, f"SELECT {KEYS}, {', '.join(outs)} FROM rolling",
           *(outs if wanted != "count" else ()))
for name, columns in (("trend_features", TREND), ("deviation_features", DEVIATION),
                      ("zscore_features", ZSCORE), ("instability_features", INSTABILITY),
                      ("coverage_features", COVERAGE)):
    oracle(name, f"SELECT {KEYS}, {', '.join(columns)} FROM features", *columns)
oracle("rolling_summary", f"""
SELECT count(*) AS rows, count(*) FILTER (eligible_for_model = 1) AS eligible_rows,
  round(avg(coverage_1h), 3) AS avg_1h_coverage, round(avg(coverage_6h), 3) AS avg_6h_coverage,
  count(*) FILTER (coverage_6h >= {CALENDAR.min_coverage}) AS high_quality_6h_rows
FROM features""", "avg_1h_coverage", "avg_6h_coverage")
PERIOD = "CASE WHEN failure_next_24h = 1 THEN 'Within 24h of failure' ELSE 'Normal' END AS period"
for name in ("normal_vs_prefailure", "sink_csv_roundtrip"):
    oracle(name, f"SELECT {PERIOD}, count(*) AS rows, " + ", ".join(
        f"round(avg({c}), {d}) AS {n}" for n, (c, d) in PERIOD_AVERAGES.items())
        + " FROM features WHERE eligible_for_model = 1 AND coverage_1h >= "
        f"{MIN_COVERAGE_1H} GROUP BY 1", *PERIOD_AVERAGES)
oracle("zscore_exceedances", "SELECT " + ", ".join(
    f"count(*) FILTER (abs({a}_zscore_6h) >= 2) AS {a}_anomalies" for a in ZSCORE_SIGNALS)
    + " FROM features WHERE eligible_for_model = 1 AND coverage_6h >= "
    f"{CALENDAR.min_coverage}")

# --- anomaly layer ------------------------------------------------------------
ANOMALY_LIST = ", ".join(ANOMALY_FEATURES)
oracle("anomaly_rows", f"SELECT {KEYS}, coverage_6h, failure_active, post_failure_24h "
       "FROM scoring", "coverage_6h")
oracle("healthy_baseline", f"SELECT {KEYS}, {ANOMALY_LIST} FROM baseline", *ANOMALY_FEATURES)
oracle("median_impute", f"SELECT {KEYS}, " + ", ".join(
    f"coalesce(s.{c}, m.{c}) AS {c}" for c in ANOMALY_FEATURES)
    + " FROM scoring s, (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}" for c in ANOMALY_FEATURES) + " FROM baseline) m",
    *ANOMALY_FEATURES)
oracle("standardize", scaled("scoring", "baseline"), *ANOMALY_FEATURES)
THRESHOLD = "SELECT quantile_cont(anomaly_score, 0.99) AS alert_threshold FROM baseline"
oracle("score_threshold", THRESHOLD, "alert_threshold")
oracle("anomaly_flag", f"SELECT {KEYS}, anomaly_score, CAST(CASE WHEN anomaly_score >= "
       f"({THRESHOLD}) THEN 1 ELSE 0 END AS INTEGER) AS anomaly_flag FROM scoring",
       "anomaly_score")
oracle("baseline_percentile", f"""
SELECT {KEYS}, anomaly_score, CAST(CASE WHEN {HEALTHY} THEN 1 ELSE 0 END AS INTEGER)
    AS is_healthy,
  round_even((SELECT count(*) FROM baseline b WHERE b.anomaly_score <= s.anomaly_score)
    / (SELECT count(*) FROM baseline)::DOUBLE * 100, 2) AS anomaly_percentile
FROM scoring s""", "anomaly_score", "anomaly_percentile")
oracle("baseline_alert_rate", "SELECT count(*) AS baseline_rows, avg(anomaly_flag) * 100 "
       "AS baseline_alert_rate FROM baseline", "baseline_alert_rate")
oracle("attach_anomaly_scores", f"SELECT {KEYS}, coverage_6h, anomaly_score, "
       "anomaly_percentile, anomaly_flag FROM scored", "coverage_6h", "anomaly_score",
       "anomaly_percentile")
oracle("anomaly_by_period", f"""
SELECT {PERIOD}, count(*) AS rows, avg(anomaly_score) AS mean_anomaly_score,
  avg(anomaly_flag) * 100 AS anomaly_rate,
  quantile_cont(anomaly_percentile, 0.5) AS median_percentile
FROM scoring WHERE eligible_for_model = 1 GROUP BY 1""",
       "mean_anomaly_score", "anomaly_rate", "median_percentile")
oracle("anomaly_by_horizon", " UNION ALL ".join(
    f"SELECT '{t}' AS horizon, count(*) AS rows, avg(anomaly_flag) * 100 AS alert_rate, "
    "quantile_cont(anomaly_percentile, 0.5) AS median_percentile FROM scoring "
    f"WHERE eligible_for_model = 1 AND {t} = 1 HAVING count(*) > 0" for t in TARGETS.values()),
    "alert_rate", "median_percentile")
oracle("anomaly_by_event", """
SELECT f.asset_id, f.event_id, f.failure_type, count(*) AS rows,
  avg(anomaly_flag) * 100 AS alert_rate, max(anomaly_percentile) AS max_percentile,
  quantile_cont(anomaly_percentile, 0.5) AS median_percentile
FROM failures f JOIN scoring s ON s.asset_id = f.asset_id
  AND s.minute_timestamp >= f.start_time - INTERVAL 24 HOUR
  AND s.minute_timestamp < f.start_time
GROUP BY 1, 2, 3""", "alert_rate", "max_percentile", "median_percentile")

oracle("isolation_forest_checks", """
SELECT 400::BIGINT AS trees, CAST(least(256, (SELECT count(*) FROM baseline)) AS INTEGER) AS least_sample,
  CAST(least(256, (SELECT count(*) FROM baseline)) AS INTEGER) AS most_sample, count(*) AS rows,
  TRUE AS in_range
FROM scoring""")

# --- supervised layer ---------------------------------------------------------
oracle("modelling_rows", f"SELECT {KEYS}, coverage_6h, anomaly_score, "
       f"{', '.join(TARGETS.values())} FROM modelling", "coverage_6h", "anomaly_score")
oracle("chrono_split", f"SELECT {KEYS}, split FROM split")
oracle("class_weights", """
SELECT horizon, train_rows, train_positive AS positives, train_rows - train_positive AS negatives,
  (train_rows - train_positive) / train_positive::DOUBLE AS scale_pos_weight,
  train_rows / (2.0::DOUBLE * train_positive) AS weight_positive,
  train_rows / (2.0::DOUBLE * (train_rows - train_positive)) AS weight_negative
FROM train_counts WHERE train_positive > 0""",
       "scale_pos_weight", "weight_positive", "weight_negative")
oracle("prediction_union", "SELECT * FROM tested", "failure_probability")
oracle("calibrate_threshold", "SELECT * FROM thresholds", "alert_threshold")
oracle("apply_threshold", "SELECT * FROM alerts", "failure_probability", "alert_threshold")
oracle("pr_auc", "SELECT horizon, model, pr_auc FROM ranking", "pr_auc")
oracle("roc_auc", "SELECT horizon, model, roc_auc FROM ranking", "roc_auc")
oracle("classification_metrics", "SELECT horizon, model, test_rows, test_positive, alerts, hits, "
       "precision, recall, f1 FROM scores", "precision", "recall", "f1")
oracle("alert_rates", "SELECT horizon, model, alert_rate_percent, false_alert_rate_percent, "
       "failure_window_alert_percent FROM scores", "alert_rate_percent",
       "false_alert_rate_percent", "failure_window_alert_percent")
oracle("first_warning", "SELECT * FROM first_alerts", "lead_hours")
oracle("model_comparison", "SELECT * FROM comparison", *COMPARISON_FRACTIONS)

oracle("model_checks", f"""
SELECT t.horizon, m.model, test_rows, test_positive, TRUE AS in_range, TRUE AS at_budget, m.trees,
  TRUE AS shape, TRUE AS loss_falls
FROM ({" UNION ALL ".join(
    f"SELECT '{h}' AS horizon, count(*) AS test_rows, CAST(sum({t}) AS BIGINT) AS test_positive FROM test"
    for h, t in TARGETS.items())}) t
JOIN train_counts c ON c.horizon = t.horizon AND c.train_positive > 0,
  (VALUES ('Logistic Regression', NULL::INTEGER), ('Random Forest', 500),
    ('Gradient Boosting (depth-wise)', 500), ('Gradient Boosting (leaf-wise)', 500)) m(model, trees)""")
oracle("tree_attribution_checks", f"""
SELECT DISTINCT t.asset_id, t.minute_timestamp, {len(FAILURE_FEATURES)}::BIGINT AS features,
  TRUE AS adds_up
FROM test t JOIN focus f ON t.asset_id = f.asset_id
  AND t.minute_timestamp >= f.start_time - INTERVAL 1 HOUR AND t.minute_timestamp < f.start_time""")

# --- validation ---------------------------------------------------------------
COVERAGE_SQL = f"""
SELECT asset_id, event_id, horizon, CAST(max(hours) * 60 AS BIGINT) AS expected_minutes,
  count(minute_timestamp) AS observed_minutes,
  count(minute_timestamp) / (max(hours) * 60.0::DOUBLE) * 100 AS coverage_percent,
  min(minute_timestamp) AS first_observed, max(minute_timestamp) AS last_observed,
  {hours('max(start_time)', 'min(minute_timestamp)')} AS earliest_lead_hours,
  CASE WHEN count(minute_timestamp) > 0 THEN coalesce(max(gap), 0.0::DOUBLE) END
    AS largest_gap_minutes
FROM (SELECT w.*, m.minute_timestamp, (epoch_us(m.minute_timestamp) - epoch_us(
        lag(m.minute_timestamp) OVER (PARTITION BY w.asset_id, w.event_id, w.horizon
        ORDER BY m.minute_timestamp))) / 6e7 AS gap
      FROM horizon_windows w LEFT JOIN modelling m ON m.asset_id = w.asset_id
        AND m.minute_timestamp >= w.window_start AND m.minute_timestamp < w.start_time)
GROUP BY 1, 2, 3"""
oracle("window_coverage", COVERAGE_SQL, "coverage_percent", "earliest_lead_hours",
       "largest_gap_minutes")
oracle("largest_gap", f"SELECT asset_id, event_id, horizon, largest_gap_minutes "
       f"FROM ({COVERAGE_SQL})", "largest_gap_minutes")
oracle("prediction_behaviour", f"""
SELECT asset_id, event_id, horizon, model, count(*) AS observations,
  CAST(sum(alert) AS BIGINT) AS alerts, avg(alert) * 100 AS alert_rate_percent,
  avg(failure_probability) AS mean_probability, max(failure_probability) AS max_probability,
  max(alert_threshold) AS threshold,
  {hours('max(start_time)', 'min(minute_timestamp) FILTER (alert = 1)')} AS first_warning_hours,
  quantile_cont(failure_probability, 0.5) AS median_probability
FROM in_window GROUP BY 1, 2, 3, 4""", "alert_rate_percent", "mean_probability",
       "max_probability", "threshold", "first_warning_hours", "median_probability")
oracle("positive_distribution", " UNION ALL ".join(f"""
SELECT f.asset_id, f.event_id, '{t}' AS target, count(*) AS positive_rows,
  min(minute_timestamp) AS earliest_positive, max(minute_timestamp) AS latest_positive,
  {hours('max(start_time)', 'min(minute_timestamp)')} AS earliest_lead_hours,
  {hours('max(start_time)', 'max(minute_timestamp)')} AS latest_lead_hours
FROM focus f JOIN modelling m ON m.asset_id = f.asset_id
  AND m.minute_timestamp >= f.start_time - INTERVAL 24 HOUR
  AND m.minute_timestamp < f.start_time AND {t} = 1
GROUP BY 1, 2""" for t in TARGETS.values()), "earliest_lead_hours", "latest_lead_hours")

# --- attribution --------------------------------------------------------------
oracle("linear_attribution", "SELECT * FROM attributions", "feature_value", "attribution")
IMPORTANCE = "SELECT feature, avg(abs(attribution)) AS mean_abs FROM attributions GROUP BY 1"
oracle("attribution_importance", IMPORTANCE, "mean_abs")
oracle("top_attributions", f"SELECT feature, {cut('mean_abs', 'mean_abs')} FROM ({IMPORTANCE}) "
       "ORDER BY 2 DESC, 1 LIMIT 12", "mean_abs")
oracle("first_alert_explanation", "SELECT * FROM explanation", "feature_value", "attribution",
       "absolute_impact", "failure_probability", "threshold", "hours_before_failure")
DRIVERS = ", ".join(f"max(feature) FILTER (r = {i}) AS top_driver_{i}" for i in (1, 2, 3))
DRIVEN = (" FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, event_id, alert_timestamp "
          f"ORDER BY impact DESC, feature) AS r FROM (SELECT *, {cut('absolute_impact', 'impact')} "
          "FROM explanation)) GROUP BY 1, 2, 3")
oracle("top_drivers", f"SELECT asset_id, event_id, alert_timestamp, {DRIVERS}{DRIVEN}")
oracle("explanation_summary", "SELECT asset_id, event_id, alert_timestamp, "
       f"'{EARLY_MODEL[1]}' AS model, max(hours_before_failure) AS hours_before_failure, "
       "max(failure_probability) AS failure_probability, max(threshold) AS threshold, "
       f"{DRIVERS}{DRIVEN}", "hours_before_failure", "failure_probability", "threshold")

# --- decisions ----------------------------------------------------------------
FUSED_FRACTIONS = [c for c in SENSOR_COLUMNS if c not in ("anomaly_flag", "failure_next_24h")] + [
    f"{p}_{x}" for p in ("early_warning", "near_failure") for x in ("score", "threshold")]
oracle("fuse_predictions", "SELECT * FROM fused", *FUSED_FRACTIONS)
PARTS = ["early_component", "near_component", "anomaly_component"]
oracle("threshold_normalize", f"SELECT {KEYS}, {', '.join(PARTS)} FROM components", *PARTS)
SCORE = "maintenance_priority_score"
oracle("priority_score", f"SELECT {KEYS}, {SCORE} FROM decided", SCORE)
oracle("risk_level", f"SELECT {KEYS}, risk_level FROM decided")
oracle("recommended_action", f"SELECT {KEYS}, risk_level, recommended_action FROM decided")
oracle("primary_signal", f"SELECT {KEYS}, primary_warning_signal FROM decided")
oracle("risk_distribution", "SELECT risk_level, count(*) AS rows FROM decided GROUP BY 1")
PEAK_COLUMNS = ["max_priority_score", "peak_early_warning_score", "peak_near_failure_score",
                "peak_anomaly_percentile"]
oracle("alert_episodes", "SELECT * FROM merged", *PEAK_COLUMNS)
oracle("episode_failure_related", "SELECT asset_id, alert_episode_id, episode_start, "
       "episode_end, failure_related FROM episodes")
EPISODE_COUNTS = """count(*) AS episodes, CAST(coalesce(sum(failure_related), 0) AS BIGINT)
  AS failure_related_episodes, CAST(count(*) - coalesce(sum(failure_related), 0) AS BIGINT)
  AS false_alert_episodes"""
oracle("episode_summary", f"SELECT {EPISODE_COUNTS} FROM episodes")
USEFUL = f"""
SELECT f.asset_id, f.event_id, min(minute_timestamp) AS first_warning,
  {hours('max(start_time)', 'min(minute_timestamp)')} AS lead_hours
FROM focus f JOIN urgent u ON u.asset_id = f.asset_id
  AND u.minute_timestamp >= f.start_time - INTERVAL 24 HOUR
  AND u.minute_timestamp < f.start_time
GROUP BY 1, 2"""
oracle("first_useful_warning", USEFUL, "lead_hours")
COST_COLUMNS = ["downtime_hours", "downtime_cost", "repair_cost", "inspection_cost", "total_cost"]
oracle("cost_rollup", "SELECT * FROM costs", *COST_COLUMNS)

# --- monitoring ---------------------------------------------------------------
oracle("drift_split", f"SELECT {KEYS}, side FROM sided")
MOMENTS = ["baseline_mean", "production_mean", "baseline_std", "production_std"]
oracle("drift_moments", "SELECT * FROM moments", *MOMENTS)
oracle("psi", "SELECT * FROM psi", "psi")
oracle("ks_statistic", "SELECT * FROM ks", "ks_statistic")
oracle("ks_pvalue", "SELECT feature, ks_pvalue FROM ks_p", "ks_pvalue")
oracle("drift_report", "SELECT * FROM report", *MOMENTS, "psi", "ks_statistic", "ks_pvalue")
oracle("monitoring_status", "SELECT * FROM status")
WEEKLY = ["mean_failure_probability", "max_failure_probability", "mean_anomaly_score",
          "mean_anomaly_percentile", "alert_rate_percent"]
oracle("weekly_monitoring", "SELECT * FROM weekly", *WEEKLY)

# --- console views ------------------------------------------------------------
oracle("view_time_window", f"SELECT d.asset_id, d.minute_timestamp, {SCORE}, risk_level "
       "FROM decided d JOIN focus f ON d.asset_id = f.asset_id AND d.minute_timestamp "
       "BETWEEN f.start_time - INTERVAL 24 HOUR AND f.start_time", SCORE)
oracle("view_latest_window", f"SELECT {KEYS}, {SCORE}, risk_level FROM decided "
       "WHERE minute_timestamp >= (SELECT max(minute_timestamp) FROM decided) "
       "- INTERVAL 48 HOUR", SCORE)
LATEST = ["risk_level", SCORE, "anomaly_percentile", "primary_warning_signal",
          "recommended_action"]
oracle("view_latest", f"SELECT {KEYS}, {', '.join(LATEST)} FROM decided QUALIFY row_number() "
       "OVER (PARTITION BY asset_id ORDER BY minute_timestamp DESC) = 1",
       SCORE, "anomaly_percentile")
oracle("view_kpis", f"""
SELECT {EPISODE_COUNTS}, coalesce((SELECT max(lead_hours) FROM ({USEFUL})), 0.0::DOUBLE)
    AS warning_hours,
  (SELECT max(total_cost) FILTER (scenario = '{COST_SCENARIOS[0].name}')
    - max(total_cost) FILTER (scenario = '{COST_SCENARIOS[1].name}') FROM costs)
    AS avoided_cost FROM episodes""", "warning_hours", "avoided_cost")
oracle("view_failure_window", f"""
SELECT d.asset_id, d.minute_timestamp, {SCORE}, risk_level, early_warning_score,
  near_failure_score, anomaly_percentile, event_id
FROM decided d JOIN focus f ON d.asset_id = f.asset_id
  AND d.minute_timestamp >= f.start_time - INTERVAL 24 HOUR
  AND d.minute_timestamp < f.start_time""", SCORE, "early_warning_score",
       "near_failure_score", "anomaly_percentile")
oracle("view_episodes", "SELECT * REPLACE (CASE failure_related WHEN 1 THEN 'Yes' ELSE 'No' END "
       "AS failure_related) FROM episodes", *PEAK_COLUMNS)
MODEL_FRACTIONS = ["pr_auc", "roc_auc", "precision", "recall", "f1", "false_alert_rate_percent",
                   "failure_window_alert_percent", "first_warning_hours"]
oracle("view_models", "SELECT horizon, model, " + ", ".join(
    f"round_even({c}, 3) AS {c}" for c in MODEL_FRACTIONS) + " FROM comparison",
    *MODEL_FRACTIONS)
oracle("view_drift", "SELECT feature, drift_level, " + ", ".join(
    f"round_even({c}, 4) AS {c}" for c in ("baseline_mean", "production_mean", "psi",
                                           "ks_statistic")) + " FROM report",
       "baseline_mean", "production_mean", "psi", "ks_statistic")
oracle("view_weekly", "SELECT week_start, mean_failure_probability, alert_rate_percent / 100 "
       "AS alert_rate FROM weekly", "mean_failure_probability", "alert_rate")
