"""Names, windows and cut-offs shared by the operators.

Everything here is plain data.  Operators take these as default arguments, so
another fleet can pass its own lists without touching the code.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

ASSET = "asset_id"
READING_TIME = "timestamp"
MINUTE = "minute_timestamp"

# --- fixed values: columns of the raw readings -------------------------------
# CSV header -> column name.
CSV_COLUMNS = {
    "timestamp": "timestamp",
    "TP2": "tp2",
    "TP3": "tp3",
    "H1": "h1",
    "DV_pressure": "dv_pressure",
    "Reservoirs": "reservoirs",
    "Oil_temperature": "oil_temperature",
    "Flowmeter": "flowmeter",
    "Motor_current": "motor_current",
    "COMP": "comp",
    "DV_eletric": "dv_electric",
    "Towers": "towers",
    "MPG": "mpg",
    "LPS": "lps",
    "Pressure_switch": "pressure_switch",
    "Oil_level": "oil_level",
    "Caudal_impulses": "caudal_impulses",
    "gpsLat": "gps_lat",
    "gpsLong": "gps_long",
    "gpsSpeed": "gps_speed",
    "gpsQuality": "gps_quality",
}

ANALOG = ("tp2", "tp3", "h1", "dv_pressure", "reservoirs", "oil_temperature",
          "flowmeter", "motor_current")
DIGITAL = ("comp", "dv_electric", "towers", "mpg", "lps", "pressure_switch",
           "oil_level", "caudal_impulses")

# --- fixed values: sensors of the range report --------------------------------
RANGED = ("tp2", "tp3", "reservoirs", "oil_temperature", "flowmeter", "motor_current")

# --- fixed values: per-minute statistics of each reading column --------------
MINUTE_STATS = {
    "tp2": ("mean", "min", "max", "std"),
    "tp3": ("mean", "min", "max", "std"),
    "h1": ("mean", "std"),
    "dv_pressure": ("mean", "std"),
    "reservoirs": ("mean", "min", "max", "std"),
    "oil_temperature": ("mean", "min", "max", "std"),
    "flowmeter": ("mean", "max", "std"),
    "motor_current": ("mean", "max", "std"),
    **{name: ("active_rate",) for name in DIGITAL},
    "gps_speed": ("mean", "max"),
    "gps_quality": ("mean",),
}

# --- fixed values: rolling frames --------------------------------------------
FRAMES = {"15m": 15 * 60, "1h": 3600, "6h": 6 * 3600}
GRAIN_SECONDS = 60


@dataclass(frozen=True)
class Signal:
    """One rolling signal: its alias, its minute column, frames per statistic."""

    alias: str
    mean: str
    avg: tuple[str, ...]
    std: tuple[str, ...] = ()
    peak: tuple[str, ...] = ()
    peak_source: str = ""
    avg_infix: str = "_avg_"


SIGNALS = (
    Signal("oil_temp", "oil_temperature_mean", ("15m", "1h", "6h"), ("1h", "6h"),
           ("1h",), "oil_temperature_max"),
    Signal("motor_current", "motor_current_mean", ("15m", "1h", "6h"), ("1h", "6h")),
    Signal("tp3", "tp3_mean", ("15m", "1h", "6h"), ("1h", "6h")),
    Signal("reservoir", "reservoirs_mean", ("1h", "6h"), ("1h", "6h")),
    Signal("flow", "flowmeter_mean", ("1h", "6h"), ("1h", "6h")),
    Signal("compressor_activity", "comp_active_rate", ("1h", "6h"), avg_infix="_"),
)

# signals that carry each kind of derived column
TREND_SIGNALS = ("oil_temp", "motor_current", "tp3")
DEVIATION_SIGNALS = ("oil_temp", "reservoir", "flow")
ZSCORE_SIGNALS = ("oil_temp", "motor_current", "tp3", "reservoir", "flow")
RANGE_COLUMNS = {
    "oil_temp_range": "oil_temperature",
    "tp3_range": "tp3",
    "reservoir_range": "reservoirs",
}

# --- fixed values: label horizons --------------------------------------------
HORIZON_HOURS = (6, 12, 24)
RECOVERY_HOURS = 24
TARGETS = {f"{h}h": f"failure_next_{h}h" for h in HORIZON_HOURS}

# --- fixed values: feature lists ---------------------------------------------
ANOMALY_FEATURES = (
    "oil_temp_long_trend", "oil_temp_std_1h", "oil_temp_zscore_6h",
    "motor_current_long_trend", "motor_current_std_1h", "motor_current_zscore_6h",
    "tp3_long_trend", "tp3_std_1h", "tp3_zscore_6h",
    "reservoir_std_1h", "reservoir_zscore_6h",
    "flow_std_1h", "flow_zscore_6h",
    "pressure_balance_gap", "compressor_activity_change",
)

FAILURE_FEATURES = (
    "tp2_mean", "tp2_std", "tp3_mean", "tp3_std", "reservoirs_mean", "reservoirs_std",
    "oil_temperature_mean", "oil_temperature_std", "flowmeter_mean", "flowmeter_std",
    "motor_current_mean", "motor_current_std",
    "comp_active_rate", "lps_active_rate", "pressure_switch_active_rate",
    "oil_level_active_rate",
    "oil_temp_avg_1h", "oil_temp_avg_6h", "oil_temp_std_1h", "oil_temp_std_6h",
    "oil_temp_short_trend", "oil_temp_long_trend", "oil_temp_deviation_6h",
    "oil_temp_zscore_6h",
    "motor_current_avg_1h", "motor_current_avg_6h", "motor_current_std_1h",
    "motor_current_std_6h", "motor_current_short_trend", "motor_current_long_trend",
    "motor_current_zscore_6h",
    "tp3_avg_1h", "tp3_avg_6h", "tp3_std_1h", "tp3_std_6h", "tp3_short_trend",
    "tp3_long_trend", "tp3_zscore_6h",
    "reservoir_avg_1h", "reservoir_avg_6h", "reservoir_std_1h", "reservoir_std_6h",
    "reservoir_deviation_6h", "reservoir_zscore_6h",
    "pressure_balance_gap",
    "flow_avg_1h", "flow_avg_6h", "flow_std_1h", "flow_std_6h", "flow_deviation_6h",
    "flow_zscore_6h",
    "compressor_activity_1h", "compressor_activity_6h", "compressor_activity_change",
    "anomaly_score", "anomaly_percentile", "anomaly_flag",
)

DRIFT_FEATURES = (
    "oil_temperature_mean", "oil_temp_long_trend", "oil_temp_std_1h",
    "motor_current_mean", "motor_current_avg_6h", "motor_current_std_6h",
    "tp3_mean", "tp3_avg_6h", "tp3_std_1h",
    "reservoirs_mean", "reservoir_avg_6h",
    "flowmeter_mean", "flow_deviation_6h",
    "anomaly_score", "anomaly_percentile",
)

# --- fixed values: decision layer --------------------------------------------
EARLY_MODEL = ("24h", "Logistic Regression")
NEAR_MODEL = ("6h", "Random Forest")
RISK_ACTIONS = {
    "Critical": "Inspect immediately and prepare controlled maintenance shutdown",
    "High": "Inspect during the next available maintenance window",
    "Medium": "Increase monitoring and inspect if elevated risk persists",
    "Low": "Continue normal operation and routine monitoring",
}
ALERT_LEVELS = ("High", "Critical")
EPISODE_GAP_MINUTES = 60


@dataclass(frozen=True)
class CostScenario:
    name: str
    downtime_hours: float
    repair_cost: float
    inspection_cost: float
    hourly_rate: float = 2500.0


COST_SCENARIOS = (
    CostScenario("Reactive maintenance", 12.0, 12000.0, 0.0),
    CostScenario("Predictive maintenance", 4.0, 5000.0, 500.0),
)


@dataclass(frozen=True)
class Calendar:
    """Cut dates of a study: healthy baseline, training, calibration, production."""

    baseline_end: datetime
    train_end: datetime
    calibration_end: datetime
    min_coverage: float = 0.80
    focus_event: int = 2


# --- fixed values: columns and labels of the result tables --------------------
SENSOR_COLUMNS = (
    "anomaly_score", "anomaly_percentile", "anomaly_flag", "oil_temperature_mean",
    "oil_temp_long_trend", "motor_current_mean", "motor_current_avg_6h",
    "motor_current_std_6h", "tp3_mean", "tp3_avg_6h", "reservoirs_mean", "reservoir_avg_6h",
    "flowmeter_mean", "flow_deviation_6h", "failure_next_24h",
)
SIGNAL_LABELS = ("Motor current instability", "Airflow deviation", "Oil temperature trend",
                 "TP3 pressure deviation", "Reservoir pressure deviation")
PRIORITY_WEIGHTS = (0.45, 0.35, 0.20)
RISK_PERCENTILE = 95.0
MEDIUM_SCORE = 45.0
MODEL_COLUMNS = ("horizon", "model", "pr_auc", "roc_auc", "precision", "recall", "f1",
                 "false_alert_rate_percent", "failure_window_alert_percent",
                 "first_warning_hours")
DRIFT_COLUMNS = ("feature", "baseline_mean", "production_mean", "psi", "drift_level",
                 "ks_statistic")
DRIFT_STATUS = ("Retraining review recommended", "Investigate feature drift", "Monitor closely",
                "Stable")


# --- fixed values: the published study's calendar ----------------------------
STUDY_2022 = Calendar(
    baseline_end=datetime(2022, 6, 3),
    train_end=datetime(2022, 6, 15),
    calibration_end=datetime(2022, 7, 1),
)
