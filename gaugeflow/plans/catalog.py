"""Every operator as a named query over the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.config import (ANOMALY_FEATURES, ASSET, DRIFT_FEATURES, EARLY_MODEL,
                              FAILURE_FEATURES, MINUTE, RANGED, READING_TIME, SENSOR_COLUMNS,
                              TARGETS, ZSCORE_SIGNALS)
from gaugeflow.operators import (aggregate, anomaly, attribution, decisions, episodes,
                                 intervals, labels, metrics, models, monitoring, prep,
                                 profile, rolling, trees, validation, views)
from gaugeflow.plans.eventlog import HORIZONS, MIN_COVERAGE_1H, EventLogStudy, steady
from gaugeflow.session import local_table, shared_folder
from gaugeflow.sources import sinks
from gaugeflow.sources.telemetry import fleet_schema, scan_csv, scan_csv_checked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = (ASSET, MINUTE)
# weights of the linear attribution query, by position in the feature list
LINEAR_WEIGHTS = {c: (1.0 if i % 2 == 0 else -1.0) * (i + 1) / 10.0
                  for i, c in enumerate(ANOMALY_FEATURES)}


# columns each family of queries takes from the layer it builds on
TARGET_COLUMNS = tuple(TARGETS.values())
HEALTH_COLUMNS = ("failure_active", "failure_next_24h", "post_failure_24h")
MODEL_ROWS = ("modelling", (*FAILURE_FEATURES, *TARGET_COLUMNS))
LINEAR_ROWS = ("modelling", (*ANOMALY_FEATURES, *TARGET_COLUMNS))
DECISION_ROWS = ("modelling", (*SENSOR_COLUMNS, *TARGET_COLUMNS))
PREDICTION_ROWS = ("modelling", TARGET_COLUMNS)
DRIFT_ROWS = ("modelling", (*DRIFT_FEATURES, "failure_next_24h"))
WEEKLY_ROWS = ("modelling", ("anomaly_score", "anomaly_percentile", *TARGET_COLUMNS))
SENSOR_ROWS = ("scoring", (*ANOMALY_FEATURES, *HEALTH_COLUMNS))
SCORE_ROWS = ("scoring", ("anomaly_score", "anomaly_percentile", "anomaly_flag",
                          "eligible_for_model", *HEALTH_COLUMNS, *TARGET_COLUMNS))


def query(f=None, *, rows: tuple[str, tuple[str, ...]] | None = None):
    """Register a query; ``rows`` names a layer to write out first, and its columns."""
    if f is None:
        return lambda g: query(g, rows=rows)

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        study = EventLogStudy(spark, sf_dir)
        if rows:
            layer, columns = rows
            study = study.on_table(columns, layer)
        return steady(f(study))

    QUERIES[f.__name__] = run
    return f


# --- sources, sinks, profiling ------------------------------------------------

@query
def telemetry_project(s):
    return s.readings


@query
def scan_csv_roundtrip(s):
    path = shared_folder(s.spark, "csv")
    sinks.write_csv(s.readings.select(*fleet_schema().fieldNames()), path)
    return scan_csv(s.spark, path, fleet_schema())


@query
def scan_csv_rejects(s):
    """The readings as CSV with some values that cannot be read: rows that come back, lines that do not."""
    names = fleet_schema().fieldNames()
    second = F.second(READING_TIME)
    damaged = s.readings.withColumns({
        READING_TIME: F.when(second == 7, "yesterday").otherwise(
            F.date_format(READING_TIME, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        "oil_temperature": F.when(second == 11, "n/a").otherwise(
            F.col("oil_temperature").cast("string"))}).select(*names)
    path = shared_folder(s.spark, "csv")
    sinks.write_csv(damaged, path)
    good, bad = scan_csv_checked(s.spark, path, fleet_schema())
    kinds = bad.groupBy(F.when(F.col("line").startswith("yesterday"), "time").otherwise("number")
                        .alias("kind")).agg(F.count("*").alias("rows"))
    return kinds.unionByName(good.groupBy(F.lit("good").alias("kind")).agg(
        F.count("*").alias("rows")))


@query
def sink_parquet_roundtrip(s):
    path = shared_folder(s.spark, "parquet")
    sinks.write_parquet(s.readings, path, READING_TIME)
    return s.spark.read.parquet(path).drop("event_date")


@query
def sink_csv_roundtrip(s):
    path = shared_folder(s.spark, "report")
    report = rolling.normal_vs_prefailure(s.features, MIN_COVERAGE_1H)
    sinks.write_report(report, path)
    return s.spark.read.option("header", True).schema(report.schema).csv(path)


@query
def failure_events(s):
    return s.incidents


@query
def failure_durations(s):
    return labels.failure_durations(s.incidents)


@query
def profile_schema(s):
    return profile.schema_profile(s.table("events"))


@query
def profile_preview(s):
    return profile.preview(s.readings, [READING_TIME, ASSET])


@query
def profile_nulls(s):
    return profile.null_counts(s.readings)


@query
def warehouse_summary(s):
    return profile.warehouse_summary(s.readings)


@query
def sensor_ranges(s):
    return profile.value_ranges(s.readings, RANGED)


@query
def failure_reading_counts(s):
    return intervals.count_in_intervals(s.readings, s.failures, "start_time", "end_time",
                                        ["event_id"], time_col=READING_TIME, name="readings")


# --- minutes and labels -------------------------------------------------------

@query
def minute_aggregate(s):
    return s.minutes


@query
def minute_summary(s):
    return aggregate.minute_summary(s.minutes)


def _labels(s, *names):
    return s.labelled.select(*KEYS, *names)


@query
def label_failure_active(s):
    return _labels(s, "failure_active")


@query
def label_failure_next(s):
    return _labels(s, *TARGETS.values())


@query
def label_post_failure(s):
    return _labels(s, "post_failure_24h")


@query
def label_hours_to_next(s):
    return _labels(s, "hours_to_next_failure")


@query
def label_eligible(s):
    return _labels(s, "eligible_for_model")


@query
def label_dense_incidents(s):
    """Labels against as many intervals as there are strong error readings."""
    strong = s.readings.filter((F.col("pressure_switch") == 1) & (F.col("oil_temperature") >= 50))
    incidents = strong.select(
        ASSET, F.col(READING_TIME).alias("start_time"),
        (F.col(READING_TIME) + F.make_dt_interval(mins=F.col("gps_speed").cast("int")))
        .alias("end_time"))
    return labels.label_minutes(s.minutes.select(*KEYS), incidents, broadcast_rows=0)


@query
def label_distribution(s):
    return labels.label_distribution(s.labelled)


@query
def prefailure_profile(s):
    return labels.prefailure_profile(s.minutes, s.failures)


# --- rolling features ---------------------------------------------------------

def _rolling(s, *stats):
    spec = {k: v for k, v in rolling.rolling_spec().items() if v[0] in stats}
    return rolling.rolling_windows(s.labelled, spec).select(*KEYS, *spec)


@query
def rolling_count(s):
    return _rolling(s, "count")


@query
def rolling_avg(s):
    return _rolling(s, "avg")


@query
def rolling_std(s):
    return _rolling(s, "std")


@query
def rolling_max(s):
    return _rolling(s, "max")


@query
def trend_features(s):
    return s.features.select(*KEYS, *rolling.trend_columns())


@query
def deviation_features(s):
    return s.features.select(*KEYS, *rolling.deviation_columns())


@query
def zscore_features(s):
    return s.features.select(*KEYS, *rolling.zscore_columns())


@query
def instability_features(s):
    return s.features.select(*KEYS, *rolling.instability_columns())


@query
def coverage_features(s):
    return s.features.select(*KEYS, *rolling.coverage_columns())


@query
def rolling_summary(s):
    return rolling.rolling_summary(s.features, s.calendar.min_coverage)


@query
def normal_vs_prefailure(s):
    return rolling.normal_vs_prefailure(s.features, MIN_COVERAGE_1H)


@query
def zscore_exceedances(s):
    return rolling.zscore_exceedances(s.features, min_coverage_6h=s.calendar.min_coverage)


# --- anomaly layer ------------------------------------------------------------

@query
def anomaly_rows(s):
    return s.scoring.select(*KEYS, "coverage_6h", "failure_active", "post_failure_24h")


@query
def healthy_baseline(s):
    return s.scoring.filter(s.healthy).select(*KEYS, *ANOMALY_FEATURES)


@query(rows=SENSOR_ROWS)
def median_impute(s):
    medians = prep.fit_medians(s.scoring.filter(s.healthy), ANOMALY_FEATURES)
    return prep.impute(s.scoring, medians).select(*KEYS, *ANOMALY_FEATURES)


def _standardized(s):
    baseline = s.scoring.filter(s.healthy)
    medians = prep.fit_medians(baseline, ANOMALY_FEATURES)
    scaler = prep.fit_scaler(prep.impute(baseline, medians), ANOMALY_FEATURES)
    return prep.standardize(prep.impute(s.scoring, medians), scaler)


@query(rows=SENSOR_ROWS)
def standardize(s):
    return _standardized(s).select(*KEYS, *ANOMALY_FEATURES)


def _forest(s):
    ready = _standardized(s).select(*KEYS, *ANOMALY_FEATURES, s.healthy.alias("is_healthy"))
    nodes = anomaly.fit_isolation_forest(ready.filter("is_healthy"), ANOMALY_FEATURES)
    return ready, nodes


@query(rows=SENSOR_ROWS)
def isolation_forest_fit(s):
    return _forest(s)[1]


@query(rows=SENSOR_ROWS)
def isolation_forest_score(s):
    ready, nodes = _forest(s)
    return anomaly.score_isolation_forest(ready, nodes, ANOMALY_FEATURES).select(
        *KEYS, "is_healthy", "anomaly_score")


@query(rows=SENSOR_ROWS)
def isolation_forest_checks(s):
    """Trees, the rows each is grown from, rows scored, and whether all scores lie between 0 and 1."""
    ready, nodes = _forest(s)
    roots = nodes.filter("node_id = 0").agg(
        F.count("*").alias("trees"), F.min("size").alias("least_sample"),
        F.max("size").alias("most_sample"))
    scores = anomaly.score_isolation_forest(ready, nodes, ANOMALY_FEATURES).agg(
        F.count("*").alias("rows"),
        F.bool_and((F.col("anomaly_score") > 0) & (F.col("anomaly_score") < 1)).alias("in_range"))
    one = F.lit(0).alias("_one")
    return roots.select("*", one).join(scores.select("*", one), "_one").drop("_one")


@query(rows=SCORE_ROWS)
def score_threshold(s):
    return anomaly.score_threshold(s.scoring.filter(s.healthy))


@query(rows=SCORE_ROWS)
def anomaly_flag(s):
    rows = s.scoring.select(*KEYS, "anomaly_score", s.healthy.alias("is_healthy"))
    threshold = anomaly.score_threshold(rows.filter("is_healthy"))
    return anomaly.flag_anomalies(rows.drop("is_healthy"), threshold)


@query(rows=SCORE_ROWS)
def baseline_percentile(s):
    rows = s.scoring.select(*KEYS, "anomaly_score", s.healthy.cast("int").alias("is_healthy"))
    return anomaly.baseline_percentile(rows, "is_healthy")


@query
def baseline_alert_rate(s):
    return anomaly.baseline_alert_rate(s.scoring, s.healthy)


@query
def attach_anomaly_scores(s):
    scores = s.scoring.select(*KEYS, "anomaly_score", "anomaly_percentile", "anomaly_flag")
    return anomaly.attach_scores(s.features.select(*KEYS, "coverage_6h"), scores)


@query(rows=SCORE_ROWS)
def anomaly_by_period(s):
    return anomaly.anomaly_by_period(s.scoring)


@query(rows=SCORE_ROWS)
def anomaly_by_horizon(s):
    return anomaly.anomaly_by_horizon(s.scoring)


@query(rows=SCORE_ROWS)
def anomaly_by_event(s):
    return anomaly.anomaly_by_event(s.scoring, s.failures)


# --- supervised layer ---------------------------------------------------------

@query
def modelling_rows(s):
    return s.modelling.select(*KEYS, "coverage_6h", "anomaly_score", *TARGETS.values())


@query
def chrono_split(s):
    return s.split.select(*KEYS, "split")


@query
def class_weights(s):
    return prep.class_weights(s.part("train"))


@query(rows=PREDICTION_ROWS)
def prediction_union(s):
    frames = [s.test_predictions.filter(F.col("model") == m)
              for m in ("Logistic Regression", "Random Forest")]
    return metrics.union_predictions(frames)


@query(rows=PREDICTION_ROWS)
def calibrate_threshold(s):
    return s.thresholds


@query(rows=PREDICTION_ROWS)
def apply_threshold(s):
    return s.alerts


@query(rows=PREDICTION_ROWS)
def pr_auc(s):
    return metrics.pr_auc(s.test_predictions)


@query(rows=PREDICTION_ROWS)
def roc_auc(s):
    return metrics.roc_auc(s.test_predictions)


@query(rows=PREDICTION_ROWS)
def classification_metrics(s):
    return metrics.classification_metrics(s.alerts).select(
        "horizon", "model", "test_rows", "test_positive", "alerts", "hits", "precision",
        "recall", "f1")


@query(rows=PREDICTION_ROWS)
def alert_rates(s):
    return metrics.classification_metrics(s.alerts).select(
        "horizon", "model", "alert_rate_percent", "false_alert_rate_percent",
        "failure_window_alert_percent")


@query(rows=PREDICTION_ROWS)
def first_warning(s):
    return metrics.first_warning(s.alerts, s.focus, HORIZONS)


def _comparison(s):
    return metrics.model_comparison(s.alerts, s.focus, s.part("train"), TARGETS, HORIZONS)


@query(rows=PREDICTION_ROWS)
def model_comparison(s):
    return _comparison(s)


# paths of the models that this session has stored, by data folder, kind and horizon
_STORED: dict[tuple, str] = {}


def _stored(s, wanted):
    """Bundles of models by (spec, horizon): fitted and calibrated once a session, then loaded."""
    folder = (s.spark.sparkContext.applicationId, s.sf_dir)
    missing = [(spec, h) for spec, h in wanted if (*folder, spec.name, h) not in _STORED]
    if missing:
        fitted = models.fit_models(s.part("train"), FAILURE_FEATURES,
                                   [(h, TARGETS[h], spec) for spec, h in missing])
        predictions = models.score_models(s.part("calibration"), fitted)
        limits = {(r["horizon"], r["model"]): r["alert_threshold"]
                  for r in metrics.calibrate_threshold(predictions).collect()}
        for f in fitted:
            path = shared_folder(s.spark, "model")
            models.save_model(s.spark, f, path, limits.get((f.horizon, f.name)),
                              s.calendar.train_end, s.calendar.calibration_end)
            _STORED[(*folder, f.name, f.horizon)] = path
    return [models.load_model(s.spark, _STORED[(*folder, spec.name, h)]) for spec, h in wanted]


def _horizons(s):
    """The horizons that have positives to train on."""
    return [r["horizon"] for r in prep.class_weights(s.part("train")).orderBy("horizon").collect()]


def _fit(s, spec, horizon="24h"):
    return _stored(s, [(spec, horizon)])[0][0]


def _fit_and_score(s, spec, horizon="24h"):
    return models.score_model(s.part("test"), _fit(s, spec, horizon))


@query(rows=MODEL_ROWS)
def fit_logistic(s):
    return _fit_and_score(s, models.LOGISTIC)


@query(rows=MODEL_ROWS)
def fit_random_forest(s):
    return _fit_and_score(s, models.RANDOM_FOREST, "6h")


@query(rows=MODEL_ROWS)
def fit_gbt_depthwise(s):
    return _fit_and_score(s, models.GBT_DEPTHWISE)


@query(rows=MODEL_ROWS)
def fit_gbt_leafwise(s):
    return _fit_and_score(s, models.GBT_LEAFWISE)


def _all_stored(s):
    return _stored(s, [(spec, h) for h in _horizons(s) for spec in models.MODEL_SPECS])


def _scored_by_all(s, stored, part):
    limits = local_table(s.spark, [(f.horizon, f.name, limit) for f, limit in stored],
                         "horizon string, model string, alert_threshold double")
    return metrics.apply_threshold(
        models.score_models(s.part(part), [f for f, _ in stored]), limits)


@query(rows=MODEL_ROWS)
def score_models(s):
    """The stored bundles of all classifiers and horizons, applied to the test split."""
    return _scored_by_all(s, _all_stored(s), "test")


@query(rows=MODEL_ROWS)
def model_checks(s):
    """What must hold for every stored model: rows scored, alert budget, shape and falling loss."""
    stored, q = _all_stored(s), 0.99
    p, limit, key = F.col("failure_probability"), F.col("alert_threshold"), ["horizon", "model"]
    tested = _scored_by_all(s, stored, "test").groupBy(*key).agg(
        F.count("*").alias("test_rows"), F.sum("actual").alias("test_positive"),
        F.bool_and(p.between(0, 1)).alias("in_range"))
    place = (F.count("*") - 1) * q
    budget = _scored_by_all(s, stored, "calibration").filter("actual = 0").groupBy(*key).agg(
        ((F.count_if(p < limit) <= F.ceil(place))
         & (F.count_if(p <= limit) > F.floor(place))).alias("at_budget"))
    shapes = []
    for f, _ in stored:
        if not isinstance(f.model, trees.TreeModel):
            shapes.append((f.horizon, f.name, None, True, True))
            continue
        nodes = f.model.nodes
        leaves = nodes[nodes["feature"] < 0].groupby("tree").size()
        # a tree of n leaves has n - 1 splits; every child is a node of its own tree
        right = bool((2 * leaves - 1 == nodes.groupby("tree").size()).all())
        falling = True
        if f.model.boosted:
            most = 31 if f.name == models.GBT_LEAFWISE.name else 2 ** 6
            right &= bool(leaves.max() <= most)
            losses = [r["loss"] for r in models.staged_loss(s.part("train"), f)
                      .orderBy("round").collect()]
            falling = losses[-1] < losses[0] / 4 and all(
                b < a for a, b in zip(losses, losses[1:101]))
        else:
            right &= bool(leaves.max() <= 2 ** 14)
        shapes.append((f.horizon, f.name, f.model.getNumTrees, right, falling))
    shape = local_table(s.spark, shapes, "horizon string, model string, trees int, "
                                         "shape boolean, loss_falls boolean")
    return tested.join(budget, key).join(shape, key)


@query(rows=MODEL_ROWS)
def model_roundtrip(s):
    fitted, threshold = _stored(s, [(models.LOGISTIC, "24h")])[0]
    return models.score_model(s.part("test"), fitted).withColumn(
        "alert_threshold", F.lit(threshold))


# --- validation ---------------------------------------------------------------

@query
def window_coverage(s):
    return validation.window_coverage(s.modelling, s.failures, HORIZONS)


@query
def largest_gap(s):
    return validation.largest_gap(s.modelling, s.failures, HORIZONS)


@query(rows=PREDICTION_ROWS)
def prediction_behaviour(s):
    return validation.prediction_behaviour(s.alerts, s.focus, HORIZONS)


@query
def positive_distribution(s):
    return validation.positive_distribution(s.modelling, s.focus)


# --- attribution --------------------------------------------------------------

def _linear(s):
    test = s.part("test")
    medians = prep.fit_medians(s.part("train"), ANOMALY_FEATURES)
    scaler = prep.fit_scaler(prep.impute(s.part("train"), medians), ANOMALY_FEATURES)
    scaled = prep.standardize(prep.impute(test, medians), scaler)
    window = attribution.explanation_window(
        scaled.select(*KEYS, *ANOMALY_FEATURES), s.focus, 24)
    return attribution.linear_attribution(window, scaled, LINEAR_WEIGHTS, KEYS)


def _early_alerts(s):
    horizon, model = EARLY_MODEL
    early = s.alerts.filter((F.col("horizon") == horizon) & (F.col("model") == model))
    return attribution.first_alerts(early, s.focus, 24)


@query(rows=LINEAR_ROWS)
def linear_attribution(s):
    return _linear(s)


@query(rows=LINEAR_ROWS)
def attribution_importance(s):
    return attribution.importance(_linear(s))


@query(rows=LINEAR_ROWS)
def top_attributions(s):
    return attribution.top_features(steady(attribution.importance(_linear(s))
                                           .withColumnRenamed("mean_abs", "attribution")), 12)


@query(rows=LINEAR_ROWS)
def first_alert_explanation(s):
    return attribution.first_alert_explanation(_linear(s), _early_alerts(s))


@query(rows=LINEAR_ROWS)
def top_drivers(s):
    explained = steady(attribution.first_alert_explanation(_linear(s), _early_alerts(s)))
    return attribution.top_drivers(explained)


@query(rows=LINEAR_ROWS)
def explanation_summary(s):
    explained = steady(attribution.first_alert_explanation(_linear(s), _early_alerts(s)))
    return attribution.explanation_summary(explained, EARLY_MODEL[1])


def _tree_attributions(s):
    fitted = _fit(s, models.RANDOM_FOREST, "6h")
    leaves = attribution.forest_leaves(fitted.model, s.spark)
    test = s.part("test").select(*KEYS, *FAILURE_FEATURES)
    window = attribution.explanation_window(fitted.prepare(test), s.focus, 1)
    return fitted, leaves, window, attribution.tree_attribution(
        window, leaves, FAILURE_FEATURES, KEYS, fitted.model.getNumTrees)


@query(rows=MODEL_ROWS)
def tree_attribution(s):
    return _tree_attributions(s)[-1]


@query(rows=MODEL_ROWS)
def tree_attribution_checks(s):
    """Per explained row: a share for every feature, and with the base they add up to its score."""
    fitted, leaves, window, found = _tree_attributions(s)
    base = attribution.expected_value(leaves, fitted.model.getNumTrees).first()["base_value"]
    sums = found.groupBy(*KEYS).agg(F.count("*").alias("features"),
                                    F.sum("attribution").alias("_sum"))
    chance = models.score_model(window, fitted).select(*KEYS, "failure_probability")
    return sums.join(chance, list(KEYS)).select(*KEYS, "features", (
        F.abs(F.col("_sum") + F.lit(base) - F.col("failure_probability")) < 1e-9).alias("adds_up"))


# --- decisions ----------------------------------------------------------------

@query(rows=DECISION_ROWS)
def fuse_predictions(s):
    return s.fused


@query(rows=DECISION_ROWS)
def threshold_normalize(s):
    return decisions.add_components(s.fused).select(
        *KEYS, "early_component", "near_component", "anomaly_component")


@query(rows=DECISION_ROWS)
def priority_score(s):
    return s.decisions.select(*KEYS, "maintenance_priority_score")


@query(rows=DECISION_ROWS)
def risk_level(s):
    return s.decisions.select(*KEYS, "risk_level")


@query(rows=DECISION_ROWS)
def recommended_action(s):
    return s.decisions.select(*KEYS, "risk_level", "recommended_action")


@query(rows=DECISION_ROWS)
def primary_signal(s):
    return s.decisions.select(*KEYS, "primary_warning_signal")


@query(rows=DECISION_ROWS)
def risk_distribution(s):
    return decisions.risk_distribution(s.decisions)


@query(rows=DECISION_ROWS)
def alert_episodes(s):
    return episodes.alert_episodes(episodes.alert_rows(s.decisions))


@query(rows=DECISION_ROWS)
def episode_failure_related(s):
    return s.episodes.select(ASSET, "alert_episode_id", "episode_start", "episode_end",
                             "failure_related")


@query(rows=DECISION_ROWS)
def episode_summary(s):
    return episodes.episode_summary(s.episodes)


@query(rows=DECISION_ROWS)
def first_useful_warning(s):
    return decisions.first_useful_warning(s.decisions, s.focus)


@query(rows=DECISION_ROWS)
def cost_rollup(s):
    s = s.with_written("episodes")
    return decisions.cost_rollup(s.episodes, s.focus)


# --- monitoring ---------------------------------------------------------------

@query
def drift_split(s):
    split = monitoring.drift_split(s.modelling, s.calendar.baseline_end,
                                   s.calendar.calibration_end)
    return split.select(*KEYS, "side")


@query
def drift_moments(s):
    return monitoring.drift_moments(s.drift)


@query(rows=DRIFT_ROWS)
def psi(s):
    return monitoring.psi(s.drift)


@query(rows=DRIFT_ROWS)
def ks_statistic(s):
    return monitoring.ks_statistic(s.drift)


@query(rows=DRIFT_ROWS)
def ks_pvalue(s):
    return monitoring.ks_pvalue(monitoring.ks_statistic(s.drift)).select("feature", "ks_pvalue")


@query(rows=DRIFT_ROWS)
def drift_report(s):
    return monitoring.drift_report(s.drift)


@query(rows=DRIFT_ROWS)
def monitoring_status(s):
    return monitoring.monitoring_status(monitoring.drift_report(s.drift))


def _weekly(s):
    horizon, model = EARLY_MODEL
    production = monitoring.drift_split(
        s.modelling, s.calendar.baseline_end, s.calendar.calibration_end
    ).filter(F.col("side") == "production")
    return monitoring.weekly_monitoring(production, s.alerts.filter(
        (F.col("horizon") == horizon) & (F.col("model") == model)))


@query(rows=WEEKLY_ROWS)
def weekly_monitoring(s):
    return _weekly(s)


# --- console views ------------------------------------------------------------

@query(rows=DECISION_ROWS)
def view_time_window(s):
    return views.time_window(s.decisions, s.focus, "warning").select(
        *KEYS, "maintenance_priority_score", "risk_level")


@query(rows=DECISION_ROWS)
def view_latest_window(s):
    return views.time_window(s.decisions, mode="latest").select(
        *KEYS, "maintenance_priority_score", "risk_level")


@query(rows=DECISION_ROWS)
def view_latest(s):
    return views.latest(s.decisions).select(
        *KEYS, "risk_level", "maintenance_priority_score", "anomaly_percentile",
        "primary_warning_signal", "recommended_action")


@query(rows=DECISION_ROWS)
def view_kpis(s):
    s = s.with_written("decisions", "episodes")
    return views.kpis(s.decisions, s.episodes, decisions.cost_rollup(s.episodes, s.focus),
                      s.focus)


@query(rows=DECISION_ROWS)
def view_failure_window(s):
    return views.failure_window(s.decisions, s.focus)


@query(rows=DECISION_ROWS)
def view_episodes(s):
    return views.episode_table(s.episodes)


@query(rows=PREDICTION_ROWS)
def view_models(s):
    return views.model_table(_comparison(s))


@query(rows=DRIFT_ROWS)
def view_drift(s):
    return views.drift_table(monitoring.drift_report(s.drift))


@query(rows=WEEKLY_ROWS)
def view_weekly(s):
    return views.weekly_series(_weekly(s))


__all__ = ["QUERIES", "LINEAR_WEIGHTS", "RANGED", "DRIFT_FEATURES", "ZSCORE_SIGNALS"]
