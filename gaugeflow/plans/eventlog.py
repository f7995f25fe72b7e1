"""A study over the ``events`` table: its rows read as telemetry of four machines.

Scores come from integer formulas of the minute, so that every operator behind
the models can be compared with SQL to the last digit; the model operators
themselves are exercised separately.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugeflow.config import ASSET, MINUTE, TARGETS, Calendar
from gaugeflow.functions.expr import flag, micros
from gaugeflow.operators import (aggregate, decisions, episodes, labels, metrics, monitoring,
                                 prep, rolling)
from gaugeflow.session import settle, shared_folder, use_utc
from gaugeflow.sources.failures import failure_table
from gaugeflow.sources.sinks import write_parquet
from gaugeflow.sources.telemetry import readings_from_events

ASSETS = 4
CALENDAR = Calendar(baseline_end=datetime(2024, 1, 9), train_end=datetime(2024, 1, 13),
                    calibration_end=datetime(2024, 1, 17), min_coverage=0.04)
MIN_COVERAGE_1H = 0.02
STD_FLOOR = 1e-9
HORIZONS = {"6h": 6.0, "12h": 12.0, "24h": 24.0}
# model -> (multiplier, asset multiplier, modulus) of its score formula
SCORES = {"Logistic Regression": (7919, 13, 1000), "Random Forest": (104729, 17, 997)}
ANOMALY_MODULUS = 10007

# failures of asset 0; each further asset fails six hours later
TEMPLATE = (
    (1, "Air Leak", "Air System", datetime(2024, 1, 10, 10, 19, 24, 300000),
     datetime(2024, 1, 10, 14, 22, 39, 188000)),
    (2, "Oil Leak", "Compressor", datetime(2024, 1, 20, 10, 10, 18, 948000),
     datetime(2024, 1, 23, 10, 22, 8, 46000)),
)


def fleet_failures() -> list[tuple]:
    return [(asset, event, kind, part, start + timedelta(hours=6 * asset),
             end + timedelta(hours=6 * asset))
            for asset in range(ASSETS) for event, kind, part, start, end in TEMPLATE]


def steady(df: DataFrame) -> DataFrame:
    """Fractional columns to six digits, cut off the ties that short decimals fall on."""
    return df.selectExpr(*[
        f"floor(`{f.name}` * 1e6D + 0.501D) / 1e6D AS `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields])


def minute_number() -> Column:
    return F.floor(micros(MINUTE) / F.lit(60_000_000)).cast("long")


class EventLogStudy:
    """Lazily built layers; every property is an unevaluated DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, calendar: Calendar = CALENDAR):
        self.spark, self.sf_dir, self.calendar = use_utc(spark), sf_dir, calendar

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        return readings_from_events(self.table("events"))

    @cached_property
    def failures(self) -> DataFrame:
        return failure_table(self.spark, fleet_failures())

    @cached_property
    def incidents(self) -> DataFrame:
        """Failures the log itself reports: a strong error, for as many minutes as it says."""
        minutes = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        return (self.table("events")
                .filter((F.col("event_type") == "error") & (F.col("value") >= 50))
                .select((F.col("user_id") % 4).cast("int").alias(ASSET),
                        F.col("event_id").cast("int").alias("event_id"),
                        F.lit("Strong Error").alias("failure_type"),
                        F.col("event_type").alias("component"), F.col("ts").alias("start_time"),
                        (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("end_time")))

    @cached_property
    def focus(self) -> DataFrame:
        return self.failures.filter(F.col("event_id") == self.calendar.focus_event)

    @cached_property
    def minutes(self) -> DataFrame:
        return aggregate.minute_aggregate(self.readings)

    @cached_property
    def labelled(self) -> DataFrame:
        return labels.label_minutes(self.minutes, self.failures)

    @cached_property
    def features(self) -> DataFrame:
        return steady(rolling.rolling_features(self.labelled, std_floor=STD_FLOOR))

    @cached_property
    def scored(self) -> DataFrame:
        """Features with anomaly scores; poorly covered rows have none."""
        r = F.pmod(minute_number() * 31 + F.col(ASSET) * 7919, F.lit(ANOMALY_MODULUS))
        covered = F.col("coverage_6h") >= self.calendar.min_coverage
        return (self.features.withColumn("_r", F.when(covered, r))
                .withColumns({
                    "anomaly_score": F.col("_r") / F.lit(float(ANOMALY_MODULUS)),
                    "anomaly_percentile": F.floor(F.col("_r") * 10000 / ANOMALY_MODULUS) / 100.0,
                    "anomaly_flag": F.when(covered, flag(F.col("_r") >= 9000)),
                }).drop("_r"))

    @cached_property
    def scoring(self) -> DataFrame:
        return prep.scoring_rows(self.scored, self.calendar.min_coverage)

    @cached_property
    def healthy(self) -> Column:
        return prep.healthy(self.calendar.baseline_end)

    @cached_property
    def modelling(self) -> DataFrame:
        return prep.modelling_rows(self.scored, self.calendar.min_coverage)

    @cached_property
    def split(self) -> DataFrame:
        return prep.chrono_split(self.modelling, self.calendar.train_end,
                                 self.calendar.calibration_end)

    def on_table(self, columns: Sequence[str], layer: str = "modelling") -> "EventLogStudy":
        """This study with one layer written out, reduced to some columns, and read back.

        For queries that use the layer more than once, as between two scripts of
        a pipeline: later passes read a narrow table instead of recomputing it.
        """
        wanted = list(dict.fromkeys([ASSET, MINUTE, *columns]))
        path = shared_folder(self.spark, layer)
        write_parquet(getattr(self, layer).select(*wanted), path)
        study = EventLogStudy(self.spark, self.sf_dir, self.calendar)
        study.__dict__[layer] = self.spark.read.parquet(path)
        return study

    def with_written(self, *layers: str) -> "EventLogStudy":
        """This study with some layers written whole, one after the other, and read back."""
        study = EventLogStudy(self.spark, self.sf_dir, self.calendar)
        study.__dict__.update({k: v for k, v in self.__dict__.items() if k not in layers})
        for layer in layers:
            path = shared_folder(self.spark, layer)
            write_parquet(getattr(study, layer), path)
            study.__dict__[layer] = self.spark.read.parquet(path)
        return study

    def part(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name)

    @cached_property
    def predictions(self) -> DataFrame:
        """The long prediction table over all splits."""
        n = minute_number()
        variants = F.array(*[
            F.struct(F.lit(h).alias("horizon"), F.lit(model).alias("model"),
                     F.col(TARGETS[h]).alias("actual"),
                     (F.pmod(n * a + F.col(ASSET) * b + F.lit(int(hours)), F.lit(m))
                      / F.lit(float(m))).alias("failure_probability"))
            for h, hours in HORIZONS.items() for model, (a, b, m) in SCORES.items()])
        return self.split.select(ASSET, MINUTE, "split", F.inline(variants))

    @cached_property
    def thresholds(self) -> DataFrame:
        """Fitted once: one row per horizon and model."""
        return settle(metrics.calibrate_threshold(
            self.predictions.filter(F.col("split") == "calibration"), quantile=0.9))

    @cached_property
    def test_predictions(self) -> DataFrame:
        return self.predictions.filter(F.col("split") == "test").drop("split")

    @cached_property
    def alerts(self) -> DataFrame:
        return metrics.apply_threshold(self.test_predictions, self.thresholds)

    @cached_property
    def fused(self) -> DataFrame:
        return decisions.fuse_predictions(self.modelling, self.alerts,
                                          self.calendar.calibration_end)

    @cached_property
    def decisions(self) -> DataFrame:
        return decisions.decide(self.fused)

    @cached_property
    def episodes(self) -> DataFrame:
        return episodes.flag_failure_related(
            episodes.alert_episodes(episodes.alert_rows(self.decisions)), self.focus)

    @cached_property
    def drift(self) -> DataFrame:
        return monitoring.drift_values(monitoring.drift_split(
            self.modelling, self.calendar.baseline_end, self.calendar.calibration_end))
