"""Row selection, chronological split, imputation, scaling and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from gaugeflow.config import MINUTE, TARGETS
from gaugeflow.functions.expr import finite
from gaugeflow.operators.prefix import exact_quantiles


def modelling_rows(features: DataFrame, min_coverage: float = 0.80) -> DataFrame:
    """Rows fit for supervised work: eligible, well covered and scored."""
    return features.filter((F.col("eligible_for_model") == 1)
                           & (F.col("coverage_6h") >= min_coverage)
                           & F.col("anomaly_score").isNotNull())


def scoring_rows(features: DataFrame, min_coverage: float = 0.80) -> DataFrame:
    """Rows the anomaly model scores; failure and recovery minutes included."""
    return features.filter(F.col("coverage_6h") >= min_coverage)


def healthy(baseline_end: datetime, time_col: str = MINUTE):
    """Condition of the healthy baseline: early, and away from any failure."""
    return ((F.col(time_col) < F.lit(baseline_end).cast("timestamp_ntz"))
            & (F.col("failure_active") == 0) & (F.col("failure_next_24h") == 0)
            & (F.col("post_failure_24h") == 0))


def chrono_split(df: DataFrame, train_end: datetime, calibration_end: datetime,
                 time_col: str = MINUTE) -> DataFrame:
    t = F.col(time_col)
    return df.withColumn("split", F.when(t < F.lit(train_end).cast("timestamp_ntz"), "train")
                         .when(t < F.lit(calibration_end).cast("timestamp_ntz"), "calibration")
                         .otherwise("test"))


def long_values(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, feature) with missing values removed."""
    return (df.select(*keep, *[finite(c).alias(c) for c in features])
            .unpivot(list(keep), list(features), "feature", "value")
            .filter(F.col("value").isNotNull()))


def fit_medians(train: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each feature over the training rows.

    Like any estimator's fit this runs at once and keeps one number per feature;
    a feature without any value has no median.
    """
    medians = exact_quantiles(long_values(train, features), ["feature"], "value", [0.5],
                              few_keys=True)
    found = {r["feature"]: r["quantiles"][0] for r in medians.collect()}
    return {c: found.get(c) for c in features}


def impute(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    """Missing, NaN and infinite values become the fitted median."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(m).cast("double"))
                           for c, m in medians.items()})


def fit_scaler(train: DataFrame, features: Sequence[str]
               ) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population standard deviation of each feature."""
    row = train.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in features]).first()
    return {c: tuple(row[c]) for c in features}


def standardize(df: DataFrame,
                scaler: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """(x - mean) / std; a constant feature is only centred."""
    return df.withColumns({
        c: (F.col(c) - F.lit(mean).cast("double")) / F.lit(std or 1.0)
        for c, (mean, std) in scaler.items()})


def class_weights(train: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """Class counts and weights per horizon; horizons without positives are left out."""
    names = list(targets)
    counts = train.agg(F.count("*").alias("train_rows"),
                       *[F.coalesce(F.sum(targets[h]), F.lit(0)).alias(h) for h in names])
    n, pos = F.col("train_rows"), F.col("positives")
    neg = n - pos
    return (counts.unpivot("train_rows", names, "horizon", "positives")
            .filter(pos > 0)
            .select("horizon", "train_rows", "positives", neg.alias("negatives"),
                    (neg / pos).alias("scale_pos_weight"),
                    (n / (pos * 2.0)).alias("weight_positive"),
                    (n / F.when(neg > 0, neg * 2.0)).alias("weight_negative")))


def with_class_weight(train: DataFrame, target: str, name: str = "class_weight",
                      positive_only: bool = False) -> DataFrame:
    """Per-row weight: balanced classes, or negatives 1 and positives neg/pos."""
    counts = train.agg(F.struct(F.count("*").alias("n"), F.sum(target).alias("pos")).alias("c"))
    n, pos = F.col("_c.n"), F.col("_c.pos")
    if positive_only:
        weight = F.when(F.col(target) == 1, (n - pos) / pos).otherwise(F.lit(1.0))
    else:
        weight = F.when(F.col(target) == 1, n / (pos * 2.0)).otherwise(n / ((n - pos) * 2.0))
    return train.withColumn("_c", counts.scalar()).withColumn(name, weight).drop("_c")

