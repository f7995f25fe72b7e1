"""Feature drift and weekly model behaviour."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeflow.config import ASSET, DRIFT_FEATURES, DRIFT_STATUS, MINUTE
from gaugeflow.functions.expr import truncate
from gaugeflow.operators.prefix import exact_quantiles, prefix_sums
from gaugeflow.operators.prep import long_values
from gaugeflow.session import settle, shared_folder

EMPTY_SHARE = 0.0001
KS_TERMS = 100


def drift_split(rows: DataFrame, baseline_end: datetime, production_start: datetime,
                time_col: str = MINUTE) -> DataFrame:
    """Tag rows as baseline or production; what lies between belongs to neither."""
    t = F.col(time_col)
    side = (F.when(t < F.lit(baseline_end).cast("timestamp_ntz"), "baseline")
            .when(t >= F.lit(production_start).cast("timestamp_ntz"), "production"))
    return rows.withColumn("side", side).filter(F.col("side").isNotNull())


def drift_values(split: DataFrame, features: Sequence[str] = DRIFT_FEATURES) -> DataFrame:
    """Long layout (side, feature, value) without missing or infinite values."""
    return long_values(split, features, keep=["side"])


def _side(name: str) -> Column:
    return F.count_if(F.col("side") == name)


def drift_moments(values: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each side."""
    def of(side, f):
        return f(F.when(F.col("side") == side, F.col("value")))

    return values.groupBy("feature").agg(
        of("baseline", F.avg).alias("baseline_mean"),
        of("production", F.avg).alias("production_mean"),
        of("baseline", F.stddev_samp).alias("baseline_std"),
        of("production", F.stddev_samp).alias("production_std"))


def psi(values: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per feature over the baseline's quantile bins.

    Equal boundaries merge; fewer than three leave nothing to compare, which
    counts as 0.  Bins are open on the left and closed on the right, the outer
    ones unbounded.  Empty shares are lifted to a floor; a bin that is empty on
    both sides adds nothing, so it needs no row.  NULL when a side is empty.
    The boundary table has one row per listed feature and is broadcast.
    """
    baseline = values.filter(F.col("side") == "baseline")
    bounds = exact_quantiles(baseline, ["feature"], "value",
                             [i / bins for i in range(bins + 1)], few_keys=True)
    bounds = bounds.withColumn("bounds", F.array_distinct("quantiles"))
    inner = F.expr("slice(bounds, 2, greatest(size(bounds) - 2, 0))")
    v = F.col("value")
    binned = (values.join(F.broadcast(bounds.select(
                  "feature", inner.alias("inner"), F.size("bounds").alias("n_bounds"))),
                  ["feature"], "left")
              .withColumn("bin", F.size(F.filter("inner", lambda b: b < v)))
              .groupBy("feature", "n_bounds", "bin")
              .agg(_side("baseline").alias("expected"), _side("production").alias("actual")))
    whole = W.partitionBy("feature")
    n_expected, n_actual = F.sum("expected").over(whole), F.sum("actual").over(whole)
    shares = binned.select(
        "feature", "n_bounds", n_expected.alias("n_e"), n_actual.alias("n_a"),
        F.greatest(F.col("expected") / F.nullif(n_expected, F.lit(0)),
                   F.lit(EMPTY_SHARE)).alias("e"),
        F.greatest(F.col("actual") / F.nullif(n_actual, F.lit(0)),
                   F.lit(EMPTY_SHARE)).alias("a"))
    term = (F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))
    return shares.groupBy("feature").agg(
        F.when((F.max("n_e") == 0) | (F.max("n_a") == 0), F.lit(None))
        .when(F.max("n_bounds") < 3, F.lit(0.0))
        .otherwise(F.sum(term)).alias("psi"))


def drift_level(value: Column) -> Column:
    return (F.when(value.isNull(), "Unknown").when(value < 0.10, "Stable")
            .when(value < 0.25, "Moderate").otherwise("High"))


def ks_statistic(values: DataFrame) -> DataFrame:
    """Largest distance between the two empirical distributions, per feature."""
    steps = prefix_sums(values, ["feature"], "value",
                        {"b": _side("baseline"), "p": _side("production")})
    distance = F.abs(F.col("cum_b") / F.nullif(F.col("total_b"), F.lit(0))
                     - F.col("cum_p") / F.nullif(F.col("total_p"), F.lit(0)))
    return steps.groupBy("feature").agg(
        F.max("total_b").alias("baseline_rows"), F.max("total_p").alias("production_rows"),
        F.max(distance).alias("ks_statistic"))


def ks_pvalue(statistics: DataFrame, terms: int = KS_TERMS) -> DataFrame:
    """Large-sample two-sided p-value, computed on one row per feature."""
    n1, n2, d = F.col("baseline_rows"), F.col("production_rows"), F.col("ks_statistic")
    n = F.bround(n1 * n2 / F.nullif(n1 + n2, F.lit(0)), 0)
    root = F.sqrt(n)
    scaled = root * d + 1 / (6 * root) + (root * d - 1) / (4 * n)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(-2.0 * k * k * scaled * scaled))
    p = F.when(d.isNull() | (n <= 0), F.lit(None).cast("double")).when(
        d <= 0, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
    return statistics.withColumn("ks_pvalue", p)


def drift_steps(values: DataFrame) -> DataFrame:
    """Both empirical distributions as one table: per feature and distinct value the rows of each
    side (b, p), those up to it (cum_) and the totals (total_)."""
    return prefix_sums(values, ["feature"], "value",
                       {"b": _side("baseline"), "p": _side("production")})


def _first_look(steps: DataFrame, bins: int) -> DataFrame:
    """Per feature: totals, means, KS distance and the baseline's quantile boundaries."""
    v, shares = F.col("value"), [i / bins for i in range(bins + 1)]
    place = [(F.col("total_b") - 1) * p for p in shares]
    at = [F.min(F.when(F.col("cum_b") > rank, v)).alias(f"_{side}{i}")
          for i, x in enumerate(place) for side, rank in (("lo", F.floor(x)), ("hi", F.ceil(x)))]
    distance = F.abs(F.col("cum_b") / F.nullif(F.col("total_b"), F.lit(0))
                     - F.col("cum_p") / F.nullif(F.col("total_p"), F.lit(0)))
    found = steps.groupBy("feature").agg(
        F.max("total_b").alias("baseline_rows"), F.max("total_p").alias("production_rows"),
        F.sum(v * F.col("b")).alias("_b"), F.sum(v * F.col("p")).alias("_p"),
        F.max(distance).alias("ks_statistic"), *at)
    n_b, n_p = (F.nullif(F.col(c), F.lit(0)) for c in ("baseline_rows", "production_rows"))

    def bound(i: int, p: float) -> Column:
        lo, hi, x = F.col(f"_lo{i}"), F.col(f"_hi{i}"), (F.col("baseline_rows") - 1) * p
        return lo + (hi - lo) * (x - F.floor(x))

    bounds = F.array_distinct(F.array(*[bound(i, p) for i, p in enumerate(shares)]))
    return found.select(
        "feature", "baseline_rows", "production_rows", "ks_statistic",
        (F.col("_b") / n_b).alias("baseline_mean"), (F.col("_p") / n_p).alias("production_mean"),
        bounds.alias("_bounds")).withColumn(
        "_inner", F.expr("slice(_bounds, 2, greatest(size(_bounds) - 2, 0))"))


def _psi_of(bins: int) -> Column:
    """PSI of one row per feature, with the rows up to each inner boundary as ``_upto``."""
    n_b, n_p = F.col("baseline_rows"), F.col("production_rows")
    # rows up to the end of each bin; boundaries that were merged have no bin
    ends = F.concat(F.slice("_upto", F.lit(1), F.size("_inner")),
                    F.array(F.struct(n_b.alias("b"), n_p.alias("p"))))
    starts = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("b"),
                                       F.lit(0).cast("long").alias("p"))), ends)

    def share(end, start, side, n):
        return F.greatest((end[side] - start[side]) / F.nullif(n, F.lit(0)), F.lit(EMPTY_SHARE))

    terms = F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda x: F.when(
        x["e"].isNotNull(), (share(x["e"], x["s"], "p", n_p) - share(x["e"], x["s"], "b", n_b))
        * F.log(share(x["e"], x["s"], "p", n_p) / share(x["e"], x["s"], "b", n_b))).otherwise(0.0))
    return (F.when((n_b == 0) | (n_p == 0), F.lit(None))
            .when(F.size("_bounds") < 3, F.lit(0.0))
            .otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def drift_report(values: DataFrame, bins: int = 10) -> DataFrame:
    """Moments, PSI, level and KS test, one row per feature.

    All come from one table of counted values (``drift_steps``), which is written: the rows are
    expanded and counted once. A first pass over it gives means, boundaries and the KS distance, a
    second, with these per feature, deviations and the rows up to each boundary.
    """
    spark, path = values.sparkSession, shared_folder(values.sparkSession, "drift-steps")
    drift_steps(values).write.parquet(path)
    steps = spark.read.parquet(path)
    first = settle(_first_look(steps, bins))  # a row per listed feature
    v = F.col("value")

    def upto(i: int) -> Column:
        bound = F.get("_inner", F.lit(i))
        return F.struct(*[F.coalesce(F.max(F.when(v <= bound, F.col(f"cum_{side}"))), F.lit(0))
                          .alias(side) for side in ("b", "p")])

    def deviation(side: str, name: str) -> Column:
        square = F.sum(F.col(side) * F.pow(v - F.col(f"{name}_mean"), 2))
        rows = F.sum(side)
        return F.sqrt(square / F.when(rows > 1, rows - 1)).alias(f"{name}_std")

    keys = first.columns
    found = steps.join(F.broadcast(first), "feature").groupBy(*keys).agg(
        deviation("b", "baseline"), deviation("p", "production"),
        F.array(*[upto(i) for i in range(bins - 1)]).alias("_upto"))
    found = ks_pvalue(found.withColumn("psi", _psi_of(bins)))
    return found.select("feature", "baseline_mean", "production_mean", "baseline_std",
                        "production_std", "psi", drift_level(F.col("psi")).alias("drift_level"),
                        "ks_statistic", "ks_pvalue")


def monitoring_status(drift: DataFrame) -> DataFrame:
    counted = drift.agg(*[F.count_if(F.col("drift_level") == level).alias(f"{level.lower()}_features")
                          for level in ("High", "Moderate", "Stable")])
    high, moderate = F.col("high_features"), F.col("moderate_features")
    return counted.withColumn("monitoring_status", (
        F.when(high >= 3, DRIFT_STATUS[0]).when(high >= 1, DRIFT_STATUS[1])
        .when(moderate >= 3, DRIFT_STATUS[2]).otherwise(DRIFT_STATUS[3])))


def weekly_monitoring(production: DataFrame, predictions: DataFrame,
                      keys: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
    """Behaviour per week from Monday; rows without a prediction count as observed."""
    joined = production.select(*keys, "anomaly_score", "anomaly_percentile",
                               "failure_next_24h").join(
        predictions.select(*keys, "failure_probability", "alert"), list(keys), "left")
    return joined.groupBy(truncate("week", MINUTE).alias("week_start")).agg(
        F.count("*").alias("observations"),
        F.avg("failure_probability").alias("mean_failure_probability"),
        F.max("failure_probability").alias("max_failure_probability"),
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        F.avg("anomaly_percentile").alias("mean_anomaly_percentile"),
        F.sum("failure_next_24h").alias("true_risk_minutes"),
        (F.avg("alert") * 100).alias("alert_rate_percent"))
