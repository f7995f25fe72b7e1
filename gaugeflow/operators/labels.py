"""Failure labels for every minute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gaugeflow.config import ASSET, HORIZON_HOURS, MINUTE, RECOVERY_HOURS
from gaugeflow.functions.expr import flag, hours_between, micros
from gaugeflow.operators.intervals import BROADCAST_ROWS, fits_broadcast, match_intervals

DAY_SECONDS = 24 * 3600

# Three facts per row carry every label: the latest end among failures begun by
# now, the next start, and the latest end before now.
FACTS = ("_open_until", "_next_start", "_last_end")


def _facts_by_broadcast(rows, failures, keys, time_col):
    """Each asset's failures as one array, probed row by row without a shuffle."""
    packed = failures.groupBy(*keys).agg(F.collect_list(
        F.struct(F.col("start_time").alias("s"), F.col("end_time").alias("e"))).alias("_f"))
    t = F.col(time_col)
    begun = F.filter("_f", lambda f: f.s <= t)
    coming = F.filter("_f", lambda f: f.s > t)
    over = F.filter("_f", lambda f: f.e < t)
    return (rows.join(F.broadcast(packed), list(keys), "left")
            .withColumns({
                "_open_until": F.array_max(F.transform(begun, lambda f: f.e)),
                "_next_start": F.array_min(F.transform(coming, lambda f: f.s)),
                "_last_end": F.array_max(F.transform(over, lambda f: f.e)),
            }).drop("_f"))


def _facts_by_scan(rows, failures, keys, time_col, chunk_seconds):
    """Rows and failure bounds in one ordered pass per (asset, day).

    At equal times the order is start, row, end: a start at the row's own time
    has begun, is not "next", and an end at the row's own time is not over.
    What earlier and later days contribute comes from one summary row per day.
    """
    width = F.lit(chunk_seconds * 1_000_000)
    chunk = F.floor(micros(time_col) / width)
    rows = rows.withColumns({"_kind": F.lit(1), "_chunk": chunk})
    starts = failures.select(*keys, F.col("start_time").alias(time_col), F.lit(0).alias("_kind"),
                             F.col("start_time").alias("_s"), F.col("end_time").alias("_o"))
    ends = failures.select(*keys, F.col("end_time").alias(time_col), F.lit(2).alias("_kind"),
                           F.col("end_time").alias("_e"))
    # a bound that is not known says nothing at any time
    marks = (starts.unionByName(ends, allowMissingColumns=True)
             .filter(F.col(time_col).isNotNull()).withColumn("_chunk", chunk))

    days = (rows.select(*keys, "_chunk").unionByName(
                marks.select(*keys, "_chunk", "_s", "_o", "_e"), allowMissingColumns=True)
            .groupBy(*keys, "_chunk")
            .agg(F.max("_o").alias("o"), F.min("_s").alias("s"), F.max("_e").alias("e")))
    past = (W.partitionBy(*keys).orderBy("_chunk")
            .rowsBetween(W.unboundedPreceding, -1))
    future = (W.partitionBy(*keys).orderBy(F.desc("_chunk"))
              .rowsBetween(W.unboundedPreceding, -1))
    carry = days.select(*keys, "_chunk",
                        F.max("o").over(past).alias("_c_o"), F.min("s").over(future).alias("_c_s"),
                        F.max("e").over(past).alias("_c_e"))

    part = W.partitionBy(*keys, "_chunk")
    forward = part.orderBy(time_col, "_kind").rowsBetween(W.unboundedPreceding, 0)
    backward = (part.orderBy(F.desc(time_col), F.desc("_kind"))
                .rowsBetween(W.unboundedPreceding, 0))
    mixed = (rows.unionByName(marks, allowMissingColumns=True)
             .join(carry, [*keys, "_chunk"], "left"))
    # the backward pass runs first so that the forward sort is not undone
    return (mixed
            .withColumn("_next_start",
                        F.least(F.min("_s").over(backward), F.col("_c_s")))
            .withColumn("_open_until",
                        F.greatest(F.max("_o").over(forward), F.col("_c_o")))
            .withColumn("_last_end",
                        F.greatest(F.max("_e").over(forward), F.col("_c_e")))
            .filter(F.col("_kind") == 1)
            .drop("_kind", "_chunk", "_s", "_o", "_e", "_c_o", "_c_s", "_c_e"))


def failure_facts(rows: DataFrame, failures: DataFrame, *, keys: Sequence[str] = (ASSET,),
                  time_col: str = MINUTE, broadcast_rows: int = BROADCAST_ROWS,
                  chunk_seconds: int = DAY_SECONDS) -> DataFrame:
    """Add the three facts of ``FACTS`` to every row, by the way that fits the table.

    A failure without a key belongs to no asset, and a row without one has no failures.
    """
    bounds = failures.select(*keys, "start_time", "end_time").dropna(subset=list(keys))
    if fits_broadcast(bounds, keys, broadcast_rows):
        return _facts_by_broadcast(rows, bounds, keys, time_col)
    return _facts_by_scan(rows, bounds, keys, time_col, chunk_seconds)


def label_minutes(minutes: DataFrame, failures: DataFrame, *,
                  horizons: Sequence[int] = HORIZON_HOURS, recovery_hours: int = RECOVERY_HOURS,
                  time_col: str = MINUTE, **options) -> DataFrame:
    """Add the failure labels of each row.

    ``failure_active`` includes both interval ends; ``failure_next_{h}h`` looks
    at starts in ``(t, t+h]``; ``post_failure_24h`` at ends in ``[t-24h, t)``;
    ``hours_to_next_failure`` is NULL after the last failure.  Rows inside a
    failure or its recovery are not eligible for modelling.
    """
    facts = failure_facts(minutes, failures, time_col=time_col, **options)
    t = F.col(time_col)
    to_next = micros("_next_start") - micros(t)
    since_end = micros(t) - micros("_last_end")
    hour = 3_600_000_000
    labels = {"failure_active": flag(F.col("_open_until") >= t)}
    for h in horizons:
        labels[f"failure_next_{h}h"] = flag(to_next <= F.lit(h * hour))
    labels[f"post_failure_{recovery_hours}h"] = flag(since_end <= F.lit(recovery_hours * hour))
    labels["hours_to_next_failure"] = hours_between(t, "_next_start")
    return (facts.withColumns(labels)
            .withColumn("eligible_for_model",
                        flag((F.col("failure_active") == 0)
                             & (F.col(f"post_failure_{recovery_hours}h") == 0)))
            .drop(*FACTS))


def label_distribution(labelled: DataFrame,
                       horizons: Sequence[int] = HORIZON_HOURS) -> DataFrame:
    names = ["failure_active", *[f"failure_next_{h}h" for h in horizons],
             f"post_failure_{RECOVERY_HOURS}h", "eligible_for_model"]
    return labelled.agg(*[F.sum(c).alias(c) for c in names])


def failure_durations(failures: DataFrame) -> DataFrame:
    return failures.withColumn(
        "duration_hours", F.round(hours_between("start_time", "end_time"), 2))


def lookback_windows(failures: DataFrame, hours: float, low: str = "window_start") -> DataFrame:
    """Failures with the start of the window that ends where they begin."""
    return failures.withColumn(low, F.col("start_time") - F.make_dt_interval(
        secs=F.lit(float(hours) * 3600)))


def merged_lookbacks(failures: DataFrame, hours: float, keys: Sequence[str] = (ASSET,),
                     low: str = "window_start") -> DataFrame:
    """The windows before all failures of an asset, those that touch as one.

    Each moment lies in one window at most, so rows that join them never repeat.
    """
    windows = lookback_windows(failures.select(*keys, "start_time"), hours, low).filter(
        F.col("start_time").isNotNull())
    order = W.partitionBy(*keys).orderBy("start_time")
    fresh = F.coalesce(F.col(low) > F.lag("start_time").over(order), F.lit(True))
    run = F.sum(flag(F.col("_new"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (windows.withColumn("_new", fresh).withColumn("_run", run)
            .groupBy(*keys, "_run").agg(F.min(low).alias(low),
                                        F.max("start_time").alias("start_time")).drop("_run"))


# output -> (statistic, column)
PREFAILURE_STATS = {
    "avg_oil_temperature": (F.avg, "oil_temperature_mean"),
    "max_oil_temperature": (F.max, "oil_temperature_max"),
    "avg_motor_current": (F.avg, "motor_current_mean"),
    "avg_tp3_pressure": (F.avg, "tp3_mean"),
    "avg_reservoir_pressure": (F.avg, "reservoirs_mean"),
    "avg_flowmeter": (F.avg, "flowmeter_mean"),
}


def prefailure_profile(minutes: DataFrame, failures: DataFrame, hours: float = 24,
                       keys: Sequence[str] = (ASSET,), digits: int = 2, **options) -> DataFrame:
    """Rounded sensor statistics over the window before each failure."""
    wanted = sorted({c for _, c in PREFAILURE_STATS.values()})
    ids = ("event_id", "failure_type")
    windows = lookback_windows(failures.select(*keys, *ids, "start_time"), hours)
    return (match_intervals(minutes.select(*keys, MINUTE, *wanted), windows,
                            "window_start", "start_time", keys=keys, **options)
            .groupBy(*keys, *ids)
            .agg(*[F.round(stat(c), digits).alias(name)
                   for name, (stat, c) in PREFAILURE_STATS.items()]))
