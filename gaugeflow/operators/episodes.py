"""Alert minutes merged into maintenance episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from gaugeflow.config import ALERT_LEVELS, ASSET, EPISODE_GAP_MINUTES, MINUTE
from gaugeflow.functions.expr import flag, micros
from gaugeflow.operators.labels import failure_facts

CHUNK_SECONDS = 24 * 3600

# output -> column whose maximum it is
PEAKS = {
    "max_priority_score": "maintenance_priority_score",
    "peak_early_warning_score": "early_warning_score",
    "peak_near_failure_score": "near_failure_score",
    "peak_anomaly_percentile": "anomaly_percentile",
}


def alert_rows(decisions: DataFrame, levels: Sequence[str] = ALERT_LEVELS) -> DataFrame:
    return decisions.filter(F.col("risk_level").isin(*levels))


def alert_episodes(alerts: DataFrame, *, gap_minutes: float = EPISODE_GAP_MINUTES,
                   keys: Sequence[str] = (ASSET,), time_col: str = MINUTE,
                   peaks: dict[str, str] = PEAKS,
                   chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Runs of alerts without a pause longer than the gap, numbered per asset.

    Runs are first formed inside each (asset, day), in parallel, and shrink to
    one row each; runs of one day lie more than a gap apart, so few remain.
    Only these rows are put in order per asset, to join runs across midnight.
    A pause of exactly the gap does not end an episode.
    """
    gap = int(gap_minutes * 60_000_000)
    at = F.col("_at")
    rows = alerts.select(*keys, F.col(time_col).alias("_t"), *peaks.values(),
                         micros(time_col).alias("_at"))
    rows = rows.withColumn("_chunk", F.floor(at / F.lit(chunk_seconds * 1_000_000)))
    day = W.partitionBy(*keys, "_chunk").orderBy("_at")
    starts = flag(F.lag("_at").over(day).isNull() | (at - F.lag("_at").over(day) > gap))
    runs = (rows.withColumn("_new", starts)
            .withColumn("_run", F.sum("_new").over(day.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy(*keys, "_chunk", "_run")
            .agg(F.min("_t").alias("episode_start"), F.max("_t").alias("episode_end"),
                 *[F.max(c).alias(out) for out, c in peaks.items()],
                 F.count("*").alias("observations")))
    order = W.partitionBy(*keys).orderBy("episode_start")
    pause = micros("episode_start") - micros(F.lag("episode_end").over(order))
    numbered = (runs.withColumn("_new", flag(pause.isNull() | (pause > gap)))
                .withColumn("alert_episode_id", F.sum("_new").over(
                    order.rowsBetween(W.unboundedPreceding, 0))))
    return (numbered.groupBy(*keys, "alert_episode_id")
            .agg(F.min("episode_start").alias("episode_start"),
                 F.max("episode_end").alias("episode_end"),
                 *[F.max(out).alias(out) for out in peaks],
                 F.sum("observations").alias("observations")))


def flag_failure_related(episodes: DataFrame, failures: DataFrame, hours: float = 24,
                         keys: Sequence[str] = (ASSET,), **options) -> DataFrame:
    """1 when the episode overlaps the window before some failure of its asset.

    The episode must begin before the failure and end no earlier than its
    window, so the first failure after the episode's begin decides.
    """
    facts = failure_facts(episodes, failures, keys=keys, time_col="episode_start", **options)
    reach = F.lit(int(hours * 3_600_000_000))
    return (facts.withColumn("failure_related",
                             flag(micros("_next_start") - micros("episode_end") <= reach))
            .drop("_open_until", "_next_start", "_last_end"))


def episode_summary(episodes: DataFrame) -> DataFrame:
    related = F.coalesce(F.sum("failure_related"), F.lit(0))
    return episodes.agg(F.count("*").alias("episodes"),
                        related.alias("failure_related_episodes"),
                        (F.count("*") - related).alias("false_alert_episodes"))
