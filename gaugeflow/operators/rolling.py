"""Backward-looking range windows and the columns derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.config import (ASSET, DEVIATION_SIGNALS, FRAMES, GRAIN_SECONDS, MINUTE,
                              RANGE_COLUMNS, SIGNALS, TREND_SIGNALS, ZSCORE_SIGNALS)
from gaugeflow.functions.expr import micros

CHUNK_SECONDS = 24 * 3600
MICROS = 1_000_000
SQL_STATS = {"count": "count", "avg": "avg", "std": "stddev_pop", "max": "max"}
BY_ALIAS = {s.alias: s for s in SIGNALS}


def rolling_spec() -> dict[str, tuple[str, str, str]]:
    """Output column -> (statistic, source column, frame)."""
    spec = {f"observations_{frame}": ("count", "*", frame) for frame in FRAMES}
    for s in SIGNALS:
        for frame in s.avg:
            spec[f"{s.alias}{s.avg_infix}{frame}"] = ("avg", s.mean, frame)
        for frame in s.std:
            spec[f"{s.alias}_std_{frame}"] = ("std", s.mean, frame)
        for frame in s.peak:
            spec[f"{s.alias}_max_{frame}"] = ("max", s.peak_source, frame)
    return spec


def _chunked(rows: DataFrame, time_col: str, chunk_seconds: int, reach: int) -> DataFrame:
    """Rows tagged with their time chunk, and repeated in the next one if it can see them."""
    width = F.lit(chunk_seconds * MICROS)
    at, own = F.col("_at"), F.col("_own")
    near_next = at >= (own + 1) * width - F.lit(reach * MICROS)
    return (rows.withColumn("_at", micros(time_col))
            .withColumn("_own", F.floor(F.col("_at") / width))
            .withColumn("_chunk", F.explode(F.when(near_next, F.array(own, own + 1))
                                            .otherwise(F.array(own)))))


def rolling_windows(minutes: DataFrame, spec: Mapping[str, tuple[str, str, str]] | None = None, *,
                    frames: Mapping[str, int] = FRAMES, keys: Sequence[str] = (ASSET,),
                    time_col: str = MINUTE, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Range frames ``[t - frame, t]``, peers included, in one pass over time chunks.

    A row belongs to its own chunk, and is repeated in the next one when a frame
    there can reach back to it; repeats are dropped at the end.  One long series
    therefore spreads over (asset, chunk), with one shuffle and one sort for all
    frames.  Inside a chunk the statistics are Spark's own over sliding frames: each frame
    is summed up from its own rows, so that no reading outside of it, however
    extreme, can cost it digits.  At the minute grain a frame of six hours has 361
    rows at most, whatever the length of the series.

    A row without a time is kept; its frames hold the rows of its asset without one.
    """
    spec = dict(spec or rolling_spec())
    reach = max(frames[frame] for _, _, frame in spec.values())
    if chunk_seconds < reach:
        raise ValueError("a chunk must be at least as long as the longest frame")
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _chunk ORDER BY _at"

    def windowed(out: str, stat: str, source: str, frame: str) -> str:
        column = source if source == "*" else f"`{source}`"
        return (f"{SQL_STATS[stat]}({column}) OVER ({part} RANGE BETWEEN "
                f"{frames[frame] * MICROS}L PRECEDING AND CURRENT ROW) AS `{out}`")

    return (_chunked(minutes, time_col, chunk_seconds, reach)
            .selectExpr("*", *[windowed(out, *how) for out, how in spec.items()])
            .filter("_chunk <=> _own")
            .selectExpr(*[f"`{c}`" for c in minutes.columns], *[f"`{out}`" for out in spec]))


def trend_columns() -> dict[str, Column]:
    """Short average minus long average."""
    out = {}
    for alias in TREND_SIGNALS:
        out[f"{alias}_short_trend"] = F.col(f"{alias}_avg_15m") - F.col(f"{alias}_avg_1h")
        out[f"{alias}_long_trend"] = F.col(f"{alias}_avg_1h") - F.col(f"{alias}_avg_6h")
    out["compressor_activity_change"] = (F.col("compressor_activity_1h")
                                         - F.col("compressor_activity_6h"))
    return out


def deviation_columns() -> dict[str, Column]:
    return {f"{a}_deviation_6h": F.col(BY_ALIAS[a].mean) - F.col(f"{a}_avg_6h")
            for a in DEVIATION_SIGNALS}


def zscore_columns(std_floor: float = 0.0) -> dict[str, Column]:
    """Deviation in standard deviations; NULL where the deviation is not above the floor."""
    out = {}
    for a in ZSCORE_SIGNALS:
        std = F.col(f"{a}_std_6h")
        out[f"{a}_zscore_6h"] = ((F.col(BY_ALIAS[a].mean) - F.col(f"{a}_avg_6h"))
                                 / F.when(std > F.lit(std_floor), std))
    return out


def instability_columns() -> dict[str, Column]:
    out = {"pressure_balance_gap": F.abs(F.col("tp3_mean") - F.col("reservoirs_mean"))}
    for name, source in RANGE_COLUMNS.items():
        out[name] = F.col(f"{source}_max") - F.col(f"{source}_min")
    return out


def coverage_columns(frames: Sequence[str] = ("1h", "6h"),
                     grain_seconds: int = GRAIN_SECONDS) -> dict[str, Column]:
    """Observed share of the rows a full frame holds, both of its ends included."""
    return {f"coverage_{f}": F.col(f"observations_{f}")
            / F.lit(float(FRAMES[f] // grain_seconds + 1)) for f in frames}


def derived_columns(std_floor: float = 0.0) -> dict[str, Column]:
    return {**trend_columns(), **deviation_columns(), **zscore_columns(std_floor),
            **instability_columns(), **coverage_columns()}


def rolling_features(labelled: DataFrame, std_floor: float = 0.0, **options) -> DataFrame:
    """The feature layer: 29 window columns and 21 columns computed from them."""
    return rolling_windows(labelled, **options).withColumns(derived_columns(std_floor))


def rolling_summary(features: DataFrame, min_coverage: float = 0.80) -> DataFrame:
    return features.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("eligible_for_model") == 1).alias("eligible_rows"),
        F.round(F.avg("coverage_1h"), 3).alias("avg_1h_coverage"),
        F.round(F.avg("coverage_6h"), 3).alias("avg_6h_coverage"),
        F.count_if(F.col("coverage_6h") >= min_coverage).alias("high_quality_6h_rows"))


def period_column(target: str = "failure_next_24h") -> Column:
    return F.when(F.col(target) == 1, "Within 24h of failure").otherwise("Normal")


# output -> (column, digits)
PERIOD_AVERAGES = {
    "oil_temp_trend": ("oil_temp_long_trend", 3),
    "oil_temp_instability": ("oil_temp_std_1h", 3),
    "current_instability": ("motor_current_std_1h", 3),
    "pressure_instability": ("tp3_std_1h", 4),
    "reservoir_instability": ("reservoir_std_1h", 4),
    "flow_instability": ("flow_std_1h", 3),
    "pressure_balance_gap": ("pressure_balance_gap", 4),
}


def normal_vs_prefailure(features: DataFrame, min_coverage_1h: float = 0.50) -> DataFrame:
    """Average behaviour in normal operation and in the day before a failure."""
    return (features
            .filter((F.col("eligible_for_model") == 1) & (F.col("coverage_1h") >= min_coverage_1h))
            .groupBy(period_column().alias("period"))
            .agg(F.count("*").alias("rows"),
                 *[F.round(F.avg(c), digits).alias(name)
                   for name, (c, digits) in PERIOD_AVERAGES.items()]))


def zscore_exceedances(features: DataFrame, limit: float = 2.0,
                       min_coverage_6h: float = 0.50) -> DataFrame:
    return (features
            .filter((F.col("eligible_for_model") == 1) & (F.col("coverage_6h") >= min_coverage_6h))
            .agg(*[F.count_if(F.abs(f"{a}_zscore_6h") >= limit).alias(f"{a}_anomalies")
                   for a in ZSCORE_SIGNALS]))
