"""Column expressions used across operators; all run inside codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

INF = float("inf")
MICROS_PER_HOUR = 3.6e9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and the infinities become NULL: one kind of missing value."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def clip(c: Column | str, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def micros(t: Column | str) -> Column:
    return F.unix_micros(col(t).cast("timestamp"))


def hours_between(earlier: Column | str, later: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(MICROS_PER_HOUR)


def minutes_between(earlier: Column | str, later: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(6e7)


def shift_hours(t: Column | str, hours: float) -> Column:
    return col(t) + F.make_dt_interval(secs=F.lit(hours * 3600.0))


def truncate(unit: str, t: Column | str) -> Column:
    return F.date_trunc(unit, col(t)).cast("timestamp_ntz")


def threshold_component(score: Column | str, threshold: Column | str) -> Column:
    """Score scaled so that its threshold lands on 0.5 and twice that on 1."""
    score, threshold = col(score), col(threshold)
    scaled = F.when(threshold <= 0, score).otherwise(
        score / F.when(threshold > 0, threshold) / 2.0)
    return clip(scaled, 0.0, 1.0)


def first_largest(candidates: Sequence[tuple[str, Column]]) -> Column:
    """Name of the largest value; a tie goes to the name listed first.

    A NULL candidate never wins; all NULL gives NULL.
    """
    top = F.greatest(*[value for _, value in candidates])
    return F.coalesce(*[F.when(value == top, F.lit(name)) for name, value in candidates])


def lookup(c: Column | str, mapping: dict) -> Column:
    c = col(c)
    (key, value), *rest = mapping.items()
    return reduce(lambda acc, kv: acc.when(c == F.lit(kv[0]), F.lit(kv[1])), rest,
                  F.when(c == F.lit(key), F.lit(value)))
