import math
import random

from pyspark.sql import Window as W, functions as F

from conftest import at
from gaugeflow.config import FRAMES
from gaugeflow.functions.expr import micros
from gaugeflow.operators import rolling
from gaugeflow.session import local_table

SPEC = {
    "n15": ("count", "*", "15m"), "n6": ("count", "*", "6h"),
    "a15": ("avg", "v", "15m"), "a1": ("avg", "v", "1h"), "a6": ("avg", "v", "6h"),
    "s1": ("std", "v", "1h"), "s6": ("std", "v", "6h"), "b6": ("std", "big", "6h"),
    "m1": ("max", "v", "1h"),
}
SQL = {"count": F.count, "avg": F.avg, "std": F.stddev_pop, "max": F.max}


def series(spark, n=1500):
    rng = random.Random(7)
    rows, minute = [], 0
    for i in range(n):
        minute += rng.choice([0, 1, 1, 1, 2, 15, 60]) if i % 200 else 900
        v = None if rng.random() < 0.1 else (5.0 if 300 < i < 700 else rng.gauss(50, 20))
        big = 1e6 + rng.random() * (1e-3 if i % 3 else 1e3)
        rows.append((i % 2, at(minute), v, big))
    return local_table(spark, rows, "asset_id int, minute_timestamp timestamp_ntz, v double, "
                                    "big double")


def test_equals_sliding_windows_without_chunks(spark):
    df = series(spark)
    base = W.partitionBy("asset_id").orderBy("_t")
    plain = df.withColumn("_t", micros("minute_timestamp")).withColumns({
        out: SQL[stat](source).over(base.rangeBetween(-FRAMES[frame] * 1_000_000, 0))
        for out, (stat, source, frame) in SPEC.items()}).drop("_t")
    order = ["asset_id", "minute_timestamp", "v", "big"]
    expected = plain.orderBy(*order).collect()
    found = rolling.rolling_windows(df, SPEC).orderBy(*order).collect()
    assert len(found) == len(expected) == 1500
    for a, b in zip(found, expected):
        for name in SPEC:
            x, y = a[name], b[name]
            if x is None or y is None:
                assert x is None and y is None, (name, a, b)
            else:
                assert math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7), (name, x, y)
    constant = [r for r in expected if r["s6"] == 0.0]
    assert constant and all(r["s6"] == 0.0 for r, e in zip(found, expected) if e["s6"] == 0.0)


def test_row_exactly_a_frame_old_is_inside(spark):
    df = local_table(spark, [(0, at(0), 1.0), (0, at(60), 3.0), (0, at(121), 8.0)],
                     "asset_id int, minute_timestamp timestamp_ntz, v double")
    out = rolling.rolling_windows(df, {"n": ("count", "*", "1h"), "a": ("avg", "v", "1h")})
    assert [(r["n"], r["a"]) for r in out.orderBy("minute_timestamp").collect()] == [
        (1, 1.0), (2, 2.0), (1, 8.0)]


def test_non_finite_value_spoils_only_its_frames(spark):
    df = local_table(spark, [(0, at(0), 1.0), (0, at(10), float("nan")), (0, at(80), 3.0)],
                     "asset_id int, minute_timestamp timestamp_ntz, v double")
    out = rolling.rolling_windows(df, {"a": ("avg", "v", "1h")}).orderBy("minute_timestamp")
    a = [r["a"] for r in out.collect()]
    assert a[0] == 1.0 and math.isnan(a[1]) and a[2] == 3.0


def test_no_look_ahead(spark):
    df = series(spark, 300)
    cut = df.agg(F.percentile_approx(micros("minute_timestamp"), 0.5)).first()[0]
    changed = df.withColumn("v", F.when(micros("minute_timestamp") > cut, 999.0)
                            .otherwise(F.col("v")))
    early = micros("minute_timestamp") <= cut
    one, two = (rolling.rolling_windows(x, {"a": ("avg", "v", "6h"), "n": ("count", "*", "6h")})
                .filter(early).orderBy("asset_id", "minute_timestamp", "big")
                .select("n", F.round("a", 9).alias("a")).collect() for x in (df, changed))
    assert one == two


def test_zscore_is_null_without_spread():
    columns = rolling.zscore_columns()
    assert set(columns) == {f"{s}_zscore_6h" for s in
                            ("oil_temp", "motor_current", "tp3", "reservoir", "flow")}
    assert len(rolling.rolling_spec()) == 29 and len(rolling.derived_columns()) == 21


def test_plan_spreads_one_asset_over_time(spark):
    df = series(spark, 50)
    plan = rolling.rolling_windows(df, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_deviation_beside_a_spike(spark):
    """One reading of 1e9 must not touch the digits of frames without it."""
    rows = [(0, at(m), 8.0 + (m % 10) * 1e-4) for m in range(1400)]
    rows[700] = (0, at(700), 1e9)
    df = local_table(spark, rows, "asset_id int, minute_timestamp timestamp_ntz, v double")
    found = rolling.rolling_windows(df, {"s": ("std", "v", "1h")}).orderBy("minute_timestamp")
    for i, r in enumerate(found.collect()):
        frame = [v for _, _, v in rows[max(0, i - 60):i + 1]]
        mean = math.fsum(frame) / len(frame)
        std = math.sqrt(math.fsum((v - mean) ** 2 for v in frame) / len(frame))
        assert math.isclose(r["s"], std, rel_tol=1e-9, abs_tol=1e-12)


def test_row_without_a_time_is_kept(spark):
    df = local_table(spark, [(0, at(0), 1.0), (0, None, 3.0)],
                     "asset_id int, minute_timestamp timestamp_ntz, v double")
    out = rolling.rolling_windows(df, {"n": ("count", "*", "1h"), "a": ("avg", "v", "1h")})
    assert sorted((r["minute_timestamp"] is None, r["n"], r["a"]) for r in out.collect()) == [
        (False, 1, 1.0), (True, 1, 3.0)]
