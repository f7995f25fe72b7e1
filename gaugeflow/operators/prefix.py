"""Cumulative counts in value order, and exact quantiles, on any number of rows.

Both are the distributed answer to "sort everything and walk along it": values are
walked along in cells, and only sums of cells are ever put in order per key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeflow.session import settle, shared_folder

BUCKETS = 256
CELL_VALUES = 4096
SKETCH_ACCURACY = 10_000
# quantiles: half a bracket's first width as a share of the values, the cells into which it is cut
# again, and the values that are counted one by one per bracket
SLACK = 1 / 1024
GRID = 256
BRACKET_ROWS = 100_000


def below(cuts: Column, value: Column, buckets: int) -> Column:
    """How many of ``buckets - 1`` ascending cut points lie below a value.

    First among every ``step``-th of them, then among those that follow.
    """
    step = max(2, math.isqrt(buckets))
    coarse = F.size(F.filter(F.array(*[F.get(cuts, F.lit(i)) for i in range(
        step - 1, buckets - 1, step)]), lambda c: c < value)) * step
    fine = F.filter(F.slice(cuts, coarse + 1, F.lit(step - 1)), lambda c: c < value)
    return coarse + F.size(fine)


def prefix_sums(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], *,
                buckets: int | None = None) -> DataFrame:
    """One row per distinct (keys, value) with running sums in value order.

    For each name in ``sums`` the result holds the sum at that value (``name``),
    the sum up to and including it (``cum_name``) and the key's total
    (``total_name``).

    Rows collapse to distinct values on the map side first, so repeated values
    cost nothing; these are written, as they are used more than once.  Values are cut
    into ranges at approximate quantiles of all distinct values, and each range again into
    as many cells, so a cell holds about one in ``buckets ** 2`` of them (by default about
    ``CELL_VALUES``, up to ``BUCKETS`` ranges).  The running sum restarts per cell; the
    sums of the earlier cells of the range and of the earlier ranges are added.  The
    cut points only balance the work and never change the result, and no window
    over ranges or cells has more than ``buckets`` rows of a key.
    """
    distinct = _stored(df.groupBy(*keys, value).agg(*[f.alias(name) for name, f in sums.items()]))
    buckets = buckets or min(BUCKETS, max(2, math.isqrt(distinct.count() // CELL_VALUES)))
    shares, v = [i / buckets for i in range(1, buckets)], F.col(value)
    cuts = distinct.agg(F.percentile_approx(value, shares, 2_000).alias("cuts")).scalar()
    ranged = (distinct.withColumn("_cuts", cuts)
              .withColumn("_range", below(F.col("_cuts"), v, buckets)).drop("_cuts"))
    inner = ranged.groupBy("_range").agg(F.percentile_approx(value, shares, 2_000).alias("_cuts"))
    celled = _stored(ranged.join(F.broadcast(inner), "_range")  # a row per range
                     .withColumn("_cell", below(F.col("_cuts"), v, buckets)).drop("_cuts"))

    def before(n: str, part: Sequence[str], order: str) -> Column:
        w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(w), F.lit(0))

    cells = celled.groupBy(*keys, "_range", "_cell").agg(*[F.sum(n).alias(n) for n in sums])
    ranges = cells.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in sums]).select(
        *keys, "_range", *[before(n, keys, "_range").alias(f"_r_{n}") for n in sums],
        *[F.sum(n).over(W.partitionBy(*keys)).alias(f"total_{n}") for n in sums])
    offsets = cells.select(
        *keys, "_range", "_cell",
        *[before(n, [*keys, "_range"], "_cell").alias(f"_c_{n}") for n in sums]).join(
        ranges, [*keys, "_range"]).select(
        *keys, "_range", "_cell", *[(F.col(f"_c_{n}") + F.col(f"_r_{n}")).alias(f"_before_{n}")
                                    for n in sums], *[f"total_{n}" for n in sums])
    within = W.partitionBy(*keys, "_range", "_cell").orderBy(value).rowsBetween(
        W.unboundedPreceding, 0)
    running = celled.withColumns({f"_run_{n}": F.sum(n).over(within) for n in sums})
    return (running.join(offsets, [*keys, "_range", "_cell"])
            .select(*keys, value, *sums,
                    *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}")
                      for n in sums],
                    *[f"total_{n}" for n in sums]))


def _brackets(data: DataFrame, keys: list[str], probs: list[float], accuracy: int,
              slack: float) -> DataFrame:
    """Per key: number of values, and for every rank a range of values in which it lies, by a sketch."""
    lows, highs = [max(0.0, p - slack) for p in probs], [min(1.0, p + slack) for p in probs]
    found = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_edges"))
    # so few values that a share of them is less than a rank: their whole range
    few = F.col("_n") * slack < 4

    def edge(i: int, whole: str, is_end: bool) -> Column:
        return F.col(whole) if is_end else F.when(few, F.col(whole)).otherwise(F.col("_edges")[i])

    return found.select(*keys, "_n", F.array(*[
        F.struct(edge(i, "_min", lows[i] <= 0).alias("lo"),
                 edge(len(probs) + i, "_max", highs[i] >= 1).alias("hi"),
                 (F.col("_n") * (2 * slack)).cast("long").alias("rows"))
        for i in range(len(probs))]).alias("_b"))


def _narrowed(data: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Each bracket cut at a grid of quantiles of the values in it, down to the cells around the rank."""
    grid = [i / GRID for i in range(GRID + 1)]
    v, parts = F.col("_v"), []
    for i in range(len(probs)):
        b = F.col("_b")[i]
        inside = F.when(v.between(b["lo"], b["hi"]), v)
        parts += [F.count_if(v < b["lo"]).alias(f"_under{i}"), F.count(inside).alias(f"_in{i}"),
                  F.percentile_approx(inside, grid, SKETCH_ACCURACY).alias(f"_grid{i}")]
    met = data.join(brackets, keys).groupBy(*keys, "_n", "_b").agg(*parts)

    def cell(i: int, p: float) -> Column:
        n, rank = F.col(f"_in{i}"), (F.col("_n") - 1) * p - F.col(f"_under{i}")
        # two cells and two ranks on either side
        at, pad = rank / n * GRID, F.lit(2.0) + F.lit(2.0 * GRID) / n
        first = F.greatest(F.floor(at - pad), F.lit(0)).cast("int")
        last = F.least(F.ceil(at + pad), F.lit(GRID)).cast("int")
        old = F.col("_b")[i]
        # the ends stay what they are: the sketch is exact only between them
        return F.struct(
            F.when(first > 0, F.get(f"_grid{i}", first)).otherwise(old["lo"]).alias("lo"),
            F.when(last < GRID, F.get(f"_grid{i}", last)).otherwise(old["hi"]).alias("hi"),
            (n * (last - first) / GRID).cast("long").alias("rows"))

    return met.select(*keys, "_n", F.array(*[cell(i, p) for i, p in enumerate(probs)]).alias("_b"))


def _picked(data: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The quantiles, and as ``_missed`` whether a rank lies outside its bracket."""
    v, b = F.col("_v"), F.col("_b")
    inside = F.exists(b, lambda x: v.between(x["lo"], x["hi"]))
    under = F.array_max(F.transform(F.filter(b, lambda x: x["hi"] < v), lambda x: x["hi"]))
    # values between brackets stand as one counted value, the end of the bracket below them
    counted = (data.join(brackets, keys)
               .select(*keys, "_n", "_b", (~inside).alias("_gap"), F.when(inside, v).otherwise(
                   F.coalesce(under, F.lit(float("-inf")))).alias("_v"))
               .groupBy(*keys, "_n", "_b", "_gap", "_v").agg(F.count("*").alias("_c")))
    missed = []
    for i, p in enumerate(probs):
        lo, hi, place = b[i]["lo"], b[i]["hi"], (F.col("_n") - 1) * p
        before = F.sum(F.when(v < lo, F.col("_c")).otherwise(0))
        upto = F.sum(F.when((v < hi) | ((v == hi) & ~F.col("_gap")), F.col("_c")).otherwise(0))
        missed.append((before > F.floor(place)) | (upto <= F.ceil(place)))
    return counted.groupBy(*keys, "_n", "_b").agg(
        F.percentile("_v", probs, F.col("_c")).alias("quantiles"),
        F.array(*missed).alias("_missed")).select(*keys, "quantiles", "_missed")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *,
                    accuracy: int = SKETCH_ACCURACY, few_keys: bool = False, slack: float = SLACK,
                    most_rows: int = BRACKET_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles: one array column ``quantiles`` per key.

    Selection by counting. A mergeable sketch brackets every wanted rank; brackets with more than
    ``most_rows`` values are cut again, each pass to a small part of what they held. Then one
    pass counts: values inside a bracket one by one, all others as one value per gap, each once
    however many ranks are wanted. So a key has a bounded number of counted values, and the
    quantiles are those of the counted values. Should a rank lie outside its bracket, all is done
    again with wider ones. NULLs are ignored.

    Like any fit this runs at once. ``few_keys`` says that the number of keys is bounded by a list
    in the program (features, models): brackets and results then are local tables, else
    they are written out.
    """
    probs = [float(p) for p in probs]
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        df, few_keys = df.withColumn("_all", F.lit(0)), True
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull())
    keep = settle if few_keys else _stored
    while True:
        brackets = keep(_brackets(data, keys, probs, accuracy, slack))
        wide = F.exists("_b", lambda x: (x["rows"] > most_rows) & (x["lo"] < x["hi"]))
        while slack < 1 and not brackets.filter(wide).isEmpty():
            before, brackets = brackets, keep(_narrowed(data, brackets, keys, probs))
            if before.select(*keys, _ends()).exceptAll(brackets.select(*keys, _ends())).isEmpty():
                break  # values that repeat so often that they fill their bracket
        found = keep(_picked(data, brackets, keys, probs))
        if slack >= 1 or found.filter(F.array_contains("_missed", True)).isEmpty():
            return found.drop("_missed", "_all")
        slack *= 8


def _ends() -> Column:
    return F.transform("_b", lambda x: F.struct(x["lo"], x["hi"])).alias("_ends")


def _stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 few_keys: bool = False) -> DataFrame:
    return (exact_quantiles(df, keys, value, [0.5], few_keys=few_keys)
            .withColumn(name, F.col("quantiles")[0]).drop("quantiles"))
