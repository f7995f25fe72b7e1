"""Isolation forest, alert threshold and healthy-baseline percentile."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gaugeflow.config import ASSET, MINUTE, TARGETS
from gaugeflow.functions.expr import flag
from gaugeflow.operators.intervals import match_intervals
from gaugeflow.operators.labels import lookback_windows
from gaugeflow.operators.prefix import below, exact_median, exact_quantiles, prefix_sums
from gaugeflow.operators.prep import impute, standardize
from gaugeflow.operators.rolling import period_column
from gaugeflow.session import local_table, settle, shared_folder

TREES = 400
SAMPLE = 256
# ranges into which the distribution of the baseline's scores is cut
STEP_BUCKETS = 1024
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, "
               "left_id int, right_id int, size int, depth int")
EULER_GAMMA = 0.5772156649015329


def path_length(n) -> np.ndarray:
    """Expected depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype="float64")
    out = np.where(n > 1, 1.0, 0.0)
    many = n > 2
    m = np.where(many, n, 3.0)
    return np.where(many, 2.0 * (np.log(m - 1) + EULER_GAMMA) - 2.0 * (m - 1) / m, out)


def tree_samples(train: DataFrame, row_id: Sequence[str], trees: int = TREES,
                 sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """A sample without replacement for every tree: rows tagged with ``tree_id``.

    Each row decides by hashes which trees it joins: how many, about ``2 * trees *
    sample`` over all rows, and which, as every ``step``-th tree from a first one. A row
    joins each tree with the same probability, and no row meets every tree in a join.
    The surplus is cut to the exact size in hash order.
    """
    modulus = 1 << 40
    n = train.agg(F.count("*")).scalar()

    def number(salt: int, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + salt), *row_id), F.lit(below))

    share = F.least(F.lit(float(trees)), F.lit(2.0 * trees * sample) / F.col("_n"))
    joined = F.floor(share + number(0, modulus) / F.lit(float(modulus))).cast("int")
    # a step without a common divisor with the number of trees meets each tree once
    steps = [s for s in range(1, trees + 1) if math.gcd(s, trees) == 1]
    step = F.get(F.split(F.lit(",".join(map(str, steps))), ","),
                 number(1, len(steps)).cast("int")).cast("long")
    order = W.partitionBy("tree_id").orderBy("_r", *row_id)
    return (train.withColumn("_n", n)
            .withColumns({"_joined": joined, "_first": number(2, trees), "_step": step})
            .filter("_joined > 0")
            .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_joined") - 1)))
            .withColumn("tree_id", F.pmod(F.col("_first") + F.col("_j") * F.col("_step"),
                                          F.lit(trees)).cast("int"))
            .withColumn("_r", F.xxhash64(F.lit(seed + 3), "tree_id", *row_id))
            .withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= sample)
            .drop("_k", "_r", "_n", "_j", "_joined", "_first", "_step"))


def fit_isolation_forest(train: DataFrame, features: Sequence[str],
                         row_id: Sequence[str] = (ASSET, MINUTE), *, trees: int = TREES,
                         sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Fit the forest; returns its nodes (at most ``trees * (2 * sample - 1)`` rows).

    Trees are independent, each grown in its own group from at most ``sample``
    rows: split a random non-constant feature at a uniform point of its range
    until one point, no spread or the height limit is left.
    """
    features = list(features)
    height = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        x = pdf.sort_values(list(row_id))[features].to_numpy(dtype="float64")
        rng = np.random.default_rng([seed, tree])
        nodes, stack = [], [(0, np.arange(len(x)), 0)]
        last = 0
        while stack:
            node, rows, depth = stack.pop()
            part = x[rows]
            spread = (np.flatnonzero(part.max(axis=0) > part.min(axis=0))
                      if len(rows) > 1 and depth < height else [])
            if len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
                continue
            f = int(rng.choice(spread))
            low, high = part[:, f].min(), part[:, f].max()
            cut = rng.uniform(low, high)
            if not low <= cut < high:
                cut = low
            left = part[:, f] <= cut
            nodes.append((tree, node, f, cut, last + 1, last + 2, len(rows), depth))
            stack += [(last + 1, rows[left], depth + 1), (last + 2, rows[~left], depth + 1)]
            last += 2
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    samples = tree_samples(train.select(*row_id, *features), row_id, trees, sample, seed)
    return samples.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)


def score_isolation_forest(df: DataFrame, nodes: DataFrame, features: Sequence[str],
                           name: str = "anomaly_score") -> DataFrame:
    """Add ``2 ** (-mean path / c(sample))``: towards 1 is more abnormal.

    The node table is the model, of a size fixed by its parameters, and travels
    to the executors once as a broadcast; rows are scored in Arrow batches where
    they are, without a shuffle.
    """
    features = list(features)
    model = nodes.orderBy("tree_id", "node_id").toPandas()
    if model.empty:
        raise ValueError("the forest has no nodes: it was fitted on no rows")
    roots, child, tables = [], 0, []
    for _, tree in model.groupby("tree_id", sort=True):
        roots.append(child)
        tables.append(tree.assign(left_id=tree.left_id + child, right_id=tree.right_id + child))
        child += len(tree)
    flat = pd.concat(tables)
    leaf = flat.feature.to_numpy() < 0
    packed = {
        "roots": np.array(roots), "leaf": leaf,
        "feature": np.where(leaf, 0, flat.feature.to_numpy()),
        "threshold": flat.threshold.to_numpy(),
        "left": np.where(leaf, np.arange(child), flat.left_id.to_numpy()),
        "right": np.where(leaf, np.arange(child), flat.right_id.to_numpy()),
        "length": flat.depth.to_numpy() + path_length(flat["size"].to_numpy()),
        "levels": int(flat.depth.max()),
        "norm": float(path_length(flat["size"].to_numpy()[roots].max())),
    }
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for root in m["roots"]:
                at = np.full(len(x), root)
                for _ in range(m["levels"]):
                    right = x[rows, m["feature"][at]] > m["threshold"][at]
                    at = np.where(right, m["right"][at], m["left"][at])
                total += m["length"][at]
            depth = total / len(m["roots"])
            yield pd.Series(np.power(2.0, -depth / m["norm"]) if m["norm"] > 0
                            else np.ones(len(x)))

    return df.withColumn(name, score(F.struct(*features)))


@dataclass(frozen=True)
class AnomalyModel:
    """Everything needed to score, flag and rank new rows.

    ``nodes`` is the forest's table, ``steps`` the distribution of the baseline's scores
    (``percentile_steps``).
    """

    features: tuple[str, ...]
    medians: dict
    scaler: dict
    nodes: DataFrame
    steps: DataFrame
    threshold: float
    baseline_end: datetime

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        constants = [(i, c, self.medians[c], *self.scaler[c]) for i, c in enumerate(self.features)]
        for name, table in (
                ("nodes", self.nodes), ("steps", self.steps),
                ("features", local_table(spark, constants, "position int, feature string, "
                                         "median double, mean double, std double")),
                ("info", local_table(spark, [(self.threshold, self.baseline_end)],
                                     "alert_threshold double, baseline_end timestamp_ntz"))):
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyModel":
        rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
        info = spark.read.parquet(f"{path}/info").first()
        return AnomalyModel(
            tuple(r["feature"] for r in rows), {r["feature"]: r["median"] for r in rows},
            {r["feature"]: (r["mean"], r["std"]) for r in rows},
            spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/steps"),
            info["alert_threshold"], info["baseline_end"])

    def score(self, df: DataFrame, keep: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
        """``keep``, the anomaly score, its percentile in the baseline and its flag for every row."""
        ready = standardize(impute(df.select(*keep, *self.features), self.medians), self.scaler)
        scored = score_isolation_forest(ready, self.nodes, self.features).select(
            *keep, "anomaly_score", flag(F.col("anomaly_score") >= F.lit(self.threshold))
            .alias("anomaly_flag"))
        # the scores are used twice, and scoring is what costs
        path = shared_folder(df.sparkSession, "new-scores")
        scored.write.parquet(path)
        return percentile_of(df.sparkSession.read.parquet(path), self.steps)


def score_threshold(baseline: DataFrame, quantile: float = 0.99,
                    score: str = "anomaly_score") -> DataFrame:
    """Alert threshold: a high quantile of the healthy scores, as one row."""
    return exact_quantiles(baseline, [], score, [quantile]).select(
        F.col("quantiles")[0].alias("alert_threshold"))


def flag_anomalies(df: DataFrame, threshold: DataFrame, score: str = "anomaly_score",
                   name: str = "anomaly_flag") -> DataFrame:
    return (df.withColumn("_t", threshold.select("alert_threshold").scalar())
            .withColumn(name, flag(F.col(score) >= F.col("_t"))).drop("_t"))


def baseline_percentile(df: DataFrame, is_baseline: str, score: str = "anomaly_score",
                        name: str = "anomaly_percentile", digits: int = 2) -> DataFrame:
    """Share of baseline rows that score no higher, in percent, half-even rounded.

    ``is_baseline`` names a 0/1 column.  The steps of the distribution are
    computed once per distinct score and joined back; a score shared by very
    many rows is split by adaptive skew handling, as its step is a single row.
    """
    steps = prefix_sums(df.filter(F.col(score).isNotNull()), [], score,
                        {"healthy": F.sum(is_baseline)})
    share = F.col("cum_healthy") / F.when(F.col("total_healthy") > 0,
                                          F.col("total_healthy")) * 100
    steps = steps.select(F.col(score).alias("_s"), F.bround(share, digits).alias(name))
    return df.join(steps, F.col(score) == F.col("_s"), "left").drop("_s")


def percentile_steps(baseline: DataFrame, score: str = "anomaly_score",
                     buckets: int = STEP_BUCKETS) -> DataFrame:
    """The baseline's distribution of scores as a table: score, share, bucket, low, before.

    One row per distinct score with the share (in percent) of baseline rows that score no higher. The
    steps are cut into ranges of about equal size; ``low`` is where a step's range begins and ``before``
    the share below it. NULL scores do not count.
    """
    sums = prefix_sums(baseline.filter(F.col(score).isNotNull()), [], score,
                       {"rows": F.count("*")})
    steps = sums.select(F.col(score).alias("score"),
                        (F.col("cum_rows") / F.col("total_rows") * 100).alias("share"))
    path = shared_folder(baseline.sparkSession, "steps")
    steps.write.parquet(path)
    steps = baseline.sparkSession.read.parquet(path)
    cuts = steps.agg(F.array_distinct(F.percentile_approx(
        "score", [i / buckets for i in range(1, buckets)], 10 * buckets)).alias("cuts")).scalar()
    ranged = steps.withColumn("_cuts", cuts).withColumn(
        "bucket", below(F.col("_cuts"), F.col("score"), buckets)).drop("_cuts")
    starts = ranged.groupBy("bucket").agg(F.min("score").alias("low"), F.max("share").alias("_most"))
    order = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row per bucket
    starts = starts.select("bucket", "low", F.coalesce(F.max("_most").over(order), F.lit(0.0))
                           .alias("before"))
    return ranged.join(F.broadcast(starts), "bucket")


def percentile_of(df: DataFrame, steps: DataFrame, score: str = "anomaly_score",
                  name: str = "anomaly_percentile", digits: int = 2) -> DataFrame:
    """The share of the baseline that scores no higher than each row, by an as-of join.

    A row meets the greatest step that is not above it. Rows are reduced to distinct scores, dealt to
    the ranges in which the steps lie and walked along with them in order; whatever the size
    of either side, a range holds a small share of both. Scores below all steps get 0, NULL
    stays NULL; without any step the result is NULL.
    """
    ranges = steps.groupBy("bucket").agg(F.first("low").alias("low"),
                                         F.first("before").alias("before"))
    # a row per bucket: their number is fixed
    lows = settle(ranges).agg(F.array_sort(F.collect_list(F.struct("low", "bucket", "before")))
                      .alias("ranges")).scalar()
    wanted = df.filter(F.col(score).isNotNull()).select(F.col(score).alias("score")).distinct()
    met = wanted.withColumn("_ranges", lows).withColumn("_range", F.get("_ranges", F.size(F.filter(
        "_ranges", lambda r: r["low"] <= F.col("score"))) - 1))
    fresh = met.filter(F.col("_range").isNotNull()).select(
        F.col("_range.bucket").alias("bucket"), "score", F.lit(None).cast("double").alias("share"),
        F.lit(1).alias("new"))
    known = steps.select("bucket", "score", "share", F.lit(0).alias("new"))
    along = W.partitionBy("bucket").orderBy("score", "new").rowsBetween(W.unboundedPreceding, 0)
    found = (known.unionByName(fresh)
             .withColumn("share", F.last("share", ignorenulls=True).over(along))
             .filter("new = 1").select(F.col("score").alias("_s"), "share"))
    below_all = F.when(F.col(score).isNotNull() & (F.size("_ranges") > 0), F.lit(0.0))
    return (df.join(found, F.col(score) == F.col("_s"), "left").withColumn("_ranges", lows)
            .withColumn(name, F.bround(F.coalesce("share", below_all), digits))
            .drop("_s", "share", "_ranges"))


def attach_scores(features: DataFrame, scores: DataFrame,
                  keys: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
    """Scores beside the features; rows that were not scored keep NULLs."""
    return features.join(scores.select(*keys, "anomaly_score", "anomaly_percentile",
                                       "anomaly_flag"), list(keys), "left")


def _with_median(stats: DataFrame, rows: DataFrame, keys: Sequence[str],
                 few_keys: bool = False) -> DataFrame:
    medians = exact_median(rows, keys, "anomaly_percentile", "median_percentile", few_keys)
    return stats.join(medians, list(keys), "left")


def anomaly_by_period(scored: DataFrame) -> DataFrame:
    """Normal operation against the day before a failure."""
    rows = (scored.filter(F.col("eligible_for_model") == 1)
            .select(period_column().alias("period"), "anomaly_score", "anomaly_percentile",
                    "anomaly_flag"))
    stats = rows.groupBy("period").agg(
        F.count("*").alias("rows"), F.avg("anomaly_score").alias("mean_anomaly_score"),
        (F.avg("anomaly_flag") * 100).alias("anomaly_rate"))
    return _with_median(stats, rows, ["period"], few_keys=True)


def anomaly_by_horizon(scored: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """Alert rate inside each risk window; horizons without rows do not appear."""
    rows = (scored.filter(F.col("eligible_for_model") == 1)
            .unpivot(["anomaly_percentile", "anomaly_flag"], list(targets.values()),
                     "horizon", "positive")
            .filter(F.col("positive") == 1))
    stats = rows.groupBy("horizon").agg(
        F.count("*").alias("rows"), (F.avg("anomaly_flag") * 100).alias("alert_rate"))
    return _with_median(stats, rows, ["horizon"], few_keys=True)


def anomaly_by_event(scored: DataFrame, failures: DataFrame, hours: float = 24,
                     keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Scores in the window before each failure; failures without rows do not appear."""
    ids = [*keys, "event_id", "failure_type"]
    rows = match_intervals(
        scored.select(*keys, MINUTE, "anomaly_percentile", "anomaly_flag"),
        lookback_windows(failures.select(*ids, "start_time"), hours),
        "window_start", "start_time", keys=keys)
    stats = rows.groupBy(*ids).agg(
        F.count("*").alias("rows"), (F.avg("anomaly_flag") * 100).alias("alert_rate"),
        F.max("anomaly_percentile").alias("max_percentile"))
    return _with_median(stats, rows, ids)


def baseline_alert_rate(scored: DataFrame, condition) -> DataFrame:
    return scored.filter(condition).agg(
        F.count("*").alias("baseline_rows"),
        (F.avg("anomaly_flag") * 100).alias("baseline_alert_rate"))
