"""Why a model raised its risk: attributions, importance and first alerts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gaugeflow.config import ASSET, MINUTE
from gaugeflow.functions.expr import hours_between
from gaugeflow.operators.intervals import match_intervals
from gaugeflow.operators.labels import lookback_windows, merged_lookbacks

# Leaf entries sent to the executors at once; larger forests go in blocks of trees.
BROADCAST_ENTRIES = 2_000_000


def explanation_window(rows: DataFrame, failures: DataFrame, hours: float,
                       keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Rows in the hours before any failure, each once."""
    return match_intervals(rows, merged_lookbacks(failures, hours, keys), "window_start",
                           "start_time", keys=keys).drop("window_start", "start_time")


def linear_attribution(scaled: DataFrame, background: DataFrame,
                       coefficients: Mapping[str, float], ids: Sequence[str]) -> DataFrame:
    """weight * (value - background mean) in log-odds, one row per row and feature.

    ``scaled`` and ``background`` hold standardised features; the background
    mean is taken over all of its rows.
    """
    features = list(coefficients)
    means = background.agg(F.struct(*[F.avg(c).alias(c) for c in features]).alias("m"))
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("feature_value"),
                 (F.lit(float(coefficients[c])) * (F.col(c) - F.col("_m")[c]))
                 .alias("attribution")) for c in features])
    return (scaled.withColumn("_m", means.scalar())
            .select(*ids, F.inline(entries)))


LEAF_SCHEMA = ("tree_id int, leaf int, value double, features array<int>, "
               "low array<double>, high array<double>, cover array<double>")


def forest_leaves(model, spark) -> DataFrame:
    """One row per leaf of a random forest: its box, value and cover shares.

    A leaf's path is merged per feature into an interval ``low < x <= high`` and the share of
    training weight that the splits on that feature let through.
    """
    nodes = model.table(spark)

    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf.set_index("node")
        out, stack = [], [(0, {})]
        while stack:
            i, box = stack.pop()
            n = node.loc[i]
            if n["left"] < 0:
                used = sorted(box)
                out.append((int(n["tree"]), i, n["value"], used,
                            [box[f][0] for f in used], [box[f][1] for f in used],
                            [box[f][2] for f in used]))
                continue
            f, cut = int(n["feature"]), float(n["threshold"])
            low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((int(n["left"]), (low, min(high, cut))),
                                  (int(n["right"]), (max(low, cut), high))):
                part = node.at[child, "cover"] / n["cover"]
                stack.append((child, {**box, f: (*bounds, share * part)}))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEAF_SCHEMA.split(", ")])

    return nodes.groupBy("tree").applyInPandas(paths, LEAF_SCHEMA)


def _leaf_shapley(x: np.ndarray, leaves: list[tuple], trees: int) -> np.ndarray:
    """Sum of the leaves' Shapley values, rows x features.

    With ``o`` telling whether the row satisfies a feature's interval and ``z``
    the cover share, a leaf of value v gives feature f
    ``v * (o_f - z_f) * integral over t of prod_{j != f} ((1 - t) z_j + t o_j)``;
    the integrand is a polynomial, so Gauss-Legendre nodes make it exact.
    """
    phi = np.zeros_like(x)
    for value, used, low, high, cover in leaves:
        d = len(used)
        if d == 0 or value == 0:
            continue
        nodes, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
        t = (nodes + 1) / 2
        part = x[:, used]
        inside = ((part > low) & (part <= high)).astype("float64")
        terms = (1 - t) * cover[:, None] + inside[:, :, None] * t
        rest = terms.prod(axis=1, keepdims=True) / terms
        phi[:, used] += (inside - cover) * (rest @ (weights / 2)) * (value / trees)
    return phi


def tree_attribution(rows: DataFrame, leaves: DataFrame, features: Sequence[str],
                     ids: Sequence[str], trees: int,
                     max_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Path-dependent tree attributions in probability space, long layout.

    Rows stay where they are; blocks of trees of a bounded size are broadcast,
    and the parts of several blocks are added up.
    """
    spark, features = rows.sparkSession, list(features)
    sizes = (leaves.groupBy("tree_id").agg(F.sum(F.size("features") + 1).alias("entries"))
             .orderBy("tree_id").collect())
    blocks, filled = [[]], 0
    for tree in sizes:
        if blocks[-1] and filled + tree["entries"] > max_entries:
            blocks.append([])
            filled = 0
        blocks[-1].append(tree["tree_id"])
        filled += tree["entries"]

    schema = (rows.select(*ids).schema.add("feature", "string").add("feature_value", "double")
              .add("attribution", "double"))
    parts = []
    for block in blocks:
        table = leaves.filter(F.col("tree_id").isin(block)).toPandas()
        shared = spark.sparkContext.broadcast([
            (r.value, list(r.features), np.array(r.low), np.array(r.high), np.array(r.cover))
            for r in table.itertuples()])

        def explain(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[features].to_numpy(dtype="float64")
                out = pdf[list(ids)].loc[pdf.index.repeat(len(features))].reset_index(drop=True)
                out["feature"] = np.tile(features, len(pdf))
                out["feature_value"] = x.ravel()
                out["attribution"] = _leaf_shapley(x, shared.value, trees).ravel()
                yield out

        parts.append(rows.select(*ids, *features).mapInPandas(explain, schema))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    if len(parts) == 1:
        return total
    return total.groupBy(*ids, "feature").agg(F.first("feature_value").alias("feature_value"),
                                              F.sum("attribution").alias("attribution"))


def expected_value(leaves: DataFrame, trees: int) -> DataFrame:
    """Mean prediction of the forest over its training cover: the attribution base."""
    share = F.aggregate("cover", F.lit(1.0), lambda a, z: a * z)
    return leaves.agg((F.sum(F.col("value") * share) / trees).alias("base_value"))


def importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution of each feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def top_features(attributions: DataFrame, k: int = 12) -> DataFrame:
    return importance(attributions).orderBy(F.desc("mean_abs"), "feature").limit(k)


def first_alerts(alerts: DataFrame, failures: DataFrame, hours: float,
                 keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """The earliest alert row before each failure, with probability and lead."""
    raised = alerts.filter(F.col("alert") == 1).select(
        *keys, MINUTE, "failure_probability", "alert_threshold")
    matched = match_intervals(
        raised, lookback_windows(failures.select(*keys, "event_id", "start_time"), hours),
        "window_start", "start_time", keys=keys)
    return (matched.groupBy(*keys, "event_id", "start_time")
            .agg(F.min(MINUTE).alias("alert_timestamp"),
                 F.min_by("failure_probability", MINUTE).alias("failure_probability"),
                 F.min_by("alert_threshold", MINUTE).alias("threshold"))
            .withColumn("hours_before_failure", hours_between("alert_timestamp", "start_time"))
            .drop("start_time"))


def first_alert_explanation(attributions: DataFrame, alerts: DataFrame,
                            keys: Sequence[str] = (ASSET,)) -> DataFrame:
    """Attributions of the first-alert row of each failure, with the alert beside them."""
    at = alerts.withColumnRenamed("alert_timestamp", MINUTE)
    return (attributions.join(at, [*keys, MINUTE])
            .withColumn("absolute_impact", F.abs("attribution"))
            .withColumnRenamed(MINUTE, "alert_timestamp"))


ALERT_IDS = (ASSET, "event_id", "alert_timestamp")


def top_drivers(explanation: DataFrame, ids: Sequence[str] = ALERT_IDS, k: int = 3) -> DataFrame:
    """The k strongest features of each alert as columns; ties by feature name.

    Each group holds one row per listed feature.
    """
    order = W.partitionBy(*ids).orderBy(F.desc("absolute_impact"), "feature")
    ranked = explanation.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return ranked.groupBy(*ids).agg(*[
        F.max(F.when(F.col("_r") == i, F.col("feature"))).alias(f"top_driver_{i}")
        for i in range(1, k + 1)])


def explanation_summary(explanation: DataFrame, model: str, ids: Sequence[str] = ALERT_IDS,
                        k: int = 3) -> DataFrame:
    """One row per explained alert: model, lead, probability, threshold and top drivers."""
    facts = explanation.groupBy(*ids).agg(*[
        F.max(c).alias(c) for c in ("hours_before_failure", "failure_probability", "threshold")])
    return (facts.withColumn("model", F.lit(model))
            .join(top_drivers(explanation, ids, k), list(ids)))
