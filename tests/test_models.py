from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at
from gaugeflow.operators import attribution, models, prep
from gaugeflow.session import local_table, shared_folder

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3)) * [1, 10, 0.1]
    y = (x[:, 0] + x[:, 1] / 10 + rng.normal(size=600) > 1.0).astype(int)
    data = [(0, at(i), *(None if (i + j) % 50 == 0 else float(v) for j, v in enumerate(r)), int(t),
             "train" if i < 400 else "test") for i, (r, t) in enumerate(zip(x, y))]
    return local_table(spark, data, "asset_id int, minute_timestamp timestamp_ntz, a double, "
                                    "b double, c double, y int, split string").cache()


def test_balanced_logistic_regression(spark, rows):
    train = rows.filter("split = 'train'")
    fitted = models.fit_model(train, FEATURES, "6h", "y", models.LOGISTIC.with_params(maxIter=60))
    out = models.score_model(rows.filter("split = 'test'"), fitted).collect()
    assert len(out) == 200 and all(0 < r["failure_probability"] < 1 for r in out)
    hit = np.mean([r["failure_probability"] for r in out if r["actual"]])
    miss = np.mean([r["failure_probability"] for r in out if not r["actual"]])
    assert hit > miss + 0.2

    # penalised, class-weighted optimum: the gradient of the objective vanishes
    ready = fitted.prepare(train).select(*FEATURES, "y").toPandas()
    x, y = ready[list(FEATURES)].to_numpy(), ready["y"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = fitted.model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + fitted.model.intercept)))
    assert np.abs(x.T @ (w * (p - y)) + beta).max() < 0.05


def test_model_survives_saving(spark, rows):
    fitted = models.fit_model(rows.filter("split = 'train'"), FEATURES, "6h", "y",
                              models.LOGISTIC.with_params(maxIter=20))
    path = shared_folder(spark, "model")
    models.save_model(spark, fitted, path, 0.25)
    again, threshold = models.load_model(spark, path)
    assert threshold == 0.25 and again.medians == fitted.medians
    assert (models.score_model(rows, again).collect() == models.score_model(rows, fitted).collect())


def test_horizon_without_positives_is_skipped(spark, rows):
    data = rows.withColumn("never", F.lit(0))
    fitted, predictions = models.train_and_score(
        data, FEATURES, {"6h": "y", "12h": "never"},
        [models.GBT_DEPTHWISE.with_params(maxIter=2), models.GBT_LEAFWISE.with_params(maxIter=2)])
    assert [f.horizon for f in fitted] == ["6h", "6h"]
    assert predictions.groupBy("model").count().count() == 2
    assert [r["horizon"] for r in prep.class_weights(
        data, {"6h": "y", "12h": "never"}).collect()] == ["6h"]


def conditional(tree, x, known, node=0):
    """Expectation of one tree when only some features are known."""
    n = tree[node]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        child = n["left"] if x[n["feature"]] <= n["cut"] else n["right"]
        return conditional(tree, x, known, child)
    return sum(tree[c]["weight"] * conditional(tree, x, known, c)
               for c in (n["left"], n["right"])) / n["weight"]


def test_tree_attribution_equals_shapley_values(spark, rows):
    fitted = models.fit_model(rows.filter("split = 'train'"), FEATURES, "6h", "y",
                              models.RANDOM_FOREST.with_params(numTrees=4, maxDepth=5))
    leaves = attribution.forest_leaves(fitted.model, spark).cache()
    ids = ("asset_id", "minute_timestamp")
    window = fitted.prepare(rows.filter("split = 'test'")).limit(12).cache()
    out = attribution.tree_attribution(window, leaves, FEATURES, ids, 4).collect()
    split = attribution.tree_attribution(window, leaves, FEATURES, ids, 4, max_entries=1).collect()

    forest = {}
    for n in fitted.model.table(spark).collect():
        forest.setdefault(n["tree"], {})[n["node"]] = {
            "left": n["left"], "right": n["right"], "feature": n["feature"],
            "weight": n["cover"], "cut": n["threshold"], "value": n["value"]}
    found = {(r["minute_timestamp"], r["feature"]): r["attribution"] for r in out}
    parts = {(r["minute_timestamp"], r["feature"]): r["attribution"] for r in split}
    base = attribution.expected_value(leaves, 4).first()[0]
    chance = {r["minute_timestamp"]: r["failure_probability"]
              for r in models.score_model(window, fitted).collect()}
    for row in window.collect():
        x = [row[c] for c in FEATURES]
        for f, name in enumerate(FEATURES):
            others = [g for g in range(3) if g != f]
            expected = np.mean([sum(
                factorial(k) * factorial(2 - k) / 6
                * (conditional(t, x, {*s, f}) - conditional(t, x, set(s)))
                for k in range(3) for s in combinations(others, k)) for t in forest.values()])
            assert found[row["minute_timestamp"], name] == pytest.approx(expected, abs=1e-9)
            assert parts[row["minute_timestamp"], name] == pytest.approx(expected, abs=1e-9)
        total = sum(found[row["minute_timestamp"], c] for c in FEATURES)
        assert base + total == pytest.approx(chance[row["minute_timestamp"]], abs=1e-9)
