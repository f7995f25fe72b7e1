import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at
from gaugeflow.operators import anomaly, metrics, monitoring, prep
from gaugeflow.session import local_table, shared_folder

PREDICTION = ("asset_id int, minute_timestamp timestamp_ntz, horizon string, model string, "
              "actual int, failure_probability double")


def predictions(spark, scores, actual, model="m"):
    return local_table(spark, [(0, at(i), "6h", model, int(y), float(s))
                               for i, (s, y) in enumerate(zip(scores, actual))], PREDICTION)


def brute_force(scores, actual):
    s, y = np.array(scores), np.array(actual)
    ap, before = 0.0, 0.0
    for cut in sorted(set(scores), reverse=True):
        top = s >= cut
        recall = y[top].sum() / y.sum()
        ap += (recall - before) * y[top].mean()
        before = recall
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    return ap, auc


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(1)
    scores = [rng.randrange(12) / 12 for _ in range(400)]
    actual = [int(rng.random() < 0.2 + 0.3 * s) for s in scores]
    r = metrics.ranking_metrics(predictions(spark, scores, actual)).first()
    ap, auc = brute_force(scores, actual)
    assert math.isclose(r["pr_auc"], ap) and math.isclose(r["roc_auc"], auc)


def test_metrics_without_positives_or_alerts(spark):
    p = predictions(spark, [0.1, 0.2, 0.2], [0, 0, 0])
    r = metrics.ranking_metrics(p).first()
    assert r["pr_auc"] == 0.0 and r["roc_auc"] is None
    limits = local_table(spark, [("6h", "m", 0.9)],
                         "horizon string, model string, alert_threshold double")
    c = metrics.classification_metrics(metrics.apply_threshold(p, limits)).first()
    assert (c["precision"], c["recall"], c["f1"]) == (0.0, 0.0, 0.0)
    assert c["failure_window_alert_percent"] is None and c["false_alert_rate_percent"] == 0.0


def test_score_at_threshold_is_an_alert(spark):
    limits = local_table(spark, [("6h", "m", 0.5)],
                         "horizon string, model string, alert_threshold double")
    out = metrics.apply_threshold(predictions(spark, [0.5, 0.4999], [1, 0]), limits)
    assert [r["alert"] for r in out.orderBy("minute_timestamp").collect()] == [1, 0]


def test_baseline_percentile(spark):
    rows = [(1.0, 1), (2.0, 1), (2.0, 1), (4.0, 1), (0.5, 0), (2.0, 0), (9.0, 0), (3.0, 0)]
    df = local_table(spark, rows, "anomaly_score double, is_healthy int")
    out = {r["anomaly_score"]: r["anomaly_percentile"] for r in
           anomaly.baseline_percentile(df, "is_healthy").collect()}
    assert out == {0.5: 0.0, 1.0: 25.0, 2.0: 75.0, 3.0: 75.0, 4.0: 100.0, 9.0: 100.0}


@pytest.mark.parametrize("buckets", [2, 3, 64])
def test_percentile_of_new_rows(spark, buckets):
    rnd = random.Random(buckets)
    base = [rnd.choice([0.1, 0.5, 0.5, rnd.random()]) for _ in range(300)] + [None]
    fresh = [*base, -1.0, 2.0, 0.1, 0.5, 0.50001, *(rnd.random() for _ in range(200))]
    schema = "row int, anomaly_score double"
    steps = anomaly.percentile_steps(local_table(spark, list(enumerate(base)), schema),
                                     buckets=buckets)
    found = anomaly.percentile_of(local_table(spark, list(enumerate(fresh)), schema), steps)
    assert found.columns == ["row", "anomaly_score", "anomaly_percentile"]
    known = [b for b in base if b is not None]
    assert len(rows := found.collect()) == len(fresh)
    for r in rows:
        expected = None if r.anomaly_score is None else round(
            100 * sum(b <= r.anomaly_score for b in known) / len(known), 2)
        assert r.anomaly_percentile == pytest.approx(expected, abs=0.0051) if expected is not None \
            else r.anomaly_percentile is None
    path = shared_folder(spark, "steps")
    steps.filter("score > 5").write.parquet(path)
    none = spark.read.parquet(path)
    assert {r.anomaly_percentile for r in anomaly.percentile_of(
        local_table(spark, [(1, 0.5)], schema), none).collect()} == {None}


def test_imputation_and_scaling(spark):
    rows = [(1.0, 5.0, None), (None, 5.0, None), (float("inf"), 5.0, None),
            (float("nan"), 5.0, None), (4.0, 5.0, None)]
    df = local_table(spark, rows, "a double, b double, c double")
    medians = prep.fit_medians(df, ["a", "b", "c"])
    assert medians == {"a": 2.5, "b": 5.0, "c": None}
    filled = prep.impute(df, medians)
    assert [r["a"] for r in filled.collect()] == [1.0, 2.5, 2.5, 2.5, 4.0]
    scaler = prep.fit_scaler(filled, ["a", "b"])
    out = prep.standardize(filled, scaler).collect()
    assert {r["b"] for r in out} == {0.0}
    assert math.isclose(np.std([r["a"] for r in out]), 1.0)


def psi_by_hand(base, prod):
    cuts = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    if len(cuts) < 3:
        return 0.0
    bins = lambda x: np.bincount(np.searchsorted(cuts[1:-1], x, side="left"),
                                 minlength=len(cuts) - 1) / len(x)
    e, a = np.maximum(bins(base), 1e-4), np.maximum(bins(prod), 1e-4)
    return float(((a - e) * np.log(a / e)).sum())


def test_drift_against_brute_force(spark):
    rng = np.random.default_rng(5)
    sides = {
        "wide": (rng.normal(0, 1, 400), rng.normal(0.7, 2, 300)),
        "steps": (rng.integers(0, 4, 400) * 1.0, rng.integers(1, 6, 300) * 1.0),
        "constant": (np.full(50, 3.0), rng.normal(3, 1, 60)),
        "same": (np.arange(90.0), np.arange(90.0)),
        "apart": (np.arange(40.0), np.arange(100.0, 140.0)),
    }
    rows = [(side, f, float(v)) for f, (b, p) in sides.items()
            for side, vs in (("baseline", b), ("production", p)) for v in vs]
    rows += [("baseline", "gone", 1.0), ("baseline", "gone", 2.0)]
    values = local_table(spark, rows, "side string, feature string, value double")
    report = {r["feature"]: r for r in monitoring.drift_report(values).collect()}
    for f, (b, p) in sides.items():
        assert math.isclose(report[f]["psi"], psi_by_hand(b, p), rel_tol=1e-9, abs_tol=1e-12), f
        grid = np.concatenate([b, p])
        ks = max(abs((b <= g).mean() - (p <= g).mean()) for g in grid)
        assert math.isclose(report[f]["ks_statistic"], ks, abs_tol=1e-12), f
        assert math.isclose(report[f]["baseline_std"], np.std(b, ddof=1), abs_tol=1e-9)
    assert report["same"]["ks_pvalue"] == 1.0 and report["apart"]["ks_statistic"] == 1.0
    assert report["constant"]["psi"] == 0.0
    assert report["gone"]["psi"] is None and report["gone"]["drift_level"] == "Unknown"


def test_large_sample_pvalue_of_a_published_row(spark):
    row = local_table(spark, [("f", 43055, 26282, 0.0178855)],
                      "feature string, baseline_rows bigint, production_rows bigint, "
                      "ks_statistic double")
    assert monitoring.ks_pvalue(row).first()["ks_pvalue"] == pytest.approx(5.9e-5, rel=0.05)


def test_weeks_start_on_monday(spark):
    sunday = 6 * 1440 + 1439
    rows = local_table(spark, [(0, at(sunday), .5, 50.0, 1), (0, at(sunday + 1), .7, 70.0, 0)],
                       "asset_id int, minute_timestamp timestamp_ntz, anomaly_score double, "
                       "anomaly_percentile double, failure_next_24h int")
    alerts = local_table(spark, [(0, at(sunday), .25, 1)],
                         "asset_id int, minute_timestamp timestamp_ntz, "
                         "failure_probability double, alert int")
    out = monitoring.weekly_monitoring(rows, alerts).orderBy("week_start").collect()
    assert [r["week_start"] for r in out] == [at(0), at(7 * 1440)]
    assert [r["observations"] for r in out] == [1, 1]
    assert [r["alert_rate_percent"] for r in out] == [100.0, None]


def forest_rows(spark, n=900):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(n, 3))
    data[0] = [9, -9, 9]
    return local_table(spark, [(0, at(i), *map(float, r)) for i, r in enumerate(data)],
                       "asset_id int, minute_timestamp timestamp_ntz, a double, b double, c double")


def test_isolation_forest(spark):
    df, features = forest_rows(spark), ["a", "b", "c"]
    nodes = anomaly.fit_isolation_forest(df, features, trees=30, sample=64).cache()
    roots = nodes.filter("node_id = 0").collect()
    assert len(roots) == 30 and {r["size"] for r in roots} == {64}
    assert nodes.agg(F.max("depth")).first()[0] <= 6
    scored = anomaly.score_isolation_forest(df, nodes, features).collect()
    by_tree = {}
    for n in nodes.collect():
        by_tree.setdefault(n["tree_id"], {})[n["node_id"]] = n

    def by_hand(row):
        depth = []
        for tree in by_tree.values():
            n = tree[0]
            while n["feature"] >= 0:
                n = tree[n["right_id"] if row[features[n["feature"]]] > n["threshold"]
                         else n["left_id"]]
            depth.append(n["depth"] + float(anomaly.path_length(n["size"])))
        return 2 ** (-np.mean(depth) / float(anomaly.path_length(64)))

    assert all(math.isclose(r["anomaly_score"], by_hand(r)) for r in scored[:40])
    assert max(scored, key=lambda r: r["anomaly_score"])["minute_timestamp"] == at(0)
    again = anomaly.fit_isolation_forest(df.repartition(7), features, trees=30, sample=64)
    assert sorted(again.collect()) == sorted(nodes.collect())
