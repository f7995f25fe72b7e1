"""Boosted trees and forests against plain numpy on a few hundred rows."""

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from conftest import at
from gaugeflow.operators import models, trees
from gaugeflow.session import local_table, shared_folder

FEATURES = ("a", "b", "c", "d", "e")


def data(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, len(FEATURES))).astype(float)
    y = ((x[:, 0] > 6) ^ (x[:, 1] > 4) | (rng.random(n) < 0.1)).astype(int) * (rng.random(n) < 0.7)
    return x, y.astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data()
    return local_table(spark, [(0, at(i), *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                       "asset_id int, minute_timestamp timestamp_ntz, "
                       + ", ".join(f"{c} double" for c in FEATURES) + ", y int").cache()


@pytest.fixture(scope="module")
def block(spark, rows):
    cuts = trees.fit_cuts(rows, FEATURES, 255)
    (found,) = trees.as_blocks(rows, FEATURES, "y", ("asset_id", "minute_timestamp"), cuts).collect()
    return found, cuts


def plain_tree(x, g, h, columns, cuts, model):
    """Splits in order, by trying every cut of every column on every open node."""
    def score(i):
        return g[i].sum() ** 2 / (h[i].sum() + model.penalty)

    def best(i):
        found = None
        for f in columns:
            for cut in cuts[f]:
                left, right = i[x[i, f] <= cut], i[x[i, f] > cut]
                if min(len(left), len(right)) < max(1, model.minInstancesPerNode) or min(
                        h[left].sum(), h[right].sum()) < model.minHessian:
                    continue
                gain = score(left) + score(right) - score(i)
                if gain > 1e-6 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, cut, left, right)
        return found

    open_nodes, leaves = [(0, np.arange(len(x)))], []
    while open_nodes:
        known = [(best(i), d, i) for d, i in open_nodes]
        if model.maxLeaves:
            able = [k for k in known if k[0]]
            if not able or len(known) >= model.maxLeaves:
                return [i for _, _, i in known]
            take = max(able, key=lambda k: k[0][0])
            open_nodes = [(d, i) for b, d, i in known if i is not take[2]]
            open_nodes += [(take[1] + 1, take[0][3]), (take[1] + 1, take[0][4])]
        else:
            open_nodes = []
            for b, d, i in known:
                if b is None or d == model.maxDepth:
                    leaves.append(i)
                else:
                    open_nodes += [(d + 1, b[3]), (d + 1, b[4])]
    return leaves


def plain_boosting(x, y, row, cuts, model):
    margin = np.zeros(len(y))
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for t in range(model.maxIter):
        columns = trees.drawn_features(x.shape[1], max(1, int(model.columnRate * x.shape[1])),
                                       model.seed, t)
        drawn = trees.uniform(row, model.seed * 1_000_003 + t + 1) < model.subsamplingRate
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y) * drawn, weight * p * (1 - p) * drawn
        full = np.flatnonzero(drawn)
        step = np.zeros(len(y))
        found = plain_tree(x[full], g[full], h[full], columns, cuts, model)
        for leaf in found:
            value = -model.stepSize * g[full][leaf].sum() / (h[full][leaf].sum() + model.penalty)
            step[full[leaf]] = value
        yield full, margin[full] + step[full], len(found)
        # rows that were not drawn move too: by the leaf they fall into, which needs the splits
        if len(full) < len(y):
            return
        margin = margin + step


@pytest.mark.parametrize("settings", [
    {"maxDepth": 3}, {"maxLeaves": 6, "penalty": 0.0, "minHessian": 1e-3, "minInstancesPerNode": 20},
    {"maxLeaves": 31, "penalty": 0.0, "minHessian": 1e-3, "minInstancesPerNode": 5},
    {"maxDepth": 4, "subsamplingRate": 0.6, "columnRate": 0.6}])
def test_boosting_equals_brute_force(block, settings):
    found, cuts = block
    values = np.stack([np.append(c, np.inf)[found.bins[:, f]] for f, c in enumerate(cuts)], 1)
    model = trees.Boosting(maxIter=4, stepSize=0.3, **settings)
    grown = model.grow(trees.LocalBlocks([found]), len(FEATURES))
    steps = [(t.packed(), np.array([model._value(s) for s in t.sums])) for t in grown]
    for n, (rows, margin, leaves) in enumerate(plain_boosting(
            values, found.label.astype(int), found.row, cuts, model), 1):
        mine = trees.moved(found, steps[:n]).margin[rows]
        assert np.allclose(mine, margin, atol=1e-9)
        assert sum(f < 0 for f in grown[n - 1].feature) == leaves


def test_leafwise_trees_have_31_leaves_and_the_loss_falls(block):
    found, _ = block
    model = trees.Boosting(maxIter=12, maxLeaves=31, penalty=0.0, minHessian=1e-3,
                           minInstancesPerNode=2)
    grown = model.grow(trees.LocalBlocks([found]), len(FEATURES))
    assert {sum(f < 0 for f in t.feature) for t in grown} == {31}
    assert max(max(t.depth) for t in grown) > 5  # not a full tree of depth 5
    y, loss = found.label, []
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    steps = [(t.packed(), np.array([model._value(s) for s in t.sums])) for t in grown]
    for n in range(len(steps) + 1):
        margin = trees.moved(found, steps[:n]).margin
        loss.append((weight * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum())
    assert all(b < a for a, b in zip(loss, loss[1:]))


def test_columns_are_drawn_once_per_tree(block):
    found, _ = block
    grown = trees.Boosting(maxIter=6, maxDepth=5, columnRate=0.4).grow(
        trees.LocalBlocks([found]), len(FEATURES))
    for t, tree in enumerate(grown):
        assert set(tree.feature) - {-1} <= set(trees.drawn_features(5, 2, 42, t).tolist())


def test_bootstrap_weights_equal_brute_force(block):
    found, _ = block
    forest = trees.Forest(numTrees=9)
    counts = forest.class_counts(trees.LocalBlocks([found]))
    weights = forest.balanced(counts)
    for t in range(9):
        times = trees.bootstrap_counts(found.row, t, 42)
        labels = np.repeat(found.label, times)
        n = [(labels == c).sum() for c in (0, 1)]
        assert counts[t].tolist() == n
        assert weights[t] == pytest.approx([len(labels) / (2 * c) for c in n])
    assert len({tuple(w) for w in weights}) > 1
    many = trees.bootstrap_counts(np.arange(100_000, dtype=np.uint64), 3, 42)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.03
    assert forest.balanced(np.array([[7.0, 0.0]])).tolist() == [[1.0, 0.0]]


def test_forest_leaves_are_pure_or_small(block):
    found, _ = block
    forest = trees.Forest(numTrees=5, maxDepth=20, minInstancesPerNode=3)
    for t, tree in enumerate(forest.grow(trees.LocalBlocks([found]), len(FEATURES))):
        times = trees.bootstrap_counts(found.row, t, 42)
        weight = forest.balanced(forest.class_counts(trees.LocalBlocks([found])))[t]
        at_leaf = tree.packed().nodes(found.bins)
        for leaf in np.unique(at_leaf):
            inside = (at_leaf == leaf) & (times > 0)
            w = times[inside] * weight[found.label[inside]]
            sums = [w[found.label[inside] == c].sum() for c in (0, 1)] + [inside.sum()]
            assert tree.sums[leaf] == pytest.approx(sums) and inside.sum() >= 3


@pytest.mark.parametrize("model", [
    trees.Boosting(maxIter=11, maxLeaves=7, subsamplingRate=0.7, maxBins=64),
    trees.Forest(numTrees=6, maxDepth=6)])
def test_many_tasks_give_the_same_model(spark, rows, block, model, monkeypatch):
    keys = ("asset_id", "minute_timestamp")
    one = model.fit(rows, FEATURES, "y", keys)
    monkeypatch.setattr(trees, "ROWS_PER_BLOCK", 120)
    many = model.fit(rows.repartition(5), FEATURES, "y", keys)
    assert one.nodes[["tree", "node", "feature", "threshold"]].equals(
        many.nodes[["tree", "node", "feature", "threshold"]])
    assert np.allclose(one.nodes["value"], many.nodes["value"], atol=1e-9)


@pytest.mark.parametrize("model", [
    trees.Boosting(maxIter=2, maxLeaves=7), trees.Boosting(maxIter=2, maxDepth=3),
    trees.Forest(numTrees=3, maxDepth=4)])
def test_histograms_of_many_tasks_are_judged_in_tasks(spark, rows, model, monkeypatch):
    judge = trees.best_splits

    def judged(*given):
        assert TaskContext.get() is not None, "a histogram came to the driver"
        return judge(*given)

    monkeypatch.setattr(trees, "ROWS_PER_BLOCK", 120)
    monkeypatch.setattr(trees, "best_splits", judged)
    monkeypatch.setattr(trees, "PIECE_BYTES", 100_000)  # several pieces a pass
    found = model.fit(rows.repartition(5), FEATURES, "y", ("asset_id", "minute_timestamp"))
    assert len(found.nodes) > found.getNumTrees


@pytest.mark.parametrize("model", [trees.Boosting(maxIter=3, maxDepth=3),
                                   trees.Forest(numTrees=3, maxDepth=4)])
def test_tasks_that_report_to_the_driver_do_not_follow_the_rows(spark, rows, model, monkeypatch):
    context, keys = spark.sparkContext, ("asset_id", "minute_timestamp")
    batches = rows.repartition(25).sortWithinPartitions("minute_timestamp").cache()
    batches.count()

    def tasks(rows_per_block):
        monkeypatch.setattr(trees, "ROWS_PER_BLOCK", rows_per_block)
        group = f"blocks-of-{rows_per_block}-{type(model).__name__}"
        context.setJobGroup(group, group)
        try:
            fitted = model.fit(batches, FEATURES, "y", keys)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        status = context.statusTracker()
        return fitted, sum(status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup(group)
                           for s in status.getJobInfo(j).stageIds if status.getStageInfo(s))

    (few, of_few), (many, of_many) = tasks(125), tasks(20)  # 4 and 25 blocks
    assert of_many <= of_few
    assert few.nodes[["tree", "node", "feature", "threshold"]].equals(
        many.nodes[["tree", "node", "feature", "threshold"]])


def test_blocks_hold_all_rows_once_whatever_the_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(trees, "ROWS_PER_BLOCK", 60)
    cuts = trees.fit_cuts(rows, FEATURES, 255)
    seen = set()
    for parts in (rows.repartition(25), rows.coalesce(1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
        try:
            blocks = trees.as_blocks(parts, FEATURES, "y", ("asset_id", "minute_timestamp"), cuts)
            found = blocks.glom().collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            blocks.unpersist()
        assert len(found) == spark.sparkContext.defaultParallelism and all(found)
        flat = [b for part in found for b in part]
        assert len(flat) > len(found) and max(len(b.label) for b in flat) <= 60
        keys = np.concatenate([b.row for b in flat])
        assert len(keys) == rows.count() == len(set(keys.tolist()))
        seen.add(frozenset(zip(keys.tolist(), map(bytes, np.concatenate([b.bins for b in flat])),
                               np.concatenate([b.label for b in flat]).tolist())))
    assert len(seen) == 1


def test_rows_of_one_block_need_no_job_per_pass(spark):
    rows = spark.range(60_000, numPartitions=2).select(
        "id", *[(F.xxhash64("id", F.lit(c)) % 9).cast("double").alias(c) for c in FEATURES]
    ).withColumn("y", (F.col("a") * F.col("b") > 8).cast("int"))
    context, group = spark.sparkContext, "one-block"
    context.setJobGroup(group, group)
    try:
        model = trees.Boosting(maxIter=3, maxLeaves=31, penalty=0.0, minHessian=1e-3,
                               minInstancesPerNode=20).fit(rows, FEATURES, "y", ("id",))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert model.getNumTrees == 3
    assert len(context.statusTracker().getJobIdsForGroup(group)) <= 8


@pytest.mark.parametrize("tasks", [1, 4, 16])
def test_tasks_that_share_a_forest_give_the_same_model(rows, tasks, monkeypatch):
    keys = ("asset_id", "minute_timestamp")
    forest = trees.Forest(numTrees=6, maxDepth=6)
    one = forest.fit(rows, FEATURES, "y", keys)
    monkeypatch.setattr(trees, "FOREST_TASKS", tasks)
    assert one.nodes.equals(forest.fit(rows, FEATURES, "y", keys).nodes)


@pytest.mark.parametrize("spec", [models.GBT_LEAFWISE.with_params(maxIter=5),
                                  models.RANDOM_FOREST.with_params(numTrees=5)])
def test_ensembles_survive_saving_and_score_new_rows(spark, rows, spec):
    fitted = models.fit_model(rows, FEATURES, "6h", "y", spec)
    path = shared_folder(spark, "model")
    models.save_model(spark, fitted, path, 0.5)
    again, threshold = models.load_model(spark, path)
    fresh = rows.withColumn("a", F.when(F.col("a") < 9, F.col("a") + 0.25)).withColumn(
        "b", F.lit(1e9)).limit(40)
    first = models.score_model(fresh, fitted).orderBy("minute_timestamp").collect()
    assert threshold == 0.5 and len(first) == 40
    assert first == models.score_model(fresh, again).orderBy("minute_timestamp").collect()
    both = models.score_models(fresh, [again, models.fit_model(
        rows, FEATURES, "6h", "y", models.LOGISTIC.with_params(maxIter=5))])
    assert both.filter(F.col("model") == spec.name).orderBy("minute_timestamp").select(
        "failure_probability").collect() == [r[-1:] for r in first]
    assert all(0 <= r["failure_probability"] <= 1 for r in first)


def test_full_settings():
    for spec, kind, wanted in (
            (models.RANDOM_FOREST, trees.Forest, {"numTrees": 500, "maxDepth": 14,
                                                  "minInstancesPerNode": 5}),
            (models.GBT_DEPTHWISE, trees.Boosting, {"maxIter": 500, "maxDepth": 6, "maxLeaves": 0}),
            (models.GBT_LEAFWISE, trees.Boosting, {"maxIter": 500, "maxLeaves": 31})):
        model = spec.trees()
        assert isinstance(model, kind)
        assert {k: getattr(model, k) for k in wanted} == wanted
