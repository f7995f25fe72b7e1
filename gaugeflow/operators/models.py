"""Failure classifiers: fit, score, save and load."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.config import ASSET, MINUTE
from gaugeflow.session import local_table
from gaugeflow.operators.prep import (fit_medians, fit_scaler, impute, standardize,
                                      with_class_weight)
from gaugeflow.operators.trees import (Boosting, Forest, TreeModel, leaf_values,
                                       probability_column)

SEED = 42
ROWS_PER_TASK = 50_000
# models that are trained at the same time: one after the other would leave a cluster idle
# between the many short passes of each
PARALLEL_FITS = 8


@dataclass(frozen=True)
class ModelSpec:
    """How to fit one kind of classifier; ``params`` override the defaults."""

    name: str
    build: Callable
    defaults: dict
    scaled: bool = False
    params: dict = field(default_factory=dict)

    def trees(self):
        return self.build(**{**self.defaults, **self.params})

    def estimator(self, rows: int):
        settings = {**self.defaults, **self.params}
        if settings.get("regParam") == "1/rows":
            # balanced weights sum to the row count, so C = 1 is regParam = 1/rows
            settings["regParam"] = 1.0 / rows
        return self.build(labelCol="label", featuresCol="features", weightCol="class_weight",
                          **settings)

    def with_params(self, **params) -> "ModelSpec":
        return ModelSpec(self.name, self.build, self.defaults, self.scaled,
                         {**self.params, **params})


LOGISTIC = ModelSpec(
    "Logistic Regression", LogisticRegression,
    {"maxIter": 2000, "regParam": "1/rows", "elasticNetParam": 0.0, "standardization": False},
    scaled=True)
RANDOM_FOREST = ModelSpec(
    "Random Forest", Forest,
    {"numTrees": 500, "maxDepth": 14, "minInstancesPerNode": 5, "seed": SEED})
GBT_DEPTHWISE = ModelSpec(
    "Gradient Boosting (depth-wise)", Boosting,
    {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "columnRate": 0.8,
     "penalty": 1.0, "minHessian": 1.0, "seed": SEED})
# leaf-wise growth draws no rows: a share alone has no effect there without a frequency
GBT_LEAFWISE = ModelSpec(
    "Gradient Boosting (leaf-wise)", Boosting,
    {"maxIter": 500, "maxLeaves": 31, "stepSize": 0.05, "columnRate": 0.8, "penalty": 0.0,
     "minHessian": 1e-3, "minInstancesPerNode": 20, "seed": SEED})
MODEL_SPECS = (LOGISTIC, RANDOM_FOREST, GBT_DEPTHWISE, GBT_LEAFWISE)


@dataclass(frozen=True)
class FittedModel:
    """A classifier with everything needed to score new rows."""

    name: str
    horizon: str
    target: str
    features: tuple[str, ...]
    scaled: bool
    model: Model | TreeModel
    medians: dict
    scaler: dict

    def prepare(self, df: DataFrame) -> DataFrame:
        ready = impute(df, self.medians)
        return standardize(ready, self.scaler) if self.scaled else ready


def coefficients(fitted: FittedModel) -> dict[str, float]:
    """The weights of a fitted logistic regression, by feature."""
    return dict(zip(fitted.features, map(float, fitted.model.coefficients.toArray())))


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_preparation(train: DataFrame, features: Sequence[str]) -> tuple[dict, dict]:
    """Training medians, then mean and deviation of the imputed training rows."""
    medians = fit_medians(train, features)
    return medians, fit_scaler(impute(train, medians), features)


def fit_model(train: DataFrame, features: Sequence[str], horizon: str, target: str,
              spec: ModelSpec, prepared: tuple[dict, dict] | None = None,
              keys: Sequence[str] = (ASSET, MINUTE)) -> FittedModel:
    """Fit one classifier on the training split.

    Medians and scaling are fitted on the training rows only.  The rows are kept (on
    disk when memory is short) for the passes of the trainer, in tasks of up to
    ``ROWS_PER_TASK`` rows: a trainer takes thousands of passes, and the start of smaller
    tasks would cost more than their work.  ``keys`` tell rows apart where they are drawn.
    """
    features = tuple(features)
    medians, scaler = prepared or fit_preparation(train, features)
    ready = impute(train.select(*keys, *features, target), medians)
    if spec.scaled:
        ready = standardize(ready, scaler)
    if spec.build in (Boosting, Forest):
        model = spec.trees().fit(ready, features, target, keys)
        return FittedModel(spec.name, horizon, target, features, spec.scaled, model, medians, scaler)
    rows = with_class_weight(ready, target)
    rows = assemble(rows, features).select(
        "features", F.col(target).cast("double").alias("label"), "class_weight")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        model = spec.estimator(n).fit(rows.coalesce(max(1, -(-n // ROWS_PER_TASK))))
    finally:
        rows.unpersist()
    return FittedModel(spec.name, horizon, target, features, spec.scaled, model, medians, scaler)


def score_model(df: DataFrame, fitted: FittedModel,
                keep: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
    """Failure probability of every row in the long prediction layout."""
    extra = [fitted.target] if fitted.target in df.columns else []
    columns = list(dict.fromkeys([*keep, *extra, *fitted.features]))
    ready = fitted.prepare(df.select(*columns))
    if isinstance(fitted.model, TreeModel):
        scored = ready
        chance = probability_column(df.sparkSession, [fitted.model], fitted.features)[0]
    else:
        scored = fitted.model.transform(assemble(ready, fitted.features))
        chance = vector_to_array("probability")[1]
    return scored.select(
        *keep, F.lit(fitted.horizon).alias("horizon"), F.lit(fitted.name).alias("model"),
        *[F.col(c).cast("int").alias("actual") for c in extra],
        chance.alias("failure_probability"))


def score_models(df: DataFrame, fitted: Sequence[FittedModel],
                 keep: Sequence[str] = (ASSET, MINUTE)) -> DataFrame:
    """Predictions of models that share their preparation, in one pass over the rows.

    Linear models add a column each; all tree ensembles share one pass of Arrow batches, and are
    broadcast. The columns then become the rows of the long prediction layout.
    """
    first = fitted[0]
    features, targets = first.features, list(dict.fromkeys(f.target for f in fitted))
    ready = impute(df.select(*dict.fromkeys([*keep, *targets, *features])), first.medians)
    ensembles = [i for i, f in enumerate(fitted) if isinstance(f.model, TreeModel)]
    chances = {i: F.col("_trees")[n] for n, i in enumerate(ensembles)}
    if ensembles:
        ready = ready.withColumn("_trees", probability_column(
            df.sparkSession, [fitted[i].model for i in ensembles], features))
    if len(ensembles) < len(fitted):
        z = {c: f"_z_{c}" for c in features}
        ready = ready.withColumns({name: (F.col(c) - F.lit(first.scaler[c][0]).cast("double"))
                                   / F.lit(first.scaler[c][1] or 1.0) for c, name in z.items()})
        ready = VectorAssembler(inputCols=list(z.values()), outputCol="_scaled").transform(ready)
    for i, f in enumerate(fitted):
        if i in chances:
            continue
        model = f.model.copy().setFeaturesCol("_scaled").setProbabilityCol(f"_p{i}")
        ready = model.setRawPredictionCol("").setPredictionCol("").transform(ready)
        chances[i] = vector_to_array(f"_p{i}")[1]
    entries = F.array(*[F.struct(
        F.lit(f.horizon).alias("horizon"), F.lit(f.name).alias("model"),
        F.col(f.target).cast("int").alias("actual"), chances[i].alias("failure_probability"))
        for i, f in enumerate(fitted)])
    return ready.select(*keep, F.inline(entries))


def fit_models(train: DataFrame, features: Sequence[str],
               wanted: Sequence[tuple[str, str, ModelSpec]], parallel: int = PARALLEL_FITS,
               keys: Sequence[str] = (ASSET, MINUTE)) -> list[FittedModel]:
    """Classifiers for (horizon, target, spec), several at a time, with one preparation for all."""
    prepared = fit_preparation(train, features)
    with ThreadPool(min(parallel, len(wanted))) as pool:
        fit = inheritable_thread_target(train.sparkSession)(
            lambda w: fit_model(train, features, w[0], w[1], w[2], prepared, keys))
        return pool.map(fit, wanted)


def staged_loss(rows: DataFrame, fitted: FittedModel) -> DataFrame:
    """(round, loss): weighted logistic loss of boosted trees after 0, 1, 2, ... trees.

    Positives weigh negatives / positives, as in training. All rounds come from one pass.
    """
    features, target = list(fitted.features), fitted.target
    shared = rows.sparkSession.sparkContext.broadcast(fitted.model.packed())
    ready = fitted.prepare(rows.select(target, *features))

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = batch[target].to_numpy() == 1
            x = batch[features].to_numpy(dtype="float64")
            margin, sign = np.zeros(len(x)), np.where(y, -1.0, 1.0)
            for n, values in enumerate([0.0, *leaf_values(x, shared.value)]):
                margin = margin + values
                loss = np.logaddexp(0, sign * margin)
                yield pd.DataFrame({"round": [n], "positive": [loss[y].sum()],
                                    "negative": [loss[~y].sum()], "n_positive": [int(y.sum())],
                                    "n_negative": [int((~y).sum())]})

    sums = ready.mapInPandas(losses, "round int, positive double, negative double, "
                                     "n_positive long, n_negative long")
    return sums.groupBy("round").agg(
        (F.sum("positive") * F.sum("n_negative") / F.sum("n_positive") + F.sum("negative"))
        .alias("loss"))


def train_and_score(rows: DataFrame, features: Sequence[str], targets: dict[str, str],
                    specs: Sequence[ModelSpec] = MODEL_SPECS,
                    keep: Sequence[str] = (ASSET, MINUTE, "split"),
                    parallel: int = PARALLEL_FITS) -> tuple[list[FittedModel], DataFrame | None]:
    """Every classifier for every horizon; predictions on all splits, one long table.

    ``rows`` carries ``split``.  A horizon without training positives is skipped.
    """
    train = rows.filter(F.col("split") == "train")
    positives = train.agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(h)
                            for h, t in targets.items()]).first()
    wanted = [(h, t, spec) for h, t in targets.items() if positives[h] > 0 for spec in specs]
    if not wanted:
        return [], None
    fitted = fit_models(train, features, wanted, parallel)
    return fitted, score_models(rows, fitted, keep)


def save_model(spark: SparkSession, fitted: FittedModel, path: str,
               threshold: float | None = None, train_end: datetime | None = None,
               calibration_end: datetime | None = None) -> None:
    """Write the classifier, as a table of nodes or by Spark ML, and its constants as Parquet."""
    if isinstance(fitted.model, TreeModel):
        kind = "boosted trees" if fitted.model.boosted else "forest"
        fitted.model.table(spark).write.mode("overwrite").parquet(f"{path}/model")
    else:
        kind = "linear"
        PipelineModel([fitted.model]).write().overwrite().save(f"{path}/model")
    info = [(fitted.name, fitted.horizon, fitted.target, fitted.scaled, kind, threshold, train_end,
             calibration_end)]
    constants = [(i, c, fitted.medians[c], *fitted.scaler[c])
                 for i, c in enumerate(fitted.features)]
    for name, rows, schema in (
            ("info", info, "name string, horizon string, target string, scaled boolean, "
                           "kind string, threshold double, train_end timestamp_ntz, "
                           "calibration_end timestamp_ntz"),
            ("features", constants, "position int, feature string, median double, mean double, "
                                    "std double")):
        local_table(spark, rows, schema).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[FittedModel, float | None]:
    info = spark.read.parquet(f"{path}/info").first()
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    if info["kind"] == "linear":
        model = PipelineModel.load(f"{path}/model").stages[0]
    else:
        model = TreeModel.read(spark.read.parquet(f"{path}/model"), info["kind"] != "forest")
    fitted = FittedModel(
        info["name"], info["horizon"], info["target"], tuple(r["feature"] for r in rows),
        info["scaled"], model,
        {r["feature"]: r["median"] for r in rows},
        {r["feature"]: (r["mean"], r["std"]) for r in rows})
    return fitted, info["threshold"]
