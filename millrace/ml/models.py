"""Training, cross-validating, tuning, stacking and listing MLlib models."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev
from typing import Any

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import evaluation as E
from pyspark.ml import regression as R
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.kinds import as_list, col, require, require_numeric
from ..session import Tables
from . import metrics
from .boost import AdaBoost
from .calibrate import Calibrated
from .checks import scoring_for
from .forest import from_cells
from .knn import KNearest
from .network import on_distinct
from .persist import SavedModel, load_model
from .weights import STANDS_FOR, Scaled, condensed, distinct_rows, every_row, rows_of, takes_distinct

# Models that gain nothing from scaled features (fixed values).
UNSCALED = ("Random Forest", "Decision Tree", "Gradient Boosting", "AdaBoost")

MAX_DEPTH = 30  # the deepest tree MLlib grows


# -- data -------------------------------------------------------------------
def split(df: DataFrame, test: float = 0.2, seed: int = 42, key: str | Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a seeded hash of ``key`` (all columns by default).

    The hash gives every recomputation, on any number of executors, the same split.
    """
    if not 0.1 <= test <= 0.4:
        raise ValueError("the test share must be between 0.1 and 0.4")
    place = _hashed(df, seed, key, 1_000_000)
    cut = round(test * 1_000_000)
    return df.filter(place >= cut), df.filter(place < cut)


def _hashed(df: DataFrame, seed: int, key: str | Iterable[str] | None, buckets: int) -> Column:
    names = as_list(key) or df.columns
    return F.pmod(F.xxhash64(F.lit(seed), *[col(c) for c in names]), F.lit(buckets))


def label_rows(df: DataFrame, target: str, problem: str) -> DataFrame:
    """Adds ``label``: the number itself, or the class's place in sorted order."""
    require(df, target)
    if problem == "regression":
        require_numeric(df, target)
        return df.withColumn("label", col(target).cast("double"))
    text = df.withColumn("_target", col(target).cast("string"))
    indexer = StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc")
    return indexer.fit(text).transform(text).drop("_target")


# -- model lists ------------------------------------------------------------
def classifiers(features: int, classes: int, rows: int, seed: int = 42) -> dict[str, Estimator]:
    """The classification models by name, set for the table's shape."""
    models: dict[str, Estimator] = {
        # Penalty 1/n and no internal scaling: the usual unit-strength ridge penalty.
        "Logistic Regression": C.LogisticRegression(maxIter=1000, regParam=1 / max(rows, 1), standardization=False),
        "Random Forest": C.RandomForestClassifier(numTrees=100, maxDepth=MAX_DEPTH, seed=seed),
        "Decision Tree": C.DecisionTreeClassifier(maxDepth=10, seed=seed),
        "SVM": C.LinearSVC(maxIter=100, regParam=1 / max(rows, 1), standardization=False),
        "Naive Bayes": C.NaiveBayes(modelType="gaussian"),
        "K-Neighbors": KNearest(k=5),
        "Gradient Boosting": C.GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
        "AdaBoost": AdaBoost(rounds=50, seed=seed),
        "Neural Network": C.MultilayerPerceptronClassifier(layers=[features, 100, max(classes, 2)], maxIter=1000, seed=seed),
    }
    if classes > 2:
        for name in ("SVM", "Gradient Boosting"):
            models[name] = C.OneVsRest(classifier=models[name])
    models["SVM"] = Calibrated(models["SVM"], seed=seed)
    return models


def penalized(l1: float, l2: float, label_std: float) -> Estimator:
    """Linear regression minimising MSE / 2 + l1 * |w| + l2 / 2 * |w|^2.

    MLlib divides the squared penalty by the label's deviation; undo that.
    """
    squared = l2 * label_std
    strength = l1 + squared
    return R.LinearRegression(regParam=strength, elasticNetParam=l1 / strength if strength else 0.0, standardization=False)


def regressors(rows: int, label_std: float = 1.0, seed: int = 42) -> dict[str, Estimator]:
    """The regression models by name; ridge strength 1, lasso and elastic net 0.1."""
    return {
        "Linear Regression": penalized(0.0, 0.0, label_std),
        "Ridge Regression": penalized(0.0, 1 / max(rows, 1), label_std),
        "Lasso Regression": penalized(0.1, 0.0, label_std),
        "ElasticNet": penalized(0.05, 0.05, label_std),
        "Random Forest": R.RandomForestRegressor(numTrees=100, maxDepth=MAX_DEPTH, seed=seed),
        "Decision Tree": R.DecisionTreeRegressor(maxDepth=10, seed=seed),
        "K-Neighbors": KNearest(k=5, problem="regression"),
        "Gradient Boosting": R.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
    }


def needs_scaling(name: str) -> bool:
    return not any(n in name for n in UNSCALED)


def pipeline(name: str, estimator: Estimator, features: Iterable[str], scale: bool = True) -> Pipeline:
    """Assemble, scale only where the model needs it, then the model.

    Scaling is a stage of the pipeline, so every fold fits its own. Models that take
    weights are fitted on distinct rows, forests on cells and networks on distinct rows where these are few.
    """
    stages: list[Any] = [VectorAssembler(inputCols=as_list(features), outputCol="_assembled" if scale and needs_scaling(name) else "features")]
    if scale and needs_scaling(name):
        stages.append(Scaled(StandardScaler(inputCol="_assembled", outputCol="features", withMean=True, withStd=True)))
    return Pipeline(stages=[*stages, on_distinct(from_cells(condensed(estimator)))])


# -- evaluation -------------------------------------------------------------
def evaluator(scoring: str) -> E.Evaluator:
    if scoring == "roc_auc":
        return E.BinaryClassificationEvaluator(metricName="areaUnderROC")
    if scoring == "f1_weighted":
        return E.MulticlassClassificationEvaluator(metricName="f1")
    if scoring == "accuracy":
        return E.MulticlassClassificationEvaluator(metricName="accuracy")
    if scoring == "r2":
        return E.RegressionEvaluator(metricName="r2")
    raise ValueError(f"unknown scoring {scoring!r}")


def out_of_fold(
    models: Mapping[str, Estimator], df: DataFrame, tables: Tables, folds: int = 5, seed: int = 42, key: str | Iterable[str] | None = None, parallelism: int = 8
) -> DataFrame:
    """(model, fold, label, prediction, score): every row scored by models fitted on the other folds.

    All models share one fold column, a seeded hash of ``key``. ``score`` is the raw
    prediction of the second of two classes, NULL for models without one. The fits run
    side by side, and each writes its rows into ``tables``.
    """
    return every_row(_scored_folds(models, df, tables, folds, seed, key, parallelism))


def _features(models: Iterable[Estimator]) -> list[str] | None:
    """What pipelines of ``pipeline`` read beside the label; None if there are others."""
    names: list[str] = []
    for est in models:
        first = est.getStages()[0] if isinstance(est, Pipeline) and est.getStages() else None
        if not isinstance(first, VectorAssembler):
            return None
        names += [c for c in first.getInputCols() if c not in names]
    return names


def _scored_folds(
    models: Mapping[str, Estimator], df: DataFrame, tables: Tables, folds: int, seed: int, key: str | Iterable[str] | None, parallelism: int
) -> DataFrame:
    """``out_of_fold`` of the distinct rows, and how many each stands for."""
    if not 3 <= folds <= 10:
        raise ValueError("folds must be between 3 and 10")
    dealt = tables.deal(df.withColumn("_fold", _hashed(df, seed + 1, key, folds)), "folds")
    features = _features(models.values())
    if features is None:
        once = dealt.withColumn(STANDS_FOR, F.lit(1).cast("bigint"))
    else:
        once = tables.deal(tables.keep(distinct_rows(dealt, [*features, "label", "_fold"]), "distinct"), "folds")

    def scored(work: tuple[str, Estimator, int]) -> DataFrame:
        name, est, fold = work
        train = once if takes_distinct(est) else dealt
        held = est.fit(train.filter(F.col("_fold") != fold)).transform(once.filter(F.col("_fold") == fold))
        score = F.lit(None).cast("double")
        if "rawPrediction" in held.columns:
            raw = vector_to_array("rawPrediction")
            score = F.when(F.size(raw) == 2, F.get(raw, F.lit(1)))
        rows = held.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"), score.alias("score"), STANDS_FOR)
        return tables.keep(rows, "out-of-fold")

    # The model lists end with the slowest, which begin first.
    todo = [(name, est, fold) for name, est in reversed(models.items()) for fold in range(folds)]
    with ThreadPool(max(1, min(parallelism, len(todo)))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(scored), todo, chunksize=1)
    return reduce(DataFrame.unionByName, parts)


def fold_scores(rows: DataFrame, scoring: str) -> DataFrame:
    """(model, fold, value): the score of each fold of ``out_of_fold``; a ROC area only where there are scores."""
    keys, label, prediction, n = ["model", "fold"], F.col("label"), F.col("prediction"), rows_of(rows)
    if scoring == "accuracy":
        return rows.groupBy(*keys).agg((F.sum((label == prediction).cast("double") * n) / F.sum(n)).alias("value"))
    if scoring == "r2":
        means = rows.groupBy(*keys).agg((F.sum(label * n) / F.sum(n)).alias("_mean"))
        off = rows.join(F.broadcast(means), keys)  # one row a model and fold
        return off.groupBy(*keys).agg((1 - F.try_divide(F.sum((label - prediction) ** 2 * n), F.sum((label - F.col("_mean")) ** 2 * n))).alias("value"))
    if scoring == "f1_weighted":
        cells = rows.groupBy(*keys, "label", "prediction").agg(F.sum(n).cast("double").alias("n"))
        hit = F.when(label == prediction, F.col("n")).otherwise(0.0)
        sides = F.array(F.struct(label.alias("class"), F.col("n").alias("t"), F.lit(0.0).alias("p"), hit.alias("h")), F.struct(prediction.alias("class"), F.lit(0.0).alias("t"), F.col("n").alias("p"), F.lit(0.0).alias("h")))
        classes = cells.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in "tph"])
        # 2 P R / (P + R) with P = h / p and R = h / t.
        return classes.groupBy(*keys).agg(F.try_divide(F.sum(F.col("t") * 2 * F.col("h") / (F.col("t") + F.col("p"))), F.sum("t")).alias("value"))
    if scoring == "roc_auc":
        return metrics.roc_auc_by(rows, keys, "score", rows=n).withColumnRenamed("roc_auc", "value")
    raise ValueError(f"unknown scoring {scoring!r}")


def cross_validate_all(
    models: Mapping[str, Estimator], df: DataFrame, scoring: str, folds: int = 5, seed: int = 42, key: str | Iterable[str] | None = None, parallelism: int = 8
) -> dict[str, tuple[float | None, float | None]]:
    """Mean and deviation of every model's score over the same folds; None where a fold has no score."""
    with Tables(df.sparkSession) as tables:
        rows = _scored_folds(models, df, tables, folds, seed, key, parallelism)
        found: dict[str, list[float | None]] = {name: [] for name in models}
        for row in fold_scores(rows, scoring).collect():  # one row a model and fold
            found[row["model"]].append(row["value"])
    return {name: (fmean(v), pstdev(v)) if v and None not in v else (None, None) for name, v in found.items()}


def cross_validate(
    est: Estimator, df: DataFrame, scoring: str, folds: int = 5, seed: int = 42, key: str | Iterable[str] | None = None
) -> tuple[float | None, float | None]:
    """Mean and deviation of one model's score over folds chosen by a seeded hash."""
    return cross_validate_all({"": est}, df, scoring, folds, seed, key)[""]


@dataclass(frozen=True)
class Trained:
    """One trained model and how it did on the test rows."""

    name: str
    model: PipelineModel
    seconds: float
    cv_mean: float | None
    cv_std: float | None
    metrics: Mapping[str, float | None] = field(default_factory=dict)


def _test_metrics(scored: DataFrame, problem: str) -> dict[str, float | None]:
    if problem == "regression":
        return metrics.regression_metrics(scored).first().asDict()
    found = metrics.classification_metrics(scored).first().asDict()
    found["roc_auc"], found["avg_confidence"] = None, None
    classes = scored.agg(F.count_distinct("label")).first()[0]
    if classes == 2 and "rawPrediction" in scored.columns:
        found["roc_auc"] = evaluator("roc_auc").evaluate(scored)
    if "probability" in scored.columns:
        sure = metrics.predicted_confidence()
        found["avg_confidence"] = metrics.classification_errors(scored, confidence=sure).first()["avg_confidence"]
    return found


def evaluate(name: str, est: Pipeline, train: DataFrame, test: DataFrame, problem: str, scoring: str, folds: int | None = 5, seed: int = 42) -> Trained:
    """Fit on the train rows, score the test rows, cross-validate on the train rows."""
    started = time.monotonic()
    model = est.fit(train)
    seconds = time.monotonic() - started
    scored = model.transform(test)
    found = _test_metrics(every_row(scored) if STANDS_FOR in test.columns else scored, problem)
    mean, std = cross_validate(est, train, scoring, folds, seed) if folds else (None, None)
    return Trained(name, model, seconds, mean, std, found)


def train_models(
    df: DataFrame,
    features: Iterable[str],
    target: str,
    problem: str,
    models: Iterable[str] | Mapping[str, Estimator] | None = None,
    test: float = 0.2,
    folds: int | None = 5,
    scale: bool = True,
    seed: int = 42,
    key: str | Iterable[str] | None = None,
    parallelism: int = 4,
) -> list[Trained]:
    """Train and evaluate models on one split of the table.

    ``models`` is a choice of names, or estimators of your own; all by default.
    The fits run side by side; ``parallelism=1`` times each of them alone.
    """
    features = as_list(features)
    rows = label_rows(df, target, problem)
    train, held = split(rows.select(*[col(f) for f in features], "label", *[col(k) for k in as_list(key) if k not in features]), test, seed, key)
    with Tables(df.sparkSession) as tables:
        train, held = tables.deal(train, "train"), tables.deal(held, "test")
        if isinstance(models, Mapping):
            chosen = dict(models)
        else:
            seen = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("std"), F.max("label").alias("top")).first()
            if problem == "classification":
                every = classifiers(len(features), int(seen["top"]) + 1, seen["n"], seed)
            else:
                every = regressors(seen["n"], seen["std"] or 1.0, seed)
            chosen = {m: every[m] for m in (as_list(models) if models is not None else every)}
        scoring = scoring_for(train, "label", problem)
        lines = {name: pipeline(name, est, features, scale) for name, est in chosen.items()}
        once, judged = (tables.deal(tables.keep(distinct_rows(t, [*features, "label"]), "distinct"), "distinct") for t in (train, held))
        with ThreadPool(max(1, min(parallelism, len(lines)))) as pool:
            one = inheritable_thread_target(df.sparkSession)(
                lambda line: evaluate(*line, once if takes_distinct(line[1]) else train, judged, problem, scoring, None, seed)
            )
            done = pool.map(one, lines.items(), chunksize=1)
        if folds:
            checked = cross_validate_all(lines, train, scoring, folds, seed, parallelism=2 * parallelism)
            done = [replace(d, cv_mean=checked[d.name][0], cv_std=checked[d.name][1]) for d in done]
        return done


# -- tuning -----------------------------------------------------------------
class Line(Pipeline):
    """A pipeline whose first stages are fitted once for all settings of its last one."""

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict[Param, Any]]) -> Iterator[tuple[int, PipelineModel]]:
        *first, last = self.getStages()
        if any(param.parent == stage.uid for params in paramMaps for param in params for stage in first):
            return super().fitMultiple(dataset, paramMaps)
        begun = Pipeline(stages=first).fit(dataset)
        models = last.fitMultiple(begun.transform(dataset), paramMaps)
        return map(lambda found: (found[0], PipelineModel([*begun.stages, found[1]])), models)


# Grids searched (fixed values). A minimum of 5 rows to split a node becomes at
# least 2 rows on either side.
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [MAX_DEPTH, 10, 20], "minInstancesPerNode": [1, 2]}
BOOSTING_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.3]}


def tune(
    name: str,
    estimator: Estimator,
    train: DataFrame,
    features: Iterable[str],
    scoring: str,
    grid: Mapping[str, list[Any]] | None = None,
    folds: int = 3,
    parallelism: int = 4,
    seed: int = 42,
) -> CrossValidatorModel:
    """Grid search of a forest or boosting model by cross-validation."""
    if grid is None:
        grid = FOREST_GRID if "Forest" in name else BOOSTING_GRID
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param), values)
    features, judge = as_list(features), evaluator(scoring)
    line = Line(stages=pipeline(name, estimator, features).getStages())
    search = CrossValidator(estimator=line, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=seed)
    with Tables(train.sparkSession) as tables:
        if not takes_distinct(line):
            return search.fit(tables.deal(train, "tune"))
        placed = train.select(*[col(f) for f in features], "label").withColumn("_fold", F.floor(F.rand(seed) * folds).cast("int"))
        once = tables.deal(tables.keep(distinct_rows(placed, [*features, "label", "_fold"]), "distinct"), "tune")
        judge.setWeightCol(STANDS_FOR)
        return search.setFoldCol("_fold").fit(once)


def tuning_table(found: CrossValidatorModel) -> DataFrame:
    """(params, avg_metric, std_metric) of every grid point."""
    rows = []
    for params, mean, std in zip(found.getEstimatorParamMaps(), found.avgMetrics, found.stdMetrics or []):
        text = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))
        rows.append((text, float(mean), float(std)))
    return SparkSession.active().createDataFrame(rows, "params string, avg_metric double, std_metric double")


# -- stacking ---------------------------------------------------------------
class Stack(Estimator):
    """Up to three base models under a logistic or ridge model.

    The final model learns from out-of-fold predictions of the base models, which
    are then fitted again on all rows.
    """

    def __init__(self, models: Mapping[str, Estimator], features: Iterable[str], problem: str, folds: int = 5, seed: int = 42):
        super().__init__()
        if len(models) < 3:
            raise ValueError("stacking needs at least three models")
        self.base = dict(list(models.items())[:3])
        self.features, self.problem, self.folds, self.seed = as_list(features), problem, folds, seed

    def _fit(self, dataset: DataFrame) -> "StackModel":
        with Tables(dataset.sparkSession) as tables:
            return self._fit_stored(tables.deal(dataset, "stack"), tables)

    def _fit_stored(self, dataset: DataFrame, tables: Tables) -> "StackModel":
        place = _hashed(dataset, self.seed + 2, None, self.folds)  # equal rows share a fold
        once = tables.deal(tables.keep(distinct_rows(dataset, dataset.columns), "distinct"), "stack")

        def fitted(work: tuple[str, Estimator, int | None]) -> PipelineModel:
            name, est, fold = work
            line = pipeline(name, est, self.features)
            train = once if takes_distinct(line) else dataset
            return line.fit(train if fold is None else train.filter(place != fold))

        def scored(fold: int) -> DataFrame:
            part = once.filter(place == fold)
            for i, model in enumerate(found[fold * len(self.base) : (fold + 1) * len(self.base)]):
                part = _with_output(model, part, i)
            return tables.keep(part, "stack-fold")

        todo = [(name, est, fold) for fold in [*range(self.folds), None] for name, est in self.base.items()]
        with ThreadPool(4) as pool:
            target = inheritable_thread_target(dataset.sparkSession)
            found = pool.map(target(fitted), todo, chunksize=1)
            parts = pool.map(target(scored), range(self.folds), chunksize=1)
        joined = reduce(DataFrame.unionByName, parts)
        outputs = [f"_out{i}" for i in range(len(self.base))]
        if self.problem == "classification":
            final: Estimator = C.LogisticRegression(regParam=1 / max(dataset.count(), 1), standardization=False)
        else:
            seen = dataset.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("std")).first()
            final = penalized(0.0, 1 / max(seen["n"], 1), seen["std"] or 1.0)
        final.setFeaturesCol("_outputs")
        top = Pipeline(stages=[VectorAssembler(inputCols=outputs, outputCol="_outputs"), condensed(final)]).fit(joined)
        return StackModel(found[-len(self.base) :], top)


class StackModel(SavedModel, Model):
    def __init__(self, base: list[PipelineModel], top: PipelineModel):
        super().__init__()
        self.base, self.top = base, top

    def settings(self) -> dict[str, Any]:
        return {"models": len(self.base)}

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.top.write().save(f"{path}/top")
        for i, model in enumerate(self.base):
            model.write().save(f"{path}/base-{i}")

    @classmethod
    def from_parts(cls, settings: dict[str, Any], path: str, spark: SparkSession) -> "StackModel":
        return cls([load_model(f"{path}/base-{i}") for i in range(settings["models"])], load_model(f"{path}/top"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, model in enumerate(self.base):
            out = _with_output(model, out, i)
        return self.top.transform(out).drop("_outputs", *[f"_out{i}" for i in range(len(self.base))])


def _with_output(model: PipelineModel, df: DataFrame, i: int) -> DataFrame:
    """Adds what the final model sees: class probabilities, or else the prediction."""
    scored = model.transform(df)
    output = F.col("probability") if "probability" in scored.columns else F.col("prediction")
    return scored.select(*[col(c) for c in df.columns], output.alias(f"_out{i}"))


def stack(df: DataFrame, features: Iterable[str], target: str, problem: str, models: Mapping[str, Estimator], test: float = 0.2, seed: int = 42) -> Trained:
    """Train a stack of the first three models and evaluate it on the test rows."""
    features = as_list(features)
    rows = label_rows(df, target, problem).select(*[col(f) for f in features], "label")
    train, held = split(rows, test, seed)
    with Tables(df.sparkSession) as tables:
        train, held = tables.deal(train, "train"), tables.deal(held, "test")
        started = time.monotonic()
        fitted = Stack(models, features, problem, seed=seed).fit(train)
        seconds = time.monotonic() - started
        judged = tables.deal(tables.keep(distinct_rows(held, held.columns), "distinct"), "distinct")
        found = _test_metrics(every_row(fitted.transform(judged)), problem)
    return Trained("Ensemble Stack", fitted, seconds, None, None, found)


# -- tables -----------------------------------------------------------------
_CLASS_COLUMNS = {
    "Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1": "f1",
    "ROC_AUC": "roc_auc", "FPR": "fpr", "FNR": "fnr", "Avg Confidence": "avg_confidence",
}
_NUMBER_COLUMNS = {"R2": "r2", "RMSE": "rmse", "MAE": "mae", "MAPE": "mape"}


def leaderboard(results: Iterable[Trained], problem: str) -> DataFrame:
    """One row per model: time, cross-validation and test metrics."""
    wanted = _CLASS_COLUMNS if problem == "classification" else _NUMBER_COLUMNS
    rows = []
    for r in results:
        values = [r.metrics.get(k) for k in wanted.values()]
        rows.append((r.name, float(r.seconds), r.cv_mean, r.cv_std, *[None if v is None else float(v) for v in values]))
    names = ["`Training Time (s)`", "`CV Mean`", "`CV Std`", *[f"`{c}`" for c in wanted]]
    return SparkSession.active().createDataFrame(rows, "Model string, " + ", ".join(f"{n} double" for n in names))


def feature_importance(model: PipelineModel, features: Iterable[str], k: int = 15) -> DataFrame:
    """(feature, importance): impurity shares or absolute coefficients, largest first."""
    last, features = model.stages[-1], as_list(features)
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        weights = abs(last.coefficientMatrix.toArray()).max(axis=0)
    elif hasattr(last, "coefficients"):
        weights = abs(last.coefficients.toArray())
    else:
        raise TypeError(f"{type(last).__name__} has no feature importance")
    rows = sorted(((f, float(w)) for f, w in zip(features, weights)), key=lambda fw: (-fw[1], fw[0]))[:k]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")
