"""Probabilities for classifiers that only give margins."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.kinds import col
from .persist import SavedModel, load_model

FOLDS = 3


class Calibrated(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """A classifier and a logistic curve over its margins on rows it was not fitted on."""

    def __init__(self, base: Estimator, folds: int = FOLDS, seed: int = 42):
        super().__init__()
        self.base, self.folds, self.seed = base, folds, seed
        self._set(featuresCol=base.getFeaturesCol(), labelCol=base.getLabelCol())

    def getClassifier(self) -> Estimator:
        return self.base.getClassifier()

    def _fit(self, dataset: DataFrame) -> "CalibratedModel":
        place = F.pmod(F.xxhash64(F.lit(self.seed), vector_to_array(self.getFeaturesCol()), col(self.getLabelCol())), F.lit(self.folds))
        base, weight = self.base, F.lit(1.0)
        if self.isSet(self.weightCol):
            base, weight = base.copy({base.getParam("weightCol"): self.getWeightCol()}), col(self.getWeightCol())
        train = [dataset, *[dataset.filter(place != fold) for fold in range(self.folds)]]
        with ThreadPool(len(train)) as pool:  # a fit is many short jobs
            whole, *fitted = pool.map(inheritable_thread_target(dataset.sparkSession)(base.fit), train)
        parts = [model.transform(dataset.filter(place == fold)) for fold, model in enumerate(fitted)]
        columns = [F.col("rawPrediction").alias("_margins"), col(self.getLabelCol()).alias("_label"), weight.alias("_share")]
        margins = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
        # Hardly any penalty, as the margins of two classes are each other's negatives.
        curve = LogisticRegression(featuresCol="_margins", labelCol="_label", predictionCol="_class", rawPredictionCol="_raw", weightCol="_share", regParam=1e-6)
        return CalibratedModel(whole, curve.fit(margins))


class CalibratedModel(SavedModel, Model):
    def __init__(self, base: Model, curve: Model):
        super().__init__()
        self.base, self.curve = base, curve

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.base.transform(dataset).withColumn("_margins", F.col("rawPrediction"))
        return self.curve.transform(scored).drop("_margins", "_class", "_raw")

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.base.write().save(f"{path}/base")
        self.curve.write().save(f"{path}/curve")

    @classmethod
    def from_parts(cls, settings: dict[str, Any], path: str, spark: SparkSession) -> "CalibratedModel":
        return cls(load_model(f"{path}/base"), load_model(f"{path}/curve"))
