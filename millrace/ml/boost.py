"""AdaBoost (multi-class SAMME) over weighted depth-1 decision trees.

A fitted model keeps each tree as one comparison, so that all trees are one projection.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasWeightCol
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..session import Tables
from .persist import SavedModel

# Rounds between writes of the weighted table, which keep its lineage short.
ROUNDS_PER_WRITE = 5


@dataclass(frozen=True)
class Stump:
    """One comparison: rows go left by a threshold or by a set of category codes; feature -1 is a leaf alone."""

    weight: float
    feature: int
    threshold: float | None
    categories: list[float] | None
    left: int
    right: int

    @classmethod
    def of(cls, model: Model, weight: float) -> "Stump":
        root = model._java_obj.rootNode()
        if model.depth == 0:
            return cls(weight, -1, None, None, int(root.prediction()), int(root.prediction()))
        split = root.split()
        threshold = categories = None
        if split.getClass().getSimpleName() == "ContinuousSplit":
            threshold = float(split.threshold())
        else:
            categories = [float(c) for c in split.leftCategories()]
        return cls(weight, int(split.featureIndex()), threshold, categories, int(root.leftChild().prediction()), int(root.rightChild().prediction()))

    def vote(self, features: Column, label: int) -> Column | None:
        """What it adds to a class."""
        left, right = (F.lit(self.weight if side == label else 0.0) for side in (self.left, self.right))
        if label not in (self.left, self.right):
            return None
        if self.feature < 0 or self.left == self.right:
            return left
        value = F.get(features, F.lit(self.feature))
        goes_left = value <= F.lit(self.threshold) if self.categories is None else value.isin(self.categories)
        return F.when(goes_left, left).otherwise(right)


class AdaBoost(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol):
    """Each round fits a stump to the current weights and raises those of its errors."""

    @keyword_only
    def __init__(self, rounds: int = 50, seed: int = 42, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self.rounds, self.seed = rounds, seed
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, dataset: DataFrame) -> "AdaBoostModel":
        features, label = self.getFeaturesCol(), self.getLabelCol()
        with Tables(dataset.sparkSession) as tables:
            weight = col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
            table = tables.deal(dataset.select(col(features).alias("f"), col(label).cast("double").alias("y"), weight.alias("w")), "boost")
            classes = int(table.agg(F.max("y")).first()[0]) + 1
            return self._copyValues(AdaBoostModel(self._stumps(table, classes, tables), classes))

    def _stumps(self, table: DataFrame, classes: int, tables: Tables) -> list[Stump]:
        tree = DecisionTreeClassifier(featuresCol="f", labelCol="y", weightCol="w", maxDepth=1, seed=self.seed)
        stumps: list[Stump] = []
        for number in range(self.rounds):
            model = tree.fit(table)
            judged = model.transform(table).select("f", "y", "w", (F.col("prediction") != F.col("y")).alias("wrong"))
            sums = judged.agg(F.sum(F.when(F.col("wrong"), F.col("w")).otherwise(0.0)).alias("e"), F.sum("w").alias("w")).first()
            error = sums["e"] / sums["w"]
            if error >= 1 - 1 / classes:
                # No better than guessing: keep it only if there is nothing else.
                return stumps or [Stump.of(model, 1.0)]
            if error <= 0:
                return [*stumps, Stump.of(model, 1.0)]
            alpha = math.log((1 - error) / error) + math.log(max(classes - 1, 1))
            stumps.append(Stump.of(model, alpha))
            raised = F.col("w") * F.when(F.col("wrong"), math.exp(alpha)).otherwise(1.0) / F.lit(sums["w"])
            table = judged.select("f", "y", raised.alias("w"))
            if (number + 1) % ROUNDS_PER_WRITE == 0 and number + 1 < self.rounds:
                table = tables.keep(table, "boost")
                tables.drop(but=1)
        return stumps


class AdaBoostModel(SavedModel, Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol):
    """The classes' summed votes (raw), the most voted class, and a probability.

    The probability is the softmax of each class's share of the votes less the mean
    share of the others, scaled down by the number of other classes.
    """

    def __init__(self, stumps: list[Stump], classes: int):
        super().__init__()
        self.stumps, self.classes = stumps, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, kept = F.col("_features"), [col(c) for c in dataset.columns]
        table = dataset.withColumn("_features", vector_to_array(col(self.getFeaturesCol())))
        votes = [[v for s in self.stumps if (v := s.vote(features, label)) is not None] for label in range(self.classes)]
        table = table.withColumn("_votes", F.array(*[reduce(Column.__add__, v, F.lit(0.0)) for v in votes]))
        others = max(self.classes - 1, 1)
        total = sum(s.weight for s in self.stumps) or 1.0
        odds = F.transform("_votes", lambda v: F.exp((v - (F.lit(total) - v) / others) / (total * others)))
        table = table.withColumn("_odds", odds)
        sure = F.transform("_odds", lambda o: o / F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b))
        # The first class wins a tie.
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return table.select(
            *kept,
            array_to_vector("_votes").alias(self.getRawPredictionCol()),
            array_to_vector(sure).alias(self.getProbabilityCol()),
            best.cast("double").alias(self.getPredictionCol()),
        )

    def settings(self) -> dict[str, Any]:
        return {"classes": self.classes}

    def save_parts(self, path: str, spark: SparkSession) -> None:
        rows = [(i, *asdict(s).values()) for i, s in enumerate(self.stumps)]
        schema = "round int, weight double, feature int, threshold double, categories array<double>, left int, right int"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/stumps")

    @classmethod
    def from_parts(cls, settings: dict[str, Any], path: str, spark: SparkSession) -> "AdaBoostModel":
        rows = spark.read.parquet(f"{path}/stumps").orderBy("round").drop("round").collect()  # one row a round
        return cls([Stump(**r.asDict()) for r in rows], settings["classes"])
