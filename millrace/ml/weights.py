"""Fitting on distinct rows.

A table that is fitted many times is brought to its distinct rows once (``distinct_rows``);
the column ``STANDS_FOR`` says how many rows each of them stands for.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasWeightCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..session import Tables

# Forests draw rows, and a row drawn must not stand for others.
DRAWING = (RandomForestClassifier, RandomForestRegressor)


STANDS_FOR = "__stands_for"
_CHUNK = 1024  # rows written out of one array


def distinct_rows(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The distinct rows of some columns, and how many each stands for."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(STANDS_FOR))


def every_row(df: DataFrame) -> DataFrame:
    """As many copies of each row as it stands for."""
    chunks = df.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(STANDS_FOR), F.lit(_CHUNK).cast("bigint"))))
    copies = F.sequence(F.col("__from"), F.least(F.col("__from") + (_CHUNK - 1), F.col(STANDS_FOR)))
    return chunks.withColumn("__copy", F.explode(copies)).drop("__from", "__copy", STANDS_FOR)


def rows_of(df: DataFrame) -> Column:
    """How many rows each row stands for, 1 without the column."""
    return F.col(STANDS_FOR) if STANDS_FOR in df.columns else F.lit(1).cast("bigint")


def takes_distinct(estimator: Estimator) -> bool:
    """Whether a fit on distinct rows that say what they stand for is the fit on every row."""
    return isinstance(estimator, Pipeline) and getattr(estimator.getStages()[-1], "takes_distinct", False)


class Scaled(Estimator):
    """A standard scaler that counts what each row stands for."""

    def __init__(self, base: StandardScaler):
        super().__init__()
        self.base = base

    def _fit(self, dataset: DataFrame) -> StandardScalerModel:
        if STANDS_FOR not in dataset.columns:
            return self.base.fit(dataset)
        n, x = F.col("n"), F.col("x")
        rows = dataset.select(F.posexplode(vector_to_array(col(self.base.getInputCol()))).alias("i", "x"), F.col(STANDS_FOR).cast("double").alias("n"))
        means = rows.groupBy("i").agg((F.sum(n * x) / F.sum(n)).alias("mean"))
        spread = rows.join(F.broadcast(means), "i").groupBy("i", "mean").agg(F.sum(n * (x - F.col("mean")) ** 2).alias("square"), F.sum(n).alias("n"))
        found = spread.orderBy("i").collect()  # one row a feature
        # Two rows of the same mean and deviation.
        off = [math.sqrt(r["square"] / (r["n"] - 1) / 2) if r["n"] > 1 else 0.0 for r in found]
        two = [(Vectors.dense([r["mean"] + side * o for r, o in zip(found, off)]),) for side in (-1, 1)]
        return self.base.fit(dataset.sparkSession.createDataFrame(two, [self.base.getInputCol()]))


class Condensed(Estimator):
    """An estimator with weights, fitted on the distinct rows, each weighing what it stands for."""

    takes_distinct = True

    def __init__(self, base: Estimator):
        super().__init__()
        self.base = base

    def copy(self, extra: Any = None) -> "Condensed":
        return Condensed(self.base.copy(extra))

    def _fit(self, dataset: DataFrame) -> Model:
        keys = [col(self.base.getFeaturesCol()), col(self.base.getLabelCol())]
        with Tables(dataset.sparkSession) as tables:
            rows = dataset.groupBy(*keys).agg(F.sum(rows_of(dataset)).cast("double").alias("_weight"))
            rows = tables.deal(tables.keep(rows, "distinct"), "condensed")
            return self.base.copy({self.base.getParam("weightCol"): "_weight"}).fit(rows)


def condensed(estimator: Estimator) -> Estimator:
    """The estimator over distinct rows where that is the same fit."""
    if not isinstance(estimator, HasWeightCol) or isinstance(estimator, DRAWING):
        return estimator
    own = [p for p in ("weightCol", "validationIndicatorCol", "offsetCol") if estimator.hasParam(p) and estimator.isSet(estimator.getParam(p))]
    drawn = estimator.hasParam("subsamplingRate") and estimator.getOrDefault(estimator.getParam("subsamplingRate")) < 1
    return estimator if own or drawn else Condensed(estimator)
