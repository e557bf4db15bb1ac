"""Neural networks fitted on distinct rows.

MLlib's perceptron takes no weights and reads every row in each of its up to a thousand
steps. Where distinct rows are few and stand for many, the same loss over them, each
weighing what it stands for, is minimised in one task by the same steps. Other tables are
given to MLlib row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import as_matrix, fit_network
from ..functions.kinds import col
from ..session import Tables
from .weights import STANDS_FOR, every_row, rows_of

ROWS_PER_DISTINCT = 10  # with fewer on average, or with more distinct rows, MLlib fits every row
MOST_DISTINCT = 50_000


class Network(Estimator):
    """MLlib's perceptron, fitted on distinct rows where these are few."""

    def __init__(self, base: MultilayerPerceptronClassifier):
        super().__init__()
        self.base = base

    def copy(self, extra: Any = None) -> "Network":
        return Network(self.base.copy(extra))

    def _fit(self, dataset: DataFrame) -> Model:
        base, spark = self.base, dataset.sparkSession
        layers = base.getLayers()
        x, y = vector_to_array(col(base.getFeaturesCol())).alias("x"), col(base.getLabelCol()).cast("double").alias("y")
        with Tables(spark) as tables:
            rows = tables.keep(dataset.groupBy(x, y).agg(F.sum(rows_of(dataset)).alias("n")), "network")
            # MLlib says what is wrong with such rows.
            odd = F.col("x").isNull() | (F.size("x") != layers[0]) | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.coalesce(F.col("y").isin([float(c) for c in range(layers[-1])]), F.lit(False))
            seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.max(odd).alias("odd")).first()
            if not seen["rows"] or seen["odd"] or seen["rows"] > min(seen["n"] / ROWS_PER_DISTINCT, MOST_DISTINCT):
                return base.fit(every_row(dataset) if STANDS_FOR in dataset.columns else dataset)
            # Without steps MLlib gives the weights it begins with.
            one = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [base.getFeaturesCol(), base.getLabelCol()])
            start = base.copy({base.maxIter: 0}).fit(one).weights.toArray()
            steps, tolerance = base.getMaxIter(), base.getTol()

            def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                every = pd.concat(list(batches), ignore_index=True).sort_values(["x", "y"], key=lambda c: c.map(tuple) if c.name == "x" else c)  # at most MOST_DISTINCT rows
                yield pd.DataFrame({"weights": [fit_network(start, layers, as_matrix(every["x"]), every["y"].to_numpy().astype(int), every["n"].to_numpy(), steps, tolerance)]})

            found = rows.coalesce(1).mapInPandas(fitted, "weights array<double>").first()["weights"]
            model = base.copy({base.maxIter: 0, base.initialWeights: Vectors.dense(found)}).fit(one)
            model.clear(model.getParam("initialWeights"))
            return model._set(maxIter=steps)


def on_distinct(estimator: Estimator) -> Estimator:
    """A perceptron fitted by L-BFGS, on distinct rows where these are few."""
    if not isinstance(estimator, MultilayerPerceptronClassifier) or estimator.getSolver() != "l-bfgs" or estimator.isSet(estimator.initialWeights):
        return estimator
    return Network(estimator)
