"""Exact k nearest neighbours without comparing every row with every row.

Train rows are split into cells of similar size by median cuts learned from a
bounded sample. A query first searches its own cell; the distance of the k-th hit
bounds which other cells can hold anything closer, and only those are searched. A
search compares a bounded block of a cell with a bounded share of its queries and
returns k rows per query. Equal train points keep their k smallest keys and equal queries are answered once, so
points repeated any number of times add no work.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import Cells, as_matrix, distance_blocks, nearest_in_rows
from ..functions.kinds import as_double, as_list, col, require_numeric
from ..session import materialize
from .persist import SavedModel
from .weights import STANDS_FOR, every_row

CELL_ROWS = 2_000
SAMPLE_PER_CELL = 32
MAX_CELLS = 4096  # beyond it cells fill up and are searched in blocks
BLOCK_ROWS = 10_000


# -- search -----------------------------------------------------------------
def _shares(cells: DataFrame) -> DataFrame:
    """Cells with many queries are searched by several tasks: (cell, tasks)."""
    counts = cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("_cell", F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_tasks"))


def _paired(queries: DataFrame, points: DataFrame):
    """Both sides grouped by (cell, task, block).

    A cell's queries are dealt over tasks and its points over blocks, each side being
    repeated for the other's parts, so a group is bounded however full a cell is.
    """
    blocks = points.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    grid = F.broadcast(_shares(queries).join(blocks, "_cell"))  # at most MAX_CELLS rows

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = queries.join(grid, "_cell").withColumn("_task", F.pmod(F.xxhash64("_x"), F.col("_tasks")).cast("int")).withColumn("_block", every("_blocks"))
    right = points.join(grid, "_cell").withColumn("_block", F.pmod(F.xxhash64("_tk"), F.col("_blocks")).cast("int")).withColumn("_task", every("_tasks"))
    keys = ("_cell", "_task", "_block")
    return left.drop("_tasks", "_blocks").groupBy(*keys).cogroup(right.drop("_tasks", "_blocks").groupBy(*keys))


def _nearest_points(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(_x, _d, _tk, _y): the k nearest points of every distinct query."""
    points = materialize(points, "knn-points")
    size = points.count()
    if size == 0:
        raise ValueError("no train rows")
    depth = 0
    while 2**depth < min(size / CELL_ROWS, MAX_CELLS):
        depth += 1
    sample = points.select("_x").orderBy(F.xxhash64("_x")).limit(SAMPLE_PER_CELL * 2**depth).collect() if depth else []
    width = len(points.select("_x").first()[0])
    cells = Cells(np.array([r[0] for r in sample], dtype=float).reshape(-1, width), depth)

    @F.pandas_udf("int")
    def cell_of(xs: pd.Series) -> pd.Series:
        return pd.Series(cells.of(as_matrix(xs)).astype("int32")) if len(xs) else pd.Series([], dtype="int32")

    placed = points.withColumn("_cell", cell_of("_x"))
    if depth == 0:
        targets = queries.withColumn("_cell", F.lit(0))
    else:

        def radius(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
            if qs.empty:
                return pd.DataFrame({"_x": [], "_r": []}, dtype=object)
            reach = np.full(len(qs), np.inf)
            if len(ps) >= k:
                for start, d in distance_blocks(as_matrix(qs["_x"]), as_matrix(ps["_x"])):
                    reach[start : start + len(d)] = np.partition(d, k - 1, axis=1)[:, k - 1]
            return pd.DataFrame({"_x": qs["_x"], "_r": reach})

        @F.pandas_udf("array<int>")
        def cells_within(xs: pd.Series, rs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            return pd.Series([c.astype("int32") for c in cells.within(as_matrix(xs), rs.to_numpy(dtype=float))])

        homed = queries.withColumn("_cell", cell_of("_x"))
        bounded = _paired(homed, placed).applyInPandas(radius, "_x array<double>, _r double")
        # A home cell without points bounds nothing: such queries search every cell.
        empty = homed.join(F.broadcast(placed.select("_cell").distinct()), "_cell", "left_anti")
        bounded = bounded.unionByName(empty.select("_x", F.lit(float("inf")).alias("_r"))).groupBy("_x").agg(F.min("_r").alias("_r"))
        targets = bounded.select("_x", F.explode(cells_within("_x", "_r")).alias("_cell"))

    key_type = points.schema["_tk"].dataType.simpleString()
    label_type = points.schema["_y"].dataType.simpleString()

    def search(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ps.empty:
            return pd.DataFrame({"_x": [], "_d": [], "_tk": [], "_y": []}, dtype=object)
        ps = ps.sort_values("_tk", kind="stable").reset_index(drop=True)
        xs, out = as_matrix(qs["_x"]), []
        for start, d in distance_blocks(xs, as_matrix(ps["_x"])):
            rows, near = nearest_in_rows(d, k)
            out.append(
                pd.DataFrame(
                    {
                        "_x": qs["_x"].iloc[start + rows].to_numpy(),
                        "_d": d[rows, near],
                        "_tk": ps["_tk"].iloc[near].to_numpy(),
                        "_y": ps["_y"].iloc[near].to_numpy(),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    found = _paired(targets, placed).applyInPandas(search, f"_x array<double>, _d double, _tk {key_type}, _y {label_type}")
    order = Window.partitionBy("_x").orderBy("_d", "_tk")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def _distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """Of equal points only the k smallest keys can ever be among the nearest."""
    order = Window.partitionBy("_x").orderBy("_tk")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def _answers(train: DataFrame, queries: DataFrame, k: int, problem: str) -> DataFrame:
    """(_x, _answer) by majority vote, smallest label on a tie, or by mean; a vote has ``_votes`` by label too."""
    near = _nearest_points(_distinct_points(train, k), queries.select("_x").distinct(), k)
    if problem == "regression":
        return near.groupBy("_x").agg(F.avg("_y").alias("_answer"))
    votes = near.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    # At most k labels a point.
    return votes.groupBy("_x").agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_y").alias("y")))["y"].alias("_answer"),
        F.map_from_entries(F.collect_list(F.struct("_y", "_n"))).alias("_votes"),
    )


def knn_predict(
    train: DataFrame,
    test: DataFrame,
    features: Iterable[str],
    label: str,
    key: str,
    k: int = 5,
    problem: str = "classification",
    target: str = "prediction",
) -> DataFrame:
    """Adds a prediction to the test rows from their k nearest train rows.

    Distance is Euclidean; among equally distant train rows the smaller ``key``
    counts as nearer. Rows with a missing feature get no prediction.
    """
    features = as_list(features)
    require_numeric(train, features)
    points = train.select(F.array(*[as_double(train, f) for f in features]).alias("_x"), col(key).alias("_tk"), col(label).alias("_y"))
    points = points.filter(~F.exists("_x", lambda v: v.isNull()) & F.col("_y").isNotNull())
    if problem == "regression":
        points = points.withColumn("_y", F.col("_y").cast("double"))
    asked = test.withColumn("_q", F.array(*[as_double(test, f) for f in features]))
    queries = asked.filter(~F.exists("_q", lambda v: v.isNull())).select(F.col("_q").alias("_x"))
    answers = _answers(points, queries, k, problem)
    joined = asked.join(answers, F.col("_q") == F.col("_x"), "left")
    return joined.select(*[col(c) for c in test.columns if c != target], F.col("_answer").alias(target))


# -- pipeline stage ---------------------------------------------------------
class KNearest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """k-nearest-neighbour classifier or regressor over a vector column, of every row or of distinct rows."""

    takes_distinct = True

    @keyword_only
    def __init__(self, k: int = 5, problem: str = "classification", featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self.k, self.problem = k, problem
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, dataset: DataFrame) -> "KNearestModel":
        if STANDS_FOR in dataset.columns:  # of equal rows no more than k can be among the nearest
            dataset = every_row(dataset.withColumn(STANDS_FOR, F.least(F.col(STANDS_FOR), F.lit(self.k))))
        points = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("_x"),
            F.xxhash64(vector_to_array(self.getFeaturesCol()), col(self.getLabelCol())).alias("_tk"),
            col(self.getLabelCol()).cast("double").alias("_y"),
        )
        # The model's own table: it outlives the one it was fitted on.
        points = materialize(_distinct_points(points, self.k), "knn-model")
        classes = int(points.agg(F.max("_y")).first()[0] or 0) + 1 if self.problem == "classification" else 0
        model = KNearestModel(points, self.k, self.problem, classes)
        return self._copyValues(model)


class KNearestModel(SavedModel, Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol):
    """The train points; a classifier also gives the neighbours' counts (raw) and shares by class."""

    def __init__(self, points: DataFrame, k: int, problem: str, classes: int = 0):
        super().__init__()
        self.points, self.k, self.problem, self.classes = points, k, problem, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        asked = dataset.withColumn("_q", vector_to_array(self.getFeaturesCol()))
        answers = _answers(self.points, asked.select(F.col("_q").alias("_x")), self.k, self.problem)
        joined = asked.join(answers, F.col("_q") == F.col("_x"), "left")
        kept, answer = [col(c) for c in dataset.columns], F.col("_answer").cast("double").alias(self.getPredictionCol())
        if self.problem == "regression":
            return joined.select(*kept, answer)
        counts = F.array(*[F.coalesce(F.try_element_at("_votes", F.lit(float(c))), F.lit(0)).cast("double") for c in range(self.classes)])
        joined = joined.withColumn("_counts", counts)
        shares = F.transform("_counts", lambda n: F.try_divide(n, F.aggregate("_counts", F.lit(0.0), lambda a, b: a + b)))
        return joined.select(*kept, array_to_vector("_counts").alias(self.getRawPredictionCol()), array_to_vector(shares).alias(self.getProbabilityCol()), answer)

    def settings(self) -> dict[str, Any]:
        return {"k": self.k, "problem": self.problem, "classes": self.classes}

    def save_parts(self, path: str, spark: SparkSession) -> None:
        self.points.write.parquet(f"{path}/points")

    @classmethod
    def from_parts(cls, settings: dict[str, Any], path: str, spark: SparkSession) -> "KNearestModel":
        return cls(spark.read.parquet(f"{path}/points"), **settings)
