"""Random forests whose fit reads the rows once.

MLlib's trees see of a number only which of at most ``maxBins`` bins it lies in, so rows
of equal bins are one cell. Where cells are few and hold many rows, each tree's bootstrap
is drawn row by row and summed by cell in one pass, and each tree is grown from its cells
in a task, once for every setting that a grid asks for. Other tables are given to MLlib's forest row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from threading import Lock
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import as_matrix, drawn_sums, forest_votes, grow_tree
from ..functions.kinds import col
from ..session import Tables
from .persist import SavedModel
from .weights import DRAWING, STANDS_FOR, every_row, rows_of

ROWS_PER_CELL = 10  # with fewer on average, or with more cells, trees are grown from rows
MOST_CELLS = 20_000

_TREE = "feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>, importance array<double>"


class Forest(Estimator):
    """MLlib's forest, fitted on distinct rows or on every row; both give the same law of trees."""

    takes_distinct = True

    def __init__(self, base: RandomForestClassifier | RandomForestRegressor):
        super().__init__()
        self.base = base

    def copy(self, extra: Any = None) -> "Forest":
        return Forest(self.base.copy(extra))

    def _fit(self, dataset: DataFrame) -> Model:
        ((_, model),) = self.fitMultiple(dataset, [{}])
        return model

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict[Param, Any]]) -> Iterator[tuple[int, Model]]:
        """Forests of several settings. Those that draw alike share the rows' cells and the draws, as a forest begins with the trees of a smaller one."""
        bases = [self.base.copy(params) for params in paramMaps]
        tables, lock, left = Tables(dataset.sparkSession), Lock(), [len(bases)]
        alike: dict[tuple, list[RandomForestClassifier | RandomForestRegressor]] = {}
        for base in bases:
            alike.setdefault(_draws(base), []).append(base)
        grown: dict[tuple, _Grown | None] = {}

        def fit(i: int) -> Model:
            done = False
            try:
                with lock:
                    if (key := _draws(bases[i])) not in grown:
                        grown[key] = _Grown.of(dataset, alike[key], tables)
                own = grown[key]
                model = own.model(bases[i]) if own else bases[i].fit(every_row(dataset) if STANDS_FOR in dataset.columns else dataset)
                done = True
                return model
            finally:
                with lock:
                    left[0] -= 1
                    if not left[0] or not done:
                        tables.drop()

        return _FitMultipleIterator(fit, len(bases))


def _draws(base: RandomForestClassifier | RandomForestRegressor) -> tuple:
    """What decides a forest's cells and draws, but for the number of trees."""
    return base.getFeaturesCol(), base.getLabelCol(), base.getMaxBins(), base.getSubsamplingRate(), base.getBootstrap(), base.getSeed()


def _grows(base: RandomForestClassifier | RandomForestRegressor) -> tuple:
    """What decides how a tree grows from its cells, with the rule of features at a node last."""
    strategy = base.getFeatureSubsetStrategy()
    if strategy == "auto" and base.getNumTrees() == 1:
        strategy = "all"
    return base.getImpurity(), base.getMaxDepth(), base.getMinInfoGain(), base.getMinInstancesPerNode(), base.getMinWeightFractionPerNode(), strategy


@dataclass(frozen=True)
class _Grown:
    """The trees of forests that draw alike, as a stored table (grower, tree, ...)."""

    trees: DataFrame
    growers: list[tuple]
    cuts: list[list[float]]
    classes: int

    @classmethod
    def of(cls, dataset: DataFrame, bases: Sequence[RandomForestClassifier | RandomForestRegressor], tables: Tables) -> "_Grown | None":
        """None where the rows have too many cells."""
        base, classifies = bases[0], isinstance(bases[0], RandomForestClassifier)
        x, y = vector_to_array(col(base.getFeaturesCol())).alias("x"), col(base.getLabelCol()).cast("double").alias("y")
        rows = tables.keep(dataset.groupBy(x, y).agg(F.sum(rows_of(dataset)).alias(STANDS_FOR)), "forest")
        odd = F.max(F.col("y").isNull() | F.isnan("y"))
        seen = rows.agg(F.sum(STANDS_FOR).alias("n"), F.sum(F.col("y") * F.col(STANDS_FOR)).alias("y"), F.max("y").alias("top"), odd.alias("odd")).first()
        total = seen["n"] or 0
        cuts = _cuts(rows, base.getMaxBins(), tables) if total >= ROWS_PER_CELL and not seen["odd"] else None
        if cuts is None or rows.select(_bins(F.col("x"), cuts)).distinct().count() > min(total / ROWS_PER_CELL, MOST_CELLS):
            return None
        mean, classes = (0.0, int(seen["top"]) + 1) if classifies else (seen["y"] / total, 0)
        binned = rows.select(F.array_join(_bins(F.col("x"), cuts), ",").alias("cell"), (F.col("y") - mean).alias("y"), STANDS_FOR)
        most: dict[tuple, int] = {}  # trees of the largest forest that grows so
        for b in bases:
            most[_grows(b)] = max(most.get(_grows(b), 0), b.getNumTrees())
        sums = tables.keep(_sums(base, max(most.values()), tables.deal(binned, "forest"), classes), "forest")
        tasks = min(max(most.values()), 3 * dataset.sparkSession.sparkContext.defaultParallelism)
        trees = sums.repartition(tasks, "tree").groupBy("tree").applyInPandas(_grower(base, most, len(cuts), classes, mean), f"grower int, tree int, {_TREE}")
        return cls(tables.keep(trees, "forest"), list(most), cuts, classes)

    def model(self, base: RandomForestClassifier | RandomForestRegressor) -> "ForestModel":
        own = self.trees.filter((F.col("grower") == self.growers.index(_grows(base))) & (F.col("tree") < base.getNumTrees()))
        trees = [_arrays(r) for r in own.orderBy("tree").drop("grower", "tree").collect()]  # one row a tree
        names = {name: base.getOrDefault(name) for name in ("featuresCol", "predictionCol", "rawPredictionCol", "probabilityCol") if base.hasParam(name)}
        return ForestModel(trees, self.cuts, self.classes)._set(**names)


def _sums(base: RandomForestClassifier | RandomForestRegressor, trees: int, binned: DataFrame, classes: int) -> DataFrame:
    """(tree, cell, y, w) or (tree, cell, w, s, q): each tree's drawn rows, summed by cell and class, or by cell."""
    keys, powers = (["cell", "y"], 1) if classes else (["cell"], 3)
    rate, replace, seed = base.getSubsamplingRate(), base.getBootstrap(), base.getSeed() % 2**32

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return drawn_sums(batches, keys, STANDS_FOR, trees, rate, replace, powers, [seed, TaskContext.get().partitionId()])

    kinds = ["cell string", *(["y double"] if classes else []), "first int", *(f"{c} array<double>" for c in "wsq")]
    parts = binned.mapInPandas(drawn, ", ".join(kinds)).select(*keys, "first", F.posexplode(F.arrays_zip("w", "s", "q")).alias("place", "sums"))
    parts = parts.select(*keys, (F.col("first") + F.col("place")).alias("tree"), "sums.*").filter("w > 0")
    return parts.groupBy("tree", *keys).agg(*[F.sum(c).alias(c) for c in "wsq"[:powers]])


def _grower(base: RandomForestClassifier | RandomForestRegressor, most: dict[tuple, int], width: int, classes: int, mean: float):
    """Grows a tree from its cells, once for every way to grow that has so many trees."""
    seed = base.getSeed() % 2**32
    ways = [(*way[:-1], _drawn_features(way[-1], width, bool(classes)), trees) for way, trees in most.items()]

    def grow(cells: pd.DataFrame) -> pd.DataFrame:
        cells, tree = cells.sort_values([c for c in ("cell", "y") if c in cells], ignore_index=True), int(cells["tree"].iloc[0])
        place, names = pd.factorize(cells["cell"])
        bins = np.array([name.split(",") for name in names], dtype=int)
        if classes:
            sums = np.zeros((len(names), classes))
            sums[place, cells["y"].to_numpy().astype(int)] = cells["w"]
        else:
            sums = cells[["w", "s", "q"]].to_numpy()
        out = []
        for way, (kind, depth, gain, least, share, features, trees) in enumerate(ways):
            if tree < trees:
                found = grow_tree(bins, sums, kind, features, depth, max(least, share * cells["w"].sum()), gain, np.random.default_rng([seed, tree]))
                if not classes:
                    found["value"] = found["value"] + mean
                out.append({"grower": way, "tree": tree, **found})
        return pd.DataFrame(out)

    return grow


def _drawn_features(strategy: str, width: int, classifies: bool) -> int:
    """How many features MLlib draws at a node of one of several trees."""
    if strategy == "auto":
        strategy = "sqrt" if classifies else "onethird"
    named = {"all": width, "sqrt": math.sqrt(width), "log2": max(1.0, math.log2(width)), "onethird": width / 3}
    if strategy in named:
        return math.ceil(named[strategy])
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


def _bins(x: Column, cuts: list[list[float]]) -> Column:
    """The bin of every feature: how many of its cuts are below it."""

    def bin_of(value: Column, own: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, own)), lambda cut: cut < value)) if own else F.lit(0)

    return F.array(*[bin_of(F.get(x, F.lit(i)), own) for i, own in enumerate(cuts)])


def _cuts(rows: DataFrame, bins: int, tables: Tables) -> list[list[float]]:
    """Each feature's cuts: between all its values if these are few, else between shares of the rows of about one size."""
    values = tables.keep(rows.select(F.posexplode("x").alias("i", "v"), STANDS_FOR).groupBy("i", "v").agg(F.sum(STANDS_FOR).alias(STANDS_FOR)), "forest-values")
    counts = {r["i"]: r["count"] for r in values.groupBy("i").count().collect()}  # one row a feature
    few = F.col("i").isin([i for i, n in counts.items() if n <= bins])
    shares = every_row(values.filter(~few)).groupBy("i").agg(F.percentile_approx("v", [b / bins for b in range(1, bins)], 10_000).alias("tops"))
    listed = shares.unionByName(values.filter(few).groupBy("i").agg(F.collect_list("v").alias("tops")))
    tops = [(r["i"], sorted(set(r["tops"]))) for r in listed.collect()]  # at most ``bins`` numbers a feature
    known = F.broadcast(rows.sparkSession.createDataFrame(tops, "i int, tops array<double>"))
    placed = values.join(known, "i").withColumn("bin", F.size(F.filter("tops", lambda t: t < F.col("v"))))
    ends: list[list[tuple[float, float]]] = [[] for _ in counts]
    for r in placed.groupBy("i", "bin").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("i", "bin").collect():
        ends[r["i"]].append((r["low"], r["high"]))
    # A cut lies halfway between neighbouring values.
    return [[(before[1] + after[0]) / 2 for before, after in zip(e, e[1:])] for e in ends]


def _arrays(row: Any) -> dict[str, np.ndarray]:
    return {k: np.array(v) for k, v in row.asDict().items()}


class ForestModel(SavedModel, Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol):
    """Trees over cells: the mean of their predictions, or the sum of their shares by class."""

    def __init__(self, trees: list[dict[str, np.ndarray]], cuts: list[list[float]], classes: int):
        super().__init__()
        self.trees, self.cuts, self.classes = trees, cuts, classes

    @property
    def featureImportances(self) -> DenseVector:
        mean = np.mean([t["importance"] for t in self.trees], axis=0)
        return DenseVector(mean / (mean.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept, trees, width = [col(c) for c in dataset.columns], self.trees, self.classes or 1

        @F.pandas_udf("array<double>")
        def votes(bins: pd.Series) -> pd.Series:
            return pd.Series(list(forest_votes(as_matrix(bins).astype(int), trees, width))) if len(bins) else pd.Series([], dtype=object)

        table = dataset.withColumn("_x", vector_to_array(col(self.getFeaturesCol())))
        table = table.withColumn("_votes", votes(_bins(F.col("_x"), self.cuts)))
        if not self.classes:
            return table.select(*kept, (F.get("_votes", F.lit(0)) / len(trees)).alias(self.getPredictionCol()))
        return table.select(
            *kept,
            array_to_vector("_votes").alias(self.getRawPredictionCol()),
            array_to_vector(F.transform("_votes", lambda v: v / len(trees))).alias(self.getProbabilityCol()),
            # The first class wins a tie.
            (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias(self.getPredictionCol()),
        )

    def settings(self) -> dict[str, Any]:
        return {"cuts": self.cuts, "classes": self.classes}

    def save_parts(self, path: str, spark: SparkSession) -> None:
        rows = [(i, *[v.tolist() for v in t.values()]) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, f"tree int, {_TREE}").coalesce(1).write.parquet(f"{path}/trees")

    @classmethod
    def from_parts(cls, settings: dict[str, Any], path: str, spark: SparkSession) -> "ForestModel":
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").drop("tree").collect()  # one row a tree
        return cls([_arrays(r) for r in rows], settings["cuts"], settings["classes"])


def from_cells(estimator: Estimator) -> Estimator:
    """A forest without weights of its own, fitted on cells where these are few."""
    if not isinstance(estimator, DRAWING) or any(estimator.hasParam(p) and estimator.isSet(estimator.getParam(p)) for p in ("weightCol", "thresholds", "leafCol")):
        return estimator
    return Forest(estimator)
