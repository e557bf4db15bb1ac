"""Learned outliers of one numeric column: isolation forest and local outlier factor."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import expected_depth, grow_intervals, local_factors, merge_steps
from ..functions.kinds import as_double, as_list, col, require_numeric
from .outliers import validate_anomaly
from .ordering import with_position
from .quantiles import exact_quantiles

TREES, SAMPLE = 100, 256


def _checked(df: DataFrame, name: str, contamination: float) -> None:
    errors = [r["message"] for r in validate_anomaly(df, name, contamination).collect() if r["level"] == "error"]
    if errors:
        raise ValueError("; ".join(errors))


# -- isolation forest -------------------------------------------------------
def _grow_tree(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        values = np.sort(pdf["_v"].to_numpy(dtype=float))
        rng = np.random.default_rng([seed, tree])
        cuts, depths = grow_intervals(values, rng, int(np.ceil(np.log2(max(len(values), 2)))))
        return pd.DataFrame({"_tree": [tree], "cuts": [cuts], "depths": [depths]})

    return grow


def isolation_scores(
    df: DataFrame, name: str, seed: int = 42, key: str | Iterable[str] | None = None, target: str = "score"
) -> DataFrame:
    """Adds the anomaly score in (0, 1); higher is more isolated, NULL stays NULL.

    A bounded sample (trees times sample size) is drawn once by a seeded hash of
    ``key``, or of all columns without one. Each tree is grown in its own task; the
    grown trees are a bounded set of cut points that scores every row in Arrow
    batches.
    """
    require_numeric(df, name)
    draw = F.xxhash64(F.lit(seed), *[col(k) for k in as_list(key) or df.columns])
    values = df.select(draw.alias("_draw"), as_double(df, name).alias("_v")).filter(F.col("_v").isNotNull())
    pool = values.orderBy("_draw", "_v").limit(TREES * SAMPLE)
    rows = pool.collect()
    spark = df.sparkSession
    size = min(SAMPLE, len(rows))
    sample = spark.createDataFrame([(float(r["_v"]), i) for i, r in enumerate(rows)], "_v double, _i int")
    trees = sample.crossJoin(F.broadcast(spark.range(TREES).select(F.col("id").cast("int").alias("_tree"))))
    # Every tree draws its own rows from the pool, at most TREES * SAMPLE of them, by hash.
    chosen = trees.withColumn("_h", F.xxhash64(F.lit(seed), "_tree", "_i"))
    edge = chosen.groupBy("_tree").agg(F.sort_array(F.collect_list("_h")).alias("_hs"))
    edge = edge.select("_tree", F.element_at("_hs", size).alias("_edge"))
    chosen = chosen.join(F.broadcast(edge), "_tree").filter(F.col("_h") <= F.col("_edge"))
    forest = chosen.select("_tree", "_v").groupBy("_tree").applyInPandas(
        _grow_tree(seed), "_tree int, cuts array<double>, depths array<double>"
    ).collect()
    steps = [(np.asarray(t["cuts"], dtype=float), np.asarray(t["depths"], dtype=float)) for t in forest]
    edges, means = merge_steps(steps)
    scale = expected_depth(size) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            depth = means[np.searchsorted(edges, x, side="left")]
            yield pd.Series(np.where(np.isnan(x), np.nan, 2.0 ** (-depth / scale)))

    scored = df.withColumn(target, score(as_double(df, name)))
    return scored.withColumn(target, F.when(as_double(df, name).isNotNull(), F.col(target)))


def isolation_forest(
    df: DataFrame, name: str, contamination: float = 0.1, seed: int = 42, key: str | Iterable[str] | None = None
) -> DataFrame:
    """Flags the ``contamination`` share of rows that isolate most easily."""
    _checked(df, name, contamination)
    scored = isolation_scores(df, name, seed, key, "_score")
    return _flag_top(scored, df.columns, contamination)


def _flag_top(scored: DataFrame, columns: list[str], contamination: float) -> DataFrame:
    cut = exact_quantiles(scored, ["_score"], [1 - contamination]).select(F.col("_score__0").alias("_cut"))
    judged = scored.crossJoin(F.broadcast(cut))
    flagged = F.coalesce(F.col("_score") > F.col("_cut"), F.lit(False))
    return judged.select(*[col(c) for c in columns if c != "is_outlier"], flagged.alias("is_outlier"))


# -- local outlier factor ---------------------------------------------------
CHUNK = 50_000


def local_outlier_factors(df: DataFrame, name: str, k: int = 20, target: str = "lof") -> DataFrame:
    """Adds the local outlier factor among the column's values; NULL stays NULL.

    In one dimension the k nearest values lie within k sorted positions, so the
    table is cut into position chunks of fixed size, each with the 3k positions
    around it that its factors depend on.
    """
    require_numeric(df, name)
    tagged = df.withColumn("_v", as_double(df, name))
    known = tagged.filter(F.col("_v").isNotNull())
    size = known.count()
    if size < 2:
        return df.withColumn(target, F.when(as_double(df, name).isNotNull(), F.lit(1.0)))
    k = min(k, size - 1)
    placed = with_position(known, ["_v"], "_pos")
    halo, chunk = 3 * k + 1, max(CHUNK, 6 * k)
    home = F.floor(F.col("_pos") / chunk)
    first, last = F.floor((F.col("_pos") - halo) / chunk), F.floor((F.col("_pos") + halo) / chunk)
    spread = placed.select("_v", "_pos", home.alias("_home"), F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("_chunk"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        mine = (pdf["_home"] == pdf["_chunk"]).to_numpy()
        if not mine.any():
            return pd.DataFrame({"_at": pd.Series(dtype="int64"), target: pd.Series(dtype="float64")})
        values = pdf["_v"].to_numpy(dtype=float)
        found = local_factors(values, k)
        return pd.DataFrame({"_at": pdf["_pos"].to_numpy()[mine], target: found[mine]})

    scored = spread.groupBy("_chunk").applyInPandas(score, f"_at bigint, `{target}` double")
    joined = placed.join(scored, F.col("_pos") == F.col("_at"))
    present = joined.select(*[col(c) for c in df.columns], col(target))
    absent = tagged.filter(F.col("_v").isNull()).select(*[col(c) for c in df.columns], F.lit(None).cast("double").alias(target))
    return present.unionByName(absent)


def local_outlier_factor(df: DataFrame, name: str, contamination: float = 0.1, k: int = 20) -> DataFrame:
    """Flags the ``contamination`` share of rows with the largest factor."""
    _checked(df, name, contamination)
    return _flag_top(local_outlier_factors(df, name, k, "_score"), df.columns, contamination)
