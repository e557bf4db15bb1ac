"""The tables behind charts: series, bins, boxes, trend lines and shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import SALT, salted_join
from ..functions.kinds import as_double, as_list, col, require, require_numeric
from .ordering import with_position
from .quantiles import exact_quantiles

__all__ = ["box_stats", "histogram", "ols", "series", "value_share", "with_position"]


def series(df: DataFrame, x: str, ys: Iterable[str], group: str | None = None) -> DataFrame:
    """Long form (x, [group], Series, Value) of one or more numeric columns."""
    ys, ids = as_list(ys), [x] + as_list(group)
    require(df, ids)
    require_numeric(df, ys)
    # A column may be both x and y, so the ids travel under other names.
    table = df.select(*[col(c).alias(f"_id{n}") for n, c in enumerate(ids)], *[as_double(df, y).alias(y) for y in ys])
    long = table.unpivot([f"_id{n}" for n in range(len(ids))], None, "Series", "Value")
    return long.select(*[F.col(f"_id{n}").alias(c) for n, c in enumerate(ids)], "Series", "Value")


def histogram(df: DataFrame, name: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Count per equal-width bin over the column's range, empty bins left out.

    The last bin includes the maximum. A constant column falls into bin 0. With
    ``group`` the bins are shared and the counts are per group.
    """
    require_numeric(df, name)
    if bins < 1:
        raise ValueError("bins must be positive")
    keys = as_list(group)
    require(df, keys)
    values = df.select(*[col(k) for k in keys], as_double(df, name).alias("_v")).filter(F.col("_v").isNotNull())
    edges = values.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), width), F.lit(0.0))), F.lit(bins - 1))
    counted = (
        values.crossJoin(F.broadcast(edges))
        .groupBy(*[col(k) for k in keys], place.cast("int").alias("bin"), "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counted.select(
        *[col(k) for k in keys],
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "count",
    )


def box_stats(df: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and outlier count."""
    require_numeric(df, name)
    keys = as_list(group)
    require(df, keys)
    values = df.select(*[col(k) for k in keys], as_double(df, name).alias("_v")).dropna()
    quartiles = exact_quantiles(values, ["_v"], [0.25, 0.5, 0.75], keys)
    quartiles = quartiles.select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_v__0").alias("q1"),
        F.col("_v__1").alias("median"),
        F.col("_v__2").alias("q3"),
    )
    if keys:
        joined = salted_join(values, quartiles, [(k, f"_k{i}") for i, k in enumerate(keys)])
    else:
        joined = values.crossJoin(F.broadcast(quartiles)).withColumn(SALT, F.lit(0))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    at = [*[col(k) for k in keys], "q1", "median", "q3"]
    per_part = joined.groupBy(*at, SALT).agg(
        F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("count"),
    )
    return per_part.groupBy(*at).agg(
        F.min("lower_whisker").alias("lower_whisker"),
        F.max("upper_whisker").alias("upper_whisker"),
        F.sum("outliers").alias("outliers"),
        F.sum("count").alias("count"),
    )


def ols(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Least-squares line y = intercept + slope * x, optionally per group."""
    require_numeric(df, [x, y])
    keys = as_list(group)
    require(df, keys)
    pairs = df.select(*[col(k) for k in keys], as_double(df, x).alias("_x"), as_double(df, y).alias("_y"))
    xc, yc = F.col("_x"), F.col("_y")
    both = xc.isNotNull() & yc.isNotNull()
    moved = F.max(F.when(both, xc)) > F.min(F.when(both, xc))
    return pairs.groupBy(*[col(k) for k in keys]).agg(
        F.when(moved, F.regr_slope(yc, xc)).alias("slope"),
        F.when(moved, F.regr_intercept(yc, xc)).alias("intercept"),
        F.when(moved, F.regr_r2(yc, xc)).alias("r2"),
        F.count_if(both).alias("count"),
    )


def value_share(df: DataFrame, name: str) -> DataFrame:
    """Each non-null value with its count and share of the non-null rows."""
    require(df, name)
    counts = df.filter(col(name).isNotNull()).groupBy(col(name)).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(col(name)).alias("_total"))
    joined = counts.crossJoin(F.broadcast(total))
    return joined.select(col(name), "count", F.try_divide(F.col("count").cast("double"), F.col("_total")).alias("share"))
