"""Aggregate expressions: corrected skewness, safe correlation, null counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_count(c: Column) -> Column:
    return F.count_if(c.isNull())


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant, NULL below three values."""
    n = F.count(c).cast("double")
    spread = F.max(c) - F.min(c)
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(spread == 0, F.lit(0.0)).otherwise(F.skewness(c) * factor)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL on a constant.

    The built-in ``corr`` raises on a constant column under ANSI mode.
    """
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    r = F.try_divide(F.regr_sxy(a, b), spread)
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rows_from(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn a one-row table of statistics into one row per struct."""
    return one_row.select(F.inline(F.array(*rows)))
