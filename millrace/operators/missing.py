"""Finding and filling missing values."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.kinds import as_double, as_list, col, is_integral, kinds, numeric_columns, require, require_numeric, text_columns
from ..functions.moments import null_count, rows_from, sample_skew, share
from .ordering import bfill, ffill
from .pivot import AGGREGATES, group_statistics
from .profile import beside, total, value_summary
from .quantiles import exact_quantiles

__all__ = [
    "apply_cleaning", "bfill", "ffill", "fill", "fill_by_group", "fill_report",
    "fill_where", "missing_summary", "recommend_fill", "suggest_cleaning",
]

UNKNOWN = "Unknown"
_QUANTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}
METHODS = ("mean", "median", "mode", "min", "max", "p10", "p90", "constant", "unknown")


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and % of rows, most missing first."""
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    listed = rows_from(
        stats,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("missing_count"),
                (share(F.col(f"n{i}"), F.col("rows")) * 100).alias("missing_pct"),
            )
            for i, c in enumerate(df.columns)
        ],
    )
    return listed.filter(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "column")


# -- fill by statistic ------------------------------------------------------
def mode_of(df: DataFrame, name: str) -> DataFrame:
    """One row with the most frequent value, smallest among ties, NULL if none."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))
    return counts.agg(best.alias("_b")).select(F.col("_b.v").alias("value"))


def _quantile_row(df: DataFrame, columns: list[str], prob: float, exact: bool) -> DataFrame:
    if exact:
        found = exact_quantiles(df, columns, [prob])
        return found.select(*[col(f"{c}__0").alias(f"s{i}") for i, c in enumerate(columns)])
    return df.agg(
        *[F.percentile_approx(as_double(df, c), F.lit(prob), F.lit(10_000)).alias(f"s{i}") for i, c in enumerate(columns)]
    )


def fill(
    df: DataFrame,
    columns: str | Iterable[str],
    method: str,
    value: Any = None,
    exact: bool = True,
    widen: bool = False,
) -> DataFrame:
    """Fill NULLs of one or more columns by a whole-column statistic or constant.

    Whole-number columns filled with a mean or quantile become doubles. A
    constant that does not fit the column is an error unless ``widen`` makes the
    column text. ``exact=False`` takes quantiles from a sketch.
    """
    columns = as_list(columns)
    require(df, columns)
    if method == "constant":
        return df.withColumns({c: _fill_constant(df, c, value, widen) for c in columns})
    if method == "unknown":
        return df.withColumns({c: _fill_constant(df, c, UNKNOWN, widen) for c in columns})
    if method == "mode":
        return _fill_mode(df, columns)
    require_numeric(df, columns)
    if method == "mean":
        stats = df.agg(*[F.avg(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)])
    elif method in ("min", "max"):
        pick = F.min if method == "min" else F.max
        stats = df.agg(*[pick(col(c)).alias(f"s{i}") for i, c in enumerate(columns)])
    elif method in _QUANTILES:
        stats = _quantile_row(df, columns, _QUANTILES[method], exact)
    else:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    wide = df.crossJoin(F.broadcast(stats))
    filled = {c: F.coalesce(col(c), F.col(f"s{i}")) for i, c in enumerate(columns)}
    return wide.withColumns(filled).drop(*[f"s{i}" for i in range(len(columns))])


def _fill_constant(df: DataFrame, name: str, value: Any, widen: bool) -> Column:
    dtype = df.schema[name].dataType
    fitting = scalar.literal_for(value, dtype, widen)
    if fitting is None:
        return F.coalesce(scalar.text_form(col(name), dtype), F.lit(str(value)))
    return F.coalesce(col(name), fitting)


def _fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    # All modes in one pass over the columns of a kind; they come back as text.
    modes = value_summary(df, columns, modes=True).select(*[F.col(f"t{i}").cast(df.schema[c].dataType).alias(f"s{i}") for i, c in enumerate(columns)])
    wide = df.crossJoin(F.broadcast(modes))
    filled = {}
    for i, c in enumerate(columns):
        text = isinstance(df.schema[c].dataType, T.StringType)
        filled[c] = F.coalesce(col(c), F.col(f"s{i}"), *([F.lit(UNKNOWN)] if text else []))
    return wide.withColumns(filled).drop(*[f"s{i}" for i in range(len(columns))])


# -- recommendations --------------------------------------------------------
def _by_skew(skew: Column, mean: Any, median: Any, low: Any, high: Any, otherwise: Any = None) -> Column:
    """Choose by skewness; too few values to tell counts as symmetric."""
    size = F.abs(F.coalesce(skew, F.lit(0.0)))
    return F.when(size < 0.5, F.lit(mean)).when(size < 1.5, F.lit(median)).when(skew > 0, F.lit(low)).otherwise(F.lit(high))


def recommend_fill(df: DataFrame, name: str) -> DataFrame:
    """One row: the fill method suggested for a column and its skewness."""
    require(df, name)
    if name not in numeric_columns(df, booleans=True):
        return df.agg(F.lit(name).alias("column"), F.lit(None).cast("double").alias("skew"), F.lit("mode").alias("method"))
    skew = df.agg(sample_skew(as_double(df, name)).alias("skew"))
    return skew.select(F.lit(name).alias("column"), "skew", _by_skew(F.col("skew"), "mean", "median", "p10", "p90").alias("method"))


def suggest_cleaning(df: DataFrame) -> DataFrame:
    """One row per column with missing values: what to do and why."""
    by_kind, texts = kinds(df), text_columns(df)
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        wanted.append(null_count(col(c)).alias(f"n{i}"))
        if by_kind[c] in ("numeric", "boolean"):
            wanted.append(sample_skew(as_double(df, c)).alias(f"k{i}"))
    one_row = df.agg(*wanted)
    if texts:
        one_row = beside(one_row, value_summary(df, texts))

    def row(i: int, c: str) -> Column:
        pct = share(F.col(f"n{i}"), F.col("rows")) * 100
        action, reason = F.lit("None"), F.lit("")
        if by_kind[c] in ("numeric", "boolean"):
            action = _by_skew(
                F.col(f"k{i}"), "Fill with Mean", "Fill with Median", "Fill with 10th Percentile", "Fill with 90th Percentile"
            )
            reason = _by_skew(
                F.col(f"k{i}"), "the values lie evenly around their mean", "one tail pulls the mean away", "a long tail of large values", "a long tail of small values"
            )
        elif by_kind[c] == "text":
            j = texts.index(c)
            top = share(F.col(f"m{j}"), F.col("rows"))
            action = F.when(top > 0.5, "Fill with Mode").otherwise('Fill with "Unknown"')
            clear = F.format_string("one value makes up %.1f%% of the rows", top * 100)
            reason = F.when(F.col(f"u{j}") == 0, "no value to take").when(top > 0.5, clear).otherwise("no value leads")
        elif by_kind[c] == "datetime":
            action, reason = F.lit("Forward Fill"), F.lit("times follow the row before")
        sparse = pct > 80
        return F.struct(
            F.lit(c).alias("column"),
            F.round(pct, 2).alias("missing_pct"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.when(sparse, "Drop Column").otherwise(action).alias("action"),
            F.when(sparse, "Too many missing values (>80%)").otherwise(reason).alias("reason"),
            F.col(f"n{i}").alias("_missing"),
        )

    listed = rows_from(one_row, [row(i, c) for i, c in enumerate(df.columns)])
    return listed.filter(F.col("_missing") > 0).drop("_missing")


_ACTION_METHODS = {
    "Fill with Mean": "mean",
    "Fill with Median": "median",
    "Fill with 10th Percentile": "p10",
    "Fill with 90th Percentile": "p90",
    "Fill with Mode": "mode",
    'Fill with "Unknown"': "unknown",
}


def apply_cleaning(
    df: DataFrame, suggestions: DataFrame, columns: Iterable[str] | None = None, order_by: Iterable[str] | None = None
) -> DataFrame:
    """Carry out chosen suggestions; forward fills need an ``order_by``.

    The suggestions hold one row per column and are read on the driver, because
    dropping columns changes the schema.
    """
    chosen = set(as_list(columns)) if columns is not None else None
    actions = {r["column"]: r["action"] for r in suggestions.select("column", "action").collect()}
    actions = {c: a for c, a in actions.items() if c in df.columns and (chosen is None or c in chosen)}
    by_method: dict[str, list[str]] = {}
    for c, action in actions.items():
        if action in _ACTION_METHODS:
            by_method.setdefault(_ACTION_METHODS[action], []).append(c)

    parts, filled = [], {}
    direct = [F.avg(as_double(df, c)).alias(f"mean_{i}") for i, c in enumerate(by_method.get("mean", []))]
    if direct:
        parts.append(df.agg(*direct))
        filled |= {c: F.coalesce(col(c), F.col(f"mean_{i}")) for i, c in enumerate(by_method["mean"])}
    for method, prob in _QUANTILES.items():
        names = by_method.get(method, [])
        if names:
            row = _quantile_row(df, names, prob, exact=True)
            parts.append(row.select(*[F.col(f"s{i}").alias(f"{method}_{i}") for i in range(len(names))]))
            filled |= {c: F.coalesce(col(c), F.col(f"{method}_{i}")) for i, c in enumerate(names)}
    modes = by_method.get("mode", [])
    if modes:
        row = value_summary(df, modes, modes=True)
        parts.append(row.select(*[F.col(f"t{i}").alias(f"mode_{i}") for i in range(len(modes))]))
        filled |= {c: F.coalesce(col(c), F.col(f"mode_{i}"), F.lit(UNKNOWN)) for i, c in enumerate(modes)}
    filled |= {c: F.coalesce(col(c), F.lit(UNKNOWN)) for c in by_method.get("unknown", [])}

    result = df
    forward = [c for c, a in actions.items() if a == "Forward Fill"]
    if forward:
        if not order_by:
            raise ValueError(f"forward fill of {', '.join(forward)} needs order_by")
        result = ffill(result, forward, order_by)
    if parts:
        result = result.crossJoin(F.broadcast(beside(*parts)))
    dropped = {c for c, a in actions.items() if a == "Drop Column"}
    return result.select(*[filled.get(c, col(c)).alias(c) for c in df.columns if c not in dropped])


# -- fill by group ----------------------------------------------------------
def fill_by_group(
    df: DataFrame,
    rows: str | Iterable[str],
    values: str | Iterable[str],
    agg: str | Iterable[str] = "mean",
    mode: str = "primary",
    fill_value: float | None = None,
) -> DataFrame:
    """Fill NULLs with the statistic of the row's group.

    Groups are the distinct ``rows`` keys; a NULL key, or a group without any
    value, leaves the cell missing. With several aggregates ``mode`` picks the
    first (``primary``), the median if listed (``best``), or each in turn until one
    has a value (``all``). ``fill_value`` stands in for a missing statistic of a
    group that has another. The group table may be of any size: Spark broadcasts
    it when small and otherwise splits hot groups at run time.
    """
    rows, values, aggs = as_list(rows), as_list(values), as_list(agg)
    require(df, rows)
    require_numeric(df, values)
    if set(aggs) - set(AGGREGATES) or not aggs:
        raise ValueError(f"aggregates must be among {AGGREGATES}, not {aggs}")
    if mode == "primary":
        order = aggs[:1]
    elif mode == "best":
        order = ["median"] if "median" in aggs else aggs[:1]
    elif mode == "all":
        order = aggs
    else:
        raise ValueError(f"mode must be primary, best or all, not {mode!r}")
    stats = group_statistics(df, rows, values, aggs)
    cells = [col(f"{v}__{a}") for v in values for a in aggs]
    if fill_value is not None:
        stats = stats.withColumns({f"{v}__{a}": F.coalesce(col(f"{v}__{a}"), F.lit(float(fill_value))) for v in values for a in aggs})
    renamed = stats.select(
        *[col(r).alias(f"_g{i}") for i, r in enumerate(rows)],
        *[c.alias(f"_s{i}") for i, c in enumerate(cells)],
    )
    joined = df.join(renamed, [col(r) == F.col(f"_g{i}") for i, r in enumerate(rows)], "left")

    def filled(v: str) -> Column:
        picks = [F.col(f"_s{values.index(v) * len(aggs) + aggs.index(a)}") for a in order]
        kept = col(v)
        if is_integral(df, v) and set(order) <= {"sum", "min", "max", "count"}:
            picks = [p.cast("bigint") for p in picks]
        return F.coalesce(kept, *picks)

    return joined.select(*[filled(c).alias(c) if c in values else col(c) for c in df.columns])


def fill_report(before: DataFrame, after: DataFrame, targets: Iterable[str] = ()) -> DataFrame:
    """One row: cells filled in total and in the targets, remaining, columns changed."""
    targets = as_list(targets)
    shared = [c for c in before.columns if c in after.columns]
    old = before.agg(*[null_count(col(c)).alias(f"b{i}") for i, c in enumerate(shared)])
    new = after.agg(*[null_count(col(c)).alias(f"a{i}") for i, c in enumerate(shared)])
    gone = {c: F.col(f"b{i}") - F.col(f"a{i}") for i, c in enumerate(shared)}
    changed = F.array(*[F.when(gone[c] != 0, F.lit(c)) for c in shared])
    return beside(old, new).select(
        total(list(gone.values())).alias("filled"),
        total([gone[c] for c in targets]).alias("filled_in_targets"),
        total([F.col(f"a{i}") for i in range(len(shared))]).alias("remaining"),
        F.array_compact(changed).alias("columns_changed"),
    )


def fill_where(df: DataFrame, target: str, condition: Column, value: Any, widen: bool = False) -> DataFrame:
    """Fill only where the target is missing and the condition holds."""
    require(df, target)
    dtype = df.schema[target].dataType
    kept, fitting = col(target), scalar.literal_for(value, dtype, widen)
    if fitting is None:
        kept, fitting = scalar.text_form(kept, dtype), F.lit(str(value))
    applies = F.coalesce(condition, F.lit(False)) & col(target).isNull()
    return df.withColumn(target, F.when(applies, fitting).otherwise(kept))
