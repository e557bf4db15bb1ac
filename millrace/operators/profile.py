"""Counts, distinct values, moments and quality of whole tables in few passes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import INTEGRAL, as_double, as_list, col, digest, kinds, numeric_columns, require
from ..functions.moments import null_count, rows_from, share
from .quantiles import exact_quantiles


# -- building blocks --------------------------------------------------------
def _by_field(df: DataFrame, columns: list[str], whole: bool) -> list[DataFrame]:
    """(column number, value) tables, one each for whole numbers, floats and the rest.

    Every table reads its own columns only, so together they read each column once.
    """
    fields: dict[str, list[Column]] = {}
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        if isinstance(dtype, INTEGRAL):
            field, value = "bigint", col(c)
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            field, value = "double", col(c)
        else:
            field, value = "string", col(c) if whole else digest(df, c)
        fields.setdefault(field, []).append(value.cast(field).alias(str(i)))
    return [df.select(*named).unpivot([], None, "_c", "_v") for named in fields.values()]


def value_summary(df: DataFrame, columns: Iterable[str], modes: bool = False) -> DataFrame:
    """One row: per column i its distinct count u<i>, top frequency m<i> and mode t<i>.

    Columns of one kind are counted in one shuffle of (column, value) pairs, combined
    on the map side first. Modes are returned as text, the smallest value among ties;
    without them long text travels as a digest.
    """
    columns = as_list(columns)
    if not columns:
        return df.sparkSession.range(1).select()
    parts = []
    for cells in _by_field(df, columns, modes):
        counts = cells.filter(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))
        summary = counts.groupBy("_c").agg(
            F.count(F.lit(1)).alias("_u"), F.max("_n").alias("_m"), *([best.alias("_b")] if modes else [])
        )
        mode = [F.col("_b.v").cast("string").alias("_t")] if modes else []
        parts.append(summary.select(F.col("_c").cast("int").alias("_c"), "_u", "_m", *mode))
    per_column = reduce(DataFrame.unionByName, parts)
    wide: list[Column] = []
    for i in range(len(columns)):
        mine = F.col("_c") == i
        wide += [
            F.coalesce(F.max(F.when(mine, F.col("_u"))), F.lit(0)).alias(f"u{i}"),
            F.coalesce(F.max(F.when(mine, F.col("_m"))), F.lit(0)).alias(f"m{i}"),
        ]
        if modes:
            wide.append(F.max(F.when(mine, F.col("_t"))).alias(f"t{i}"))
    return per_column.agg(*wide)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, and how many of them repeat an earlier one."""
    keys = [digest(df, c).alias(f"_d{i}") for i, c in enumerate(df.columns)]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")
    return groups.agg(total, (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))


def beside(*one_row_tables: DataFrame) -> DataFrame:
    """Put one-row tables next to each other."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one_row_tables)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("bigint"))


# -- profile ----------------------------------------------------------------
def overview(df: DataFrame) -> DataFrame:
    """One row: shape, missing cells and share, and columns per type class."""
    by_kind = list(kinds(df).values())
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    missing = total([F.col(f"n{i}") for i in range(len(df.columns))])
    cells = F.col("rows") * len(df.columns)
    return counted.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        missing.alias("missing_cells"),
        (share(missing, cells) * 100).alias("missing_pct"),
        *[F.lit(by_kind.count(k)).alias(f"{k}_columns") for k in ("numeric", "boolean", "text", "datetime", "other")],
    )


def column_info(df: DataFrame) -> DataFrame:
    """One row per column: type, missing and distinct values."""
    nulls = df.agg(*[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    one_row = beside(nulls, value_summary(df, df.columns))
    return rows_from(
        one_row,
        [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"n{i}").alias("missing"),
                F.col(f"u{i}").alias("unique"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )


def column_stats(df: DataFrame, columns: Iterable[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: counts, and mean, median, std, min, max of numbers.

    ``exact=False`` takes the median from a sketch in the same pass.
    """
    columns = as_list(columns) if columns is not None else list(df.columns)
    require(df, columns)
    numeric = [c for c in columns if c in numeric_columns(df, booleans=True)]
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        wanted.append(F.count(col(c)).alias(f"n{i}"))
        if c in numeric:
            x = as_double(df, c)
            wanted += [F.avg(x).alias(f"avg{i}"), F.stddev_samp(x).alias(f"std{i}")]
            wanted += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
            if not exact:
                wanted.append(F.percentile_approx(x, F.lit(0.5), F.lit(10_000)).alias(f"med{i}"))
    parts = [df.agg(*wanted), value_summary(df, columns)]
    if exact and numeric:
        medians = exact_quantiles(df, numeric, [0.5])
        parts.append(medians.select(*[col(f"{c}__0").alias(f"med{columns.index(c)}") for c in numeric]))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def row(i: int, c: str) -> Column:
        def number(part: str) -> Column:
            return (F.col(f"{part}{i}") if c in numeric else F.lit(None).cast("double")).cast("double")

        missing = F.col("rows") - F.col(f"n{i}")
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("type"),
            F.col(f"n{i}").alias("count"),
            missing.alias("missing"),
            (share(missing, F.col("rows")) * 100).alias("missing_pct"),
            F.col(f"u{i}").alias("unique"),
            number("avg").alias("mean"),
            number("med").alias("median"),
            number("std").alias("std"),
            number("min").alias("min"),
            number("max").alias("max"),
        )

    return rows_from(beside(*parts), [row(i, c) for i, c in enumerate(columns)])


def value_counts(df: DataFrame, name: str, k: int | None = 10, dropna: bool = True) -> DataFrame:
    """Values by frequency, ties by value; all of them when ``k`` is None."""
    require(df, name)
    rows = df.filter(col(name).isNotNull()) if dropna else df
    counts = rows.groupBy(col(name)).agg(F.count(F.lit(1)).alias("count"))
    return counts if k is None else counts.orderBy(F.desc("count"), col(name).asc_nulls_last()).limit(k)


def top_values(df: DataFrame, columns: Iterable[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values of every column as (column, rank, value, count)."""
    columns = as_list(columns) if columns is not None else list(df.columns)
    require(df, columns)
    counts = (
        df.select(*[col(c).cast("string").alias(c) for c in columns])
        .unpivot([], None, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    # Spark applies the rank limit on the map side before it shuffles.
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("column", "rank", "value", "count")


def profile(df: DataFrame, k: int = 1, exact: bool = True) -> DataFrame:
    """Whole-table profile: column statistics plus each column's top values."""
    tops = (
        top_values(df, k=k)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
    )
    return column_stats(df, exact=exact).join(F.broadcast(tops), "column", "left")


def type_listing(df: DataFrame, order_by: Iterable[str], k: int = 3) -> DataFrame:
    """One row per column: type and its first non-null values in the given order."""
    order = [col(c) for c in as_list(order_by)]
    listed = []
    for i, f in enumerate(df.schema.fields):
        first = df.filter(col(f.name).isNotNull()).orderBy(*order).limit(k)
        samples = first.agg(F.collect_list(col(f.name).cast("string")).alias("samples"))
        listed.append(
            samples.select(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), "samples"
            )
        )
    return reduce(DataFrame.unionByName, listed)


# -- quality ----------------------------------------------------------------
def quality_score(df: DataFrame) -> DataFrame:
    """One row: completeness 40, consistency 30, uniqueness 20 and validity 10 points.

    Every column earns at least one consistency point, and the mean is scaled by
    30 and capped there, so that term is always full; ``typed_column_share`` tells
    the columns that are numbers, booleans or dates apart from the rest.
    """
    by_kind = kinds(df)
    numbers = numeric_columns(df)
    nulls = [null_count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    negatives = [F.coalesce(F.bool_or(col(c) < 0), F.lit(False)).cast("int").alias(f"g{i}") for i, c in enumerate(numbers)]
    table = df.agg(F.lit(1).alias("_one"), *nulls, *negatives)
    one_row = beside(table, duplicate_count(df))

    width = len(df.columns)
    typed = sum(k in ("numeric", "boolean", "datetime") for k in by_kind.values())
    points = 3 * typed + (width - typed)
    consistency = min(30.0, points / width * 30) if width else 0.0
    missing = total([F.col(f"n{i}") for i in range(width)])
    cells = F.col("rows") * width
    missing_share, dup_share = share(missing, cells), share(F.col("duplicates"), F.col("rows"))
    filled = F.when(cells > 0, (1 - missing_share) * 40).otherwise(0.0)
    unique = F.when(F.col("rows") > 0, F.greatest(F.lit(0.0), 20 - dup_share * 20)).otherwise(0.0)
    validity = F.greatest(F.lit(0), F.lit(10) - total([F.col(f"g{i}") for i in range(len(numbers))])).cast("double")
    return one_row.select(
        F.round(filled + F.lit(consistency) + unique + validity, 2).alias("total_score"),
        F.round(filled, 2).alias("completeness"),
        F.round(F.lit(consistency), 2).alias("consistency"),
        F.round(unique, 2).alias("uniqueness"),
        F.round(validity, 2).alias("validity"),
        F.round(missing_share * 100, 2).alias("missing_percentage"),
        F.col("duplicates").alias("duplicate_rows"),
        F.round(dup_share * 100, 2).alias("duplicate_percentage"),
        F.lit(typed / width if width else 0.0).alias("typed_column_share"),
    )


def quality_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")
    )


def next_step(df: DataFrame) -> DataFrame:
    """One row advising what to do next: impute, clean text, or continue."""
    advice = F.when(F.col("missing_pct") > 20, "impute")
    advice = advice.when(F.col("text_columns") > 0, "clean text").otherwise("continue")
    return overview(df).select("missing_pct", advice.alias("advice"))


def cleaning_report(before: DataFrame, after: DataFrame, steps: Iterable[str] = ()) -> DataFrame:
    """One row comparing a table before and after cleaning."""
    steps = as_list(steps)

    def shape(df: DataFrame, tag: str) -> DataFrame:
        missing = total([null_count(col(c)) for c in df.columns])
        counts = df.agg(missing.alias(f"missing_{tag}"))
        dups = duplicate_count(df).select(F.col("rows").alias(f"rows_{tag}"), F.col("duplicates").alias(f"duplicates_{tag}"))
        return beside(counts, dups)

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    one_row = beside(shape(before, "before"), shape(after, "after"), quality_score(after).select("total_score"))
    return one_row.select(
        "rows_before",
        "rows_after",
        F.lit(len(before.columns)).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        texts(sorted(set(before.columns) - set(after.columns))).alias("columns_removed"),
        texts(sorted(set(after.columns) - set(before.columns))).alias("columns_added"),
        "missing_before",
        "missing_after",
        (F.col("missing_before") - F.col("missing_after")).alias("missing_values_removed"),
        (F.col("duplicates_before") - F.col("duplicates_after")).alias("duplicates_removed"),
        F.col("total_score").alias("data_quality_score"),
        F.lit(len(steps)).alias("total_actions"),
        texts(steps[-50:]).alias("recent_actions"),
    )
