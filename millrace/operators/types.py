"""Suggesting, converting and narrowing column types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.kinds import INTEGRAL, as_list, col, kind_of, require, text_columns
from ..functions.moments import rows_from, share
from .profile import beside, value_summary

# Values read as booleans, and the shorter list of the strict variant (fixed values).
TRUE_TEXT = ("True", "true", "1", "yes", "Yes", "Y", "y")
FALSE_TEXT = ("False", "false", "0", "no", "No", "N", "n")
STRICT_TRUE = ("True", "true", "1")
STRICT_FALSE = ("False", "false", "0")

# Shares a suggestion must exceed or stay below (fixed values).
DATE_SHARE, NUMBER_SHARE, SURE_SHARE, CATEGORY_SHARE = 0.8, 0.9, 0.95, 0.05


# Longer texts are judged row by row: sent over whole to be judged once, they would cost more.
LONG_TEXT = 200


# -- suggest ----------------------------------------------------------------
def _votes(text: Column) -> list[tuple[str, Column]]:
    """What one value says about its column."""
    number = scalar.to_number(text, T.StringType())
    bare = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    votes = [(f"d{j}", scalar.parse_timestamp(text, (f,)).isNotNull()) for j, f in enumerate(scalar.DATE_FORMATS)]
    votes += [("x", number.isNotNull()), ("w", F.coalesce(number == F.floor(number), F.lit(True)))]
    return [*votes, ("g", bare.rlike(r"^\d+$")), ("l", text.rlike(r"\p{L}"))]


def suggest_types(df: DataFrame) -> DataFrame:
    """Better types for text columns, judged on every value.

    Dates first, then numbers, then categories, then mixed content. Columns that
    need no change are left out. A value is judged once, however many rows hold it.
    """
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame(
            [], "column string, current_type string, suggested_type string, confidence string, match_pct double, format string, reason string"
        )
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), col(c).alias("_t")) for i, c in enumerate(texts)])))
    long = F.length("_t") > LONG_TEXT
    early = F.when(long, F.struct(*[v.alias(n) for n, v in _votes(F.col("_t"))], F.sha2("_t", 256).alias("_key")))
    values = cells.select("_c", F.when(~long, F.col("_t")).alias("_v"), early.alias("_e")).groupBy("_c", "_v", "_e").agg(F.count(F.lit(1)).alias("_n"))
    present, n = F.col("_v").isNotNull() | F.col("_e").isNotNull(), F.col("_n")
    wanted = [F.sum(n).alias("rows"), F.sum(F.when(present, n).otherwise(0)).alias("n"), F.count_if(present).alias("u")]
    for name, vote in _votes(F.col("_v")):
        vote = present & F.coalesce(F.when(F.col("_e").isNull(), vote).otherwise(F.col(f"_e.{name}")), F.lit(False))
        if name == "w":  # of all numbers
            wanted.append(F.bool_and(vote | ~present).alias(name))
        elif name in "gl":
            wanted.append(F.bool_or(vote).alias(name))
        else:
            wanted.append(F.sum(F.when(vote, n).otherwise(0)).alias(name))
    judged = values.groupBy("_c").agg(*wanted)
    found = judged.select(F.element_at(F.array(*[F.lit(c) for c in texts]), F.col("_c") + 1).alias("_name"), *[c for c in judged.columns if c != "_c"])
    return found.select(F.inline(F.array(_suggestion()))).filter(F.col("suggested_type").isNotNull())


def _suggestion() -> Column:
    n, rows = F.col("n"), F.col("rows")
    dates = [F.col(f"d{j}") for j in range(len(scalar.DATE_FORMATS))]
    best = F.greatest(*dates)
    # The earlier format wins a tie, so day-first beats month-first.
    fmt = F.coalesce(*[F.when(d == best, F.lit(f)) for d, f in zip(dates, scalar.DATE_FORMATS)])
    date_share, number_share, distinct_share = share(best, n), share(F.col("x"), n), share(F.col("u"), rows)
    is_date = date_share > DATE_SHARE
    is_number = ~is_date & (number_share > NUMBER_SHARE)
    is_category = ~is_date & ~is_number & (distinct_share < CATEGORY_SHARE)
    is_mixed = ~is_date & ~is_number & ~is_category & F.col("g") & F.col("l")
    suggested = (
        F.when(n == 0, None)
        .when(is_date, "datetime")
        .when(is_number & F.col("w"), "integer")
        .when(is_number, "float")
        .when(is_category, "category")
        .when(is_mixed, "string")
    )
    return F.struct(
        F.col("_name").alias("column"),
        F.lit("string").alias("current_type"),
        suggested.alias("suggested_type"),
        F.when(is_number & (number_share <= SURE_SHARE), "Medium").when(is_mixed, "Medium").otherwise("High").alias("confidence"),
        F.when(is_date, date_share * 100).when(is_number, number_share * 100).when(is_category, distinct_share * 100).alias("match_pct"),
        F.when(is_date, fmt).alias("format"),
        F.when(is_date, F.format_string("%.0f%% read as dates in the form %s", date_share * 100, fmt))
        .when(is_number, F.format_string("%.0f%% read as numbers", number_share * 100))
        .when(is_category, F.format_string("%d distinct values (%.1f%%)", F.col("u"), distinct_share * 100))
        .when(is_mixed, "numbers beside text")
        .alias("reason"),
    )


_SUGGESTED = {"datetime": "timestamp", "integer": "long", "float": "double", "category": "category", "string": "string"}


def apply_types(df: DataFrame, suggestions: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Convert the chosen columns as suggested, in one projection."""
    chosen = set(as_list(columns)) if columns is not None else None
    plans = {r["column"]: r for r in suggestions.select("column", "suggested_type", "format").collect()}
    converted = {}
    for c, plan in plans.items():
        if c in df.columns and (chosen is None or c in chosen):
            formats = (plan["format"],) if plan["format"] else scalar.DATE_FORMATS
            converted[c] = _converted(df, c, _SUGGESTED[plan["suggested_type"]], formats)
    return df.withColumns(converted) if converted else df


# -- convert ----------------------------------------------------------------
def _converted(df: DataFrame, name: str, to: str, formats: tuple[str, ...], strict: bool = False) -> Column:
    c, dtype = col(name), df.schema[name].dataType
    if to == "long":
        if isinstance(dtype, INTEGRAL):
            return c.cast("bigint")
        # Half-even rounding; values that are no number become NULL.
        return F.rint(scalar.to_number(c, dtype)).try_cast("bigint")
    if to == "double":
        return scalar.to_number(c, dtype)
    if to == "boolean":
        return _boolean(c, dtype, strict)
    if to == "string":
        return scalar.text_form(c, dtype)
    if to == "category":
        return c
    if to == "timestamp":
        if kind_of(dtype) == "datetime":
            return c.cast("timestamp_ntz")
        return scalar.parse_timestamp(scalar.text_form(c, dtype), formats)
    return c.try_cast(to)


def _boolean(c: Column, dtype: T.DataType, strict: bool) -> Column:
    if isinstance(dtype, T.BooleanType):
        return c
    if kind_of(dtype) == "numeric":
        return F.when(c == 1, True).when(c == 0, False)
    text = c.cast("string")
    yes, no = (STRICT_TRUE, STRICT_FALSE) if strict else (TRUE_TEXT, FALSE_TEXT)
    return F.when(text.isin(*yes), True).when(text.isin(*no), False)


CONVERSIONS = ("long", "double", "boolean", "bool", "string", "category", "timestamp")


def convert(
    df: DataFrame,
    name: str,
    to: str,
    formats: Iterable[str] = scalar.DATE_FORMATS,
    on_unmapped: str = "error",
) -> DataFrame:
    """Convert a column to long, double, boolean, string, category, timestamp or any
    Spark type name.

    Values that do not convert become NULL. Booleans are all-or-nothing unless
    ``on_unmapped="null"``: one unknown value fails the conversion; ``bool`` knows
    the 1/0 and true/false spellings only. A category stays text, which Parquet
    stores by dictionary.
    """
    require(df, name)
    strict = to == "bool"
    target = "boolean" if strict else to
    new = _converted(df, name, target, tuple(as_list(formats)), strict)
    if target == "boolean" and on_unmapped == "error":
        lost = df.filter(col(name).isNotNull() & new.isNull()).limit(1).count()
        if lost:
            raise ValueError(f"{name} holds values that are neither true nor false")
    return df.withColumn(name, new)


def conversion_loss(df: DataFrame, name: str, to: str, formats: Iterable[str] = scalar.DATE_FORMATS) -> DataFrame:
    """One row: values converted, and values that would become NULL."""
    require(df, name)
    strict = to == "bool"
    new = _converted(df, name, "boolean" if strict else to, tuple(as_list(formats)), strict)
    lost = F.count_if(col(name).isNotNull() & new.isNull())
    return df.agg(F.count(new).alias("converted"), lost.alias("lost"))


# -- whole floats and narrowing ---------------------------------------------
def whole_floats_to_long(df: DataFrame) -> DataFrame:
    """Turn float columns that hold only whole numbers into longs.

    Which columns qualify decides the schema, so one aggregate runs right away.
    """
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    fits = [
        (F.bool_and((col(c) == F.floor(col(c))) & (F.abs(col(c)) < 2.0**63))).alias(f"w{i}") for i, c in enumerate(floats)
    ]
    found = df.agg(*fits).first()
    whole = [c for i, c in enumerate(floats) if found[f"w{i}"]]
    return df.withColumns({c: col(c).cast("bigint") for c in whole}) if whole else df


# Upper limits of the unsigned and signed widths, and the Spark type that holds
# each (fixed values; Spark has no unsigned types).
_UNSIGNED = ((2**8, "uint8", "smallint"), (2**16, "uint16", "int"), (2**32, "uint32", "bigint"))
_SIGNED = ((2**7, "int8", "tinyint"), (2**15, "int16", "smallint"), (2**31, "int32", "int"))


def narrowing(df: DataFrame, category_share: float = 0.5) -> DataFrame:
    """One row per column: the narrow type its values allow, NULL for no change.

    ``narrow`` names the width, ``spark_type`` the type that holds it. Floats narrow
    only where no value would change; low-cardinality text is marked a category.
    """
    texts = text_columns(df)
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if isinstance(f.dataType, INTEGRAL):
            wanted += [F.min(c).cast("bigint").alias(f"lo{i}"), F.max(c).cast("bigint").alias(f"hi{i}")]
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            same = c == c.cast("float").cast("double")
            wanted.append(F.coalesce(F.bool_and(same), F.lit(True)).alias(f"f{i}"))
    one_row = df.agg(*wanted)
    if texts:
        one_row = beside(one_row, value_summary(df, texts))

    def row(i: int, f: T.StructField) -> Column:
        narrow = target = F.lit(None).cast("string")
        if isinstance(f.dataType, INTEGRAL):
            narrow, target = _width(i, 1), _width(i, 2)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            narrow, target = F.when(F.col(f"f{i}"), "float32"), F.when(F.col(f"f{i}"), "float")
        elif f.name in texts:
            few = share(F.col(f"u{texts.index(f.name)}"), F.col("rows")) < category_share
            narrow, target = F.when(few, "category"), F.when(few, "string")
        return F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            narrow.alias("narrow"),
            target.alias("spark_type"),
        )

    return rows_from(one_row, [row(i, f) for i, f in enumerate(df.schema.fields)]).filter(F.col("narrow").isNotNull())


def _width(i: int, part: int) -> Column:
    lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
    positive = F.coalesce(*[F.when(hi < w[0], F.lit(w[part])) for w in _UNSIGNED])
    negative = F.coalesce(*[F.when((lo > -w[0]) & (hi < w[0]), F.lit(w[part])) for w in _SIGNED])
    return F.when(lo >= 0, positive).otherwise(negative)


def narrow_types(df: DataFrame, category_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The table in its narrowest types, and what changed."""
    changes = narrowing(df, category_share)
    targets = {r["column"]: r["spark_type"] for r in changes.collect()}
    return df.select(*[col(c).cast(targets[c]).alias(c) if c in targets else col(c) for c in df.columns]), changes
