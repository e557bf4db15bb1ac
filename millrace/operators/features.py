"""Features for models: encoding, scaling, date parts, interactions, powers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.kinds import as_double, as_list, col, kind_of, require, require_numeric
from .columns import formula
from .ordering import with_position
from .quantiles import exact_quantiles

MAX_ONE_HOT = 1_000


def one_hot(df: DataFrame, name: str, max_values: int = MAX_ONE_HOT) -> DataFrame:
    """A boolean column ``<name>_<value>`` per distinct value; the source is dropped.

    NULL is false everywhere. The values become the schema, so they are read
    first; more than ``max_values`` of them is an error, never a truncation.
    """
    require(df, name)
    found = df.select(col(name)).filter(col(name).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(found) > max_values:
        raise ValueError(f"{name} has more than {max_values} values; use label_encode")
    dtype = df.schema[name].dataType
    values = sorted(r[0] for r in found)
    text = {v: str(v) for v in values}
    kept = [col(c) for c in df.columns if c != name]
    flags = [F.coalesce(col(name) == F.lit(v).cast(dtype), F.lit(False)).alias(f"{name}_{text[v]}") for v in values]
    return df.select(*kept, *flags)


def label_encode(df: DataFrame, name: str) -> DataFrame:
    """Adds ``<name>_encoded``: the place of the value among the sorted text forms.

    A missing value is a class of its own, sorted as the text ``nan``. Any number
    of distinct values works; the code table is broadcast only when small.
    """
    require(df, name)
    text = F.coalesce(scalar.text_form(col(name), df.schema[name].dataType), F.lit("nan"))
    values = df.select(text.alias("_label")).distinct()
    codes = with_position(values, ["_label"], "_code")
    joined = df.withColumn("_text", text).join(codes, F.col("_text") == F.col("_label"), "left")
    return joined.select(*[col(c) for c in df.columns if c != f"{name}_encoded"], F.col("_code").cast("bigint").alias(f"{name}_encoded"))


SCALERS = ("standard", "minmax", "robust")


def scale(df: DataFrame, columns: str | Iterable[str], method: str = "standard") -> DataFrame:
    """Scale columns in place: z-score with population deviation, to 0..1, or by IQR.

    A column without spread is only centred. NULLs pass through.
    """
    columns = as_list(columns)
    require_numeric(df, columns)
    if method == "standard":
        stats = df.agg(
            *[F.avg(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(as_double(df, c)).alias(f"b{i}") for i, c in enumerate(columns)],
        )
    elif method == "minmax":
        stats = df.agg(
            *[F.min(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
            *[(F.max(as_double(df, c)) - F.min(as_double(df, c))).alias(f"b{i}") for i, c in enumerate(columns)],
        )
    elif method == "robust":
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        stats = quartiles.select(
            *[col(f"{c}__1").alias(f"a{i}") for i, c in enumerate(columns)],
            *[(col(f"{c}__2") - col(f"{c}__0")).alias(f"b{i}") for i, c in enumerate(columns)],
        )
    else:
        raise ValueError(f"method must be one of {SCALERS}, not {method!r}")
    wide = df.crossJoin(F.broadcast(stats))

    def scaled(c: str):
        i = columns.index(c)
        spread = F.when(F.col(f"b{i}") == 0, F.lit(1.0)).otherwise(F.col(f"b{i}"))
        return (as_double(df, c) - F.col(f"a{i}")) / spread

    return wide.select(*[scaled(c).alias(c) if c in columns else col(c) for c in df.columns])


# Date part names and the Spark function behind each (fixed values).
DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,
    "hour": F.hour,
    "quarter": F.quarter,
    "weekofyear": F.weekofyear,
}


def datetime_parts(df: DataFrame, name: str, parts: Iterable[str] = ("year", "month", "day")) -> DataFrame:
    """Adds ``<name>_<part>`` columns; Monday is day 0 and weeks are ISO weeks."""
    require(df, name)
    if kind_of(df.schema[name].dataType) != "datetime":
        raise TypeError(f"not a date or timestamp: {name}")
    unknown = set(as_list(parts)) - set(DATE_PARTS)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}; choose among {sorted(DATE_PARTS)}")
    return df.withColumns({f"{name}_{p}": DATE_PARTS[p](col(name)) for p in as_list(parts)})


INTERACTIONS = {"multiply": "*", "divide": "/", "add": "+", "subtract": "-"}


def interaction(df: DataFrame, a: str, op: str, b: str, name: str | None = None) -> DataFrame:
    """Combine two columns into ``<a>_<op>_<b>``; division by zero gives NULL."""
    if op not in INTERACTIONS:
        raise ValueError(f"operation must be one of {sorted(INTERACTIONS)}, not {op!r}")
    return formula(df, name or f"{a}_{op}_{b}", a, INTERACTIONS[op], b)


def polynomial(df: DataFrame, columns: Iterable[str], degree: int = 2) -> DataFrame:
    """Adds all products of the columns up to a degree, named ``a^2`` and ``a b``."""
    columns = as_list(columns)
    require_numeric(df, columns)
    if degree not in (2, 3):
        raise ValueError("degree must be 2 or 3")
    incomplete = reduce(lambda a, b: a | b, [col(c).isNull() for c in columns])
    if df.filter(incomplete).limit(1).count():
        raise ValueError("polynomial features need columns without missing values")
    products = {}
    for size in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, size):
            powers = Counter(combo)
            label = " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())
            products[label] = reduce(lambda x, y: x * y, [as_double(df, c) for c in combo])
    return df.withColumns(products)
