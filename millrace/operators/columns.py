"""Adding, dropping, deriving and filtering columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.kinds import as_list, col, require, require_numeric
from ..functions.moments import null_count

_COLUMN_TYPES = {"text": "string", "number": "double", "integer": "bigint", "empty": "string"}


# -- add and drop -----------------------------------------------------------
def add_column(df: DataFrame, name: str, type: str = "text", default: Any = None) -> DataFrame:
    """A new column holding a constant, or NULL when no default is given."""
    if not scalar.is_valid_name(name):
        raise ValueError("a column needs a name")
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    if type not in _COLUMN_TYPES:
        raise ValueError(f"type must be one of {sorted(_COLUMN_TYPES)}, not {type!r}")
    target = _COLUMN_TYPES[type]
    if default is None or default == "":
        return df.withColumn(name, F.lit(None).cast(target))
    if type == "number":
        default = float(default)
    elif type == "integer":
        default = int(default)
    else:
        default = str(default)
    return df.withColumn(name, F.lit(default).cast(target))


def split_new_names(df: DataFrame, names: Iterable[str]) -> tuple[list[str], list[str]]:
    """The trimmed names to add, and those skipped because they exist."""
    added: list[str] = []
    skipped: list[str] = []
    for name in (n.strip() for n in names):
        if not name:
            continue
        (skipped if name in df.columns or name in added else added).append(name)
    return added, skipped


def add_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Many empty text columns at once; existing names are left alone."""
    added, _ = split_new_names(df, names)
    return df.withColumns({n: F.lit(None).cast("string") for n in added}) if added else df


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    names = as_list(columns)
    require(df, names)
    return df.select(*[col(n) for n in df.columns if n not in set(names)])


# -- derived columns --------------------------------------------------------
def formula(df: DataFrame, target: str, a: str, op: str, b: str) -> DataFrame:
    """``target = a op b`` for + - * / ^ %."""
    require_numeric(df, [a, b])
    return df.withColumn(target, scalar.arithmetic(_number(df, a), op, _number(df, b)))


def _number(df: DataFrame, name: str) -> Column:
    c = col(name)
    return c.cast("int") if isinstance(df.schema[name].dataType, T.BooleanType) else c


def expr_column(df: DataFrame, target: str, sql_expr: str, scalars: dict[str, str] | None = None) -> DataFrame:
    """A column from a Spark SQL expression over the table's columns.

    ``scalars`` names whole-column aggregates the expression may use, for example
    ``{"top": "max(price)"}``; they are computed once as a single row.
    """
    if not scalars:
        return df.withColumn(target, F.expr(sql_expr))
    totals = df.agg(*[F.expr(e).alias(n) for n, e in scalars.items()])
    wide = df.crossJoin(F.broadcast(totals)).withColumn(target, F.expr(sql_expr))
    return wide.drop(*scalars)


COPY_TRANSFORMS = ("multiply", "add", "upper", "lower", "remove_spaces", "round")


def copy_column(
    df: DataFrame, source: str, target: str, transform: str | None = None, constant: float = 1.0
) -> DataFrame:
    """Copy a column, optionally scaled, shifted, recased, unspaced or rounded."""
    require(df, source)
    c, dtype = col(source), df.schema[source].dataType
    if transform is None:
        return df.withColumn(target, c)
    if transform in ("multiply", "add", "round"):
        require_numeric(df, source)
        number = _number(df, source)
        if transform == "multiply":
            return df.withColumn(target, number.cast("double") * F.lit(float(constant)))
        if transform == "add":
            return df.withColumn(target, number.cast("double") + F.lit(float(constant)))
        return df.withColumn(target, F.bround(number, int(constant)))
    text = scalar.text_form(c, dtype)
    if transform == "upper":
        return df.withColumn(target, F.upper(text))
    if transform == "lower":
        return df.withColumn(target, F.lower(text))
    if transform == "remove_spaces":
        return df.withColumn(target, F.replace(text, F.lit(" "), F.lit("")))
    raise ValueError(f"transform must be one of {COPY_TRANSFORMS}, not {transform!r}")


def predicate(df: DataFrame, name: str, op: str, value: Any) -> Column:
    """A condition on one column of the table; see ``functions.scalar.predicate``."""
    require(df, name)
    return scalar.predicate(col(name), df.schema[name].dataType, op, value)


def conditional_column(
    df: DataFrame, target: str, condition: Column, then: Any, otherwise: Any = None, widen: bool = False
) -> DataFrame:
    """Set ``target`` where the condition holds, optionally another value elsewhere.

    Without ``otherwise`` the remaining rows keep what they had. A value that
    does not fit the target's type is an error unless ``widen`` makes it text.
    """
    holds = F.coalesce(condition, F.lit(False))
    exists = target in df.columns
    dtype = df.schema[target].dataType if exists else T.StringType()
    yes = scalar.literal_for(then, dtype, widen)
    no = scalar.literal_for(otherwise, dtype, widen) if otherwise not in (None, "") else "keep"
    kept = col(target) if exists else F.lit(None).cast("string")
    if yes is None or no is None:
        yes, kept = F.lit(str(then)), scalar.text_form(kept, dtype)
        no = F.lit(str(otherwise)) if otherwise not in (None, "") else "keep"
    return df.withColumn(target, F.when(holds, yes).otherwise(kept if isinstance(no, str) else no))


def replace_value(df: DataFrame, name: str, old: Any, new: Any) -> DataFrame:
    require(df, name)
    return df.withColumn(name, F.when(col(name) == F.lit(old), F.lit(new)).otherwise(col(name)))


# -- filters ----------------------------------------------------------------
def predicate_counts(df: DataFrame, condition: Column) -> DataFrame:
    """One row: how many rows match and how many do not."""
    holds = F.coalesce(condition, F.lit(False))
    return df.agg(F.count_if(holds).alias("matching"), F.count_if(~holds).alias("not_matching"))


def predicate_preview(df: DataFrame, condition: Column, columns: Iterable[str], order_by: Iterable[str], n: int = 10) -> DataFrame:
    """The first ``n`` affected rows in the given order."""
    shown = df.filter(F.coalesce(condition, F.lit(False)))
    return shown.orderBy(*[col(c) for c in as_list(order_by)]).select(*[col(c) for c in as_list(columns)]).limit(n)


def filter_equals(df: DataFrame, name: str, value: Any) -> DataFrame:
    require(df, name)
    return df.filter(col(name) == F.lit(value))


def drop_null_rows(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    names = as_list(columns)
    require(df, names)
    return df.filter(reduce(lambda a, b: a & b, [col(n).isNotNull() for n in names]))


def rows_with_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows missing a value in at least one of the columns."""
    names = as_list(columns)
    require(df, names)
    return df.filter(reduce(lambda a, b: a | b, [col(n).isNull() for n in names]))


def missing_cells(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row: rows with a missing value, and missing cells, in the columns."""
    names = as_list(columns)
    require(df, names)
    any_missing = reduce(lambda a, b: a | b, [col(n).isNull() for n in names])
    cells = reduce(lambda a, b: a + b, [null_count(col(n)) for n in names])
    return df.agg(F.count_if(any_missing).alias("rows"), cells.alias("cells"))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.select(col(name)).filter(col(name).isNotNull()).distinct()


def preview(df: DataFrame, columns: Iterable[str], order_by: Iterable[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows of some columns in a stated order."""
    return df.orderBy(*[col(c) for c in as_list(order_by)]).select(*[col(c) for c in as_list(columns)]).limit(n)
