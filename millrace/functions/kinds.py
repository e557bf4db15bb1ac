"""Column references and the type classes the operators dispatch on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Text longer than this is compared by digest, so that counting distinct values
# or duplicate rows never shuffles whole documents.
DIGEST_OVER = 64


def col(name: str) -> Column:
    """Reference a column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, names: str | Iterable[str]) -> None:
    missing = [n for n in as_list(names) if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def kind_of(dtype: T.DataType) -> str:
    """One of numeric, boolean, text, datetime, other."""
    if isinstance(dtype, INTEGRAL + FRACTIONAL):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, DATETIME):
        return "datetime"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    """Numeric columns; ``booleans=True`` also counts booleans as numbers."""
    wanted = {"numeric", "boolean"} if booleans else {"numeric"}
    return [n for n, k in kinds(df).items() if k in wanted]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, k in kinds(df).items() if k == "text"]


def datetime_columns(df: DataFrame) -> list[str]:
    return [n for n, k in kinds(df).items() if k == "datetime"]


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGRAL)


def require_numeric(df: DataFrame, names: str | Iterable[str]) -> None:
    require(df, names)
    bad = [n for n in as_list(names) if kind_of(df.schema[n].dataType) not in ("numeric", "boolean")]
    if bad:
        raise TypeError(f"not numeric: {', '.join(bad)}")


def as_double(df: DataFrame, name: str) -> Column:
    """The column as a double; booleans become 0 and 1."""
    c = col(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        c = c.cast("int")
    return c.cast("double")


def digest(df: DataFrame, name: str) -> Column:
    """A value equal exactly when the column is equal, but short for long text."""
    c = col(name)
    if kind_of(df.schema[name].dataType) == "text":
        # The first letter tells a digest from a text that spells one.
        return F.when(F.length(c) > DIGEST_OVER, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(F.concat(F.lit("="), c))
    return c


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Turn float NaN into NULL, the only missing marker the operators know."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats})
