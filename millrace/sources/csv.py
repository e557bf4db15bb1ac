"""CSV scan with encoding detection and type inference."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.kinds import as_list, col
from ..session import materialize

ENCODINGS = ("utf-8", "latin-1", "iso-8859-1", "cp1252")
_JAVA_NAMES = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252"}

# Texts that mean a missing value (fixed values).
NA_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_INTEGER = r"^\s*[+-]?\d+\s*$"
_SURPLUS = "__surplus"


def detect_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """``utf-8`` if every line is valid UTF-8, else ``latin-1``, which takes any byte."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "latin-1" if broken.limit(1).count() else "utf-8"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "auto",
    limit: int | None = None,
    order_by: Iterable[str] | None = None,
    multiline: bool = False,
    infer: bool = True,
) -> DataFrame:
    """Read CSV with a header row; missing-value texts become NULL.

    Types are judged on every value in one pass: boolean, long, decimal for whole
    numbers that no long holds, double or text. Large files are split over many tasks
    unless ``multiline`` allows line breaks inside quotes. A line with more fields than
    the header is an error; missing fields at its end are NULL. ``limit`` keeps that
    many rows: the first by the typed columns in ``order_by`` if given, with types
    judged on the whole file, else some rows, with types judged on those.
    """
    if encoding == "auto":
        encoding = detect_encoding(spark, path)
    if encoding not in _JAVA_NAMES:
        raise ValueError(f"encoding must be auto or one of {ENCODINGS}, not {encoding!r}")
    reader = spark.read.option("header", True).option("encoding", _JAVA_NAMES[encoding])
    reader = reader.option("multiLine", multiline).option("escape", '"')
    names = reader.csv(path).columns
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in [*names, _SURPLUS])
    read = reader.schema(schema).csv(path)
    surplus = F.raise_error(F.lit(f"a CSV line has more than {len(names)} fields")).cast("boolean")
    raw = read.filter(F.when(F.col(_SURPLUS).isNull(), F.lit(True)).otherwise(surplus))
    raw = raw.select(*[F.when(~col(c).isin(*NA_TEXT), col(c)).alias(c) for c in names])
    if limit is not None and order_by:
        typed = infer_types(raw) if infer else raw
        return typed.orderBy(*[col(c) for c in as_list(order_by)]).limit(limit)
    if limit is not None:
        raw = materialize(raw.limit(limit), "head")
    return infer_types(raw) if infer else raw


def infer_types(raw: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest of boolean, long, decimal(38, 0) and double all values fit.

    A column of whole numbers never becomes double, which would change long ones: it
    stays text if even a decimal is too small.
    """
    if not raw.columns:
        return raw
    wanted: list[Column] = []
    for i, c in enumerate(raw.columns):
        text = col(c)
        wanted += [
            F.count(text).alias(f"n{i}"),
            F.count_if(F.lower(text).isin("true", "false")).alias(f"b{i}"),
            F.count_if(text.rlike(_INTEGER)).alias(f"w{i}"),
            F.count_if(text.rlike(_INTEGER) & F.trim(text).try_cast("bigint").isNotNull()).alias(f"l{i}"),
            F.count_if(text.rlike(_INTEGER) & F.trim(text).try_cast("decimal(38,0)").isNotNull()).alias(f"m{i}"),
            F.count(scalar.to_number(text, raw.schema[c].dataType)).alias(f"d{i}"),
        ]
    counts = raw.agg(*wanted).first()
    typed = []
    for i, c in enumerate(raw.columns):
        n = counts[f"n{i}"]
        if n and counts[f"b{i}"] == n:
            typed.append((F.lower(col(c)) == "true").alias(c))
        elif n and counts[f"l{i}"] == n:
            typed.append(F.trim(col(c)).try_cast("bigint").alias(c))
        elif n and counts[f"m{i}"] == n:
            typed.append(F.trim(col(c)).try_cast("decimal(38,0)").alias(c))
        elif n and counts[f"d{i}"] == n and counts[f"w{i}"] < n:
            typed.append(scalar.to_number(col(c), raw.schema[c].dataType).alias(c))
        else:
            typed.append(col(c))
    return raw.select(*typed)
