"""Row-wise column expressions: arithmetic, predicates, text and casts.

Everything here is a plain built-in expression, so it stays inside whole-stage
code generation and works on batch and streaming tables alike.
"""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kinds import kind_of

ARITHMETIC = ("+", "-", "*", "/", "^", "%")
COMPARISONS = ("=", "!=", ">", "<", ">=", "<=", "contains")

# Text that reads as a number. Narrower than Spark's own cast, which also takes
# the Java suffixes of "5d" and "5f".
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Unicode white space plus the four ASCII separators Python counts as space.
_SPACE = r"[\s\x1c-\x1f]"


# -- arithmetic -------------------------------------------------------------
def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL when dividing by zero."""
    rest = a % F.nullif(b, F.lit(0))
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def arithmetic(a: Column, op: str, b: Column) -> Column:
    """``a op b``; division by zero and integer overflow give NULL."""
    if op == "+":
        return F.try_add(a, b)
    if op == "-":
        return F.try_subtract(a, b)
    if op == "*":
        return F.try_multiply(a, b)
    if op == "/":
        return F.try_divide(a.cast("double"), b.cast("double"))
    if op == "^":
        return F.pow(a.cast("double"), b.cast("double"))
    if op == "%":
        return floor_mod(a, b)
    raise ValueError(f"operator must be one of {ARITHMETIC}, not {op!r}")


# -- numbers and predicates -------------------------------------------------
def to_number(c: Column, dtype: T.DataType) -> Column:
    """Coerce to double, NULL where the value is not a number."""
    kind = kind_of(dtype)
    if kind == "numeric":
        return c.cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind == "text":
        return F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return F.lit(None).cast("double")


def text_form(c: Column, dtype: T.DataType) -> Column:
    """The value as text; booleans read True / False."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def _same_text(c: Column, dtype: T.DataType, value: str) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # Equal text of a float means equal number, provided the given text is
        # how that number is written.
        try:
            number = float(value)
        except ValueError:
            return F.lit(False)
        return c == F.lit(number) if repr(number) == value else F.lit(False)
    return text_form(c, dtype) == F.lit(value)


def predicate(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """A condition that is always true or false, never NULL.

    ``=`` and ``!=`` compare text forms, the orderings compare numbers (values
    that are no number never match), ``contains`` is a case-insensitive regular
    expression. NULL satisfies ``!=`` only.
    """
    if op in ("=", "!="):
        same = F.coalesce(_same_text(c, dtype, str(value)), F.lit(False))
        return same if op == "=" else ~same
    if op == "contains":
        return F.coalesce(text_form(c, dtype).rlike("(?i)" + str(value)), F.lit(False))
    number, bound = to_number(c, dtype), F.lit(float(value))
    hits = {">": number > bound, "<": number < bound, ">=": number >= bound, "<=": number <= bound}
    if op not in hits:
        raise ValueError(f"operator must be one of {COMPARISONS}, not {op!r}")
    return F.coalesce(hits[op], F.lit(False))


def literal_for(value: Any, dtype: T.DataType, widen: bool = False) -> Column | None:
    """A literal of the column's type, or None if it does not fit and may widen."""
    kind = kind_of(dtype)
    try:
        if kind == "numeric":
            number = float(value)
            if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
                return F.lit(number).cast(dtype)
            if number != int(number):
                raise ValueError(f"{value!r} is no whole number")
            return F.lit(int(number)).cast(dtype)
        if kind == "boolean":
            if not isinstance(value, bool):
                raise ValueError(f"{value!r} is no boolean")
            return F.lit(value)
        if kind == "datetime":
            if not isinstance(value, (dt.date, dt.datetime)):
                value = dt.datetime.fromisoformat(str(value))
            return F.lit(value).cast(dtype)
        return F.lit(str(value))
    except (ValueError, TypeError, OverflowError):
        if widen:
            return None
        raise TypeError(f"{value!r} does not fit {dtype.simpleString()}; pass widen=True to make the column text")


# -- text -------------------------------------------------------------------
def collapse_spaces(c: Column) -> Column:
    trimmed = F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")
    return F.regexp_replace(trimmed, rf"(?U){_SPACE}+", " ")


def strip_specials(c: Column) -> Column:
    """Drop everything but ASCII letters, digits and white space."""
    return F.regexp_replace(c, r"(?U)[^A-Za-z0-9\s\x1c-\x1f]+", "")


def title_case(c: Column) -> Column:
    """A capital after any non-letter: ``o'neil`` becomes ``O'Neil``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 2**31 - 1))))
    return F.array_join(cased, "")


def recase(c: Column, case: str | None) -> Column:
    if case in (None, "none"):
        return c
    cases = {"lower": F.lower, "upper": F.upper, "title": title_case}
    if case not in cases:
        raise ValueError(f"case must be one of {sorted(cases)}, not {case!r}")
    return cases[case](c)


# -- dates ------------------------------------------------------------------
# The seven date formats tried, in order (fixed values).
DATE_FORMATS = (
    "yyyy-M-d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy.M.d",
    "yyyy-M-d H:m:s",
    "d/M/yyyy H:m",
    "M/d/yyyy h:m a",
)

# What each letter run of a format may look like in text.
_DATE_FIELDS = {
    "yyyy": r"\d{4}",
    "M": r"(0?[1-9]|1[0-2])",
    "d": r"(0?[1-9]|[12]\d|3[01])",
    "H": r"([01]?\d|2[0-3])",
    "h": r"(0?[1-9]|1[0-2])",
    "m": r"[0-5]?\d",
    "s": r"[0-5]?\d",
    "a": r"(?i:am|pm)",
}


def _date_shape(fmt: str) -> str | None:
    """A pattern every text of the format matches; None for other format letters."""
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]+", fmt)
    if any(p[0].isalpha() and p not in _DATE_FIELDS for p in parts) or "'" in fmt:
        return None
    return "^" + "".join(_DATE_FIELDS.get(p) or re.escape(p) for p in parts) + "$"


def _starts_with_digit(c: Column) -> Column:
    return F.left(c, F.lit(1)).between("0", "9")


def parse_timestamp(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that reads the text wins; NULL when none does.

    A failed parse is slow, so text without the shape of a format is never parsed.
    """
    tries = []
    for f in formats:
        parsed, shape = F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz"), _date_shape(f)
        tries.append(F.when(_starts_with_digit(c) & c.rlike(shape), parsed) if shape else parsed)
    return tries[0] if len(tries) == 1 else F.coalesce(*tries)


def is_valid_name(name: str) -> bool:
    return bool(re.search(r"\S", name))
