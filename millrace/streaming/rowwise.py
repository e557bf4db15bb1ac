"""Running row-wise operators on streams.

Operators that are plain column expressions (columns, predicates, text, type
conversion, date parts, interactions) need no change on a streaming table. Fills
and scalings need statistics, which are fitted on a batch table once and then
applied as constants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, as_list, col, require_numeric
from ..operators.missing import UNKNOWN, mode_of
from ..operators.quantiles import exact_quantiles


def apply_steps(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply row-wise steps; a step that stops the table from streaming is an error."""
    out = stream
    for step in steps:
        out = out.transform(step)
        if stream.isStreaming and not out.isStreaming:
            raise ValueError(f"{getattr(step, '__name__', step)} does not keep the stream")
    return out


@dataclass(frozen=True)
class FittedFill:
    """Fill values learned from a batch table, one per column."""

    values: dict[str, Any]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in self.values.items() if v is not None})


def fit_fill(df: DataFrame, columns: str | Iterable[str], method: str) -> FittedFill:
    """Learn mean, median, min, max, p10, p90 or mode fills on a batch table."""
    columns = as_list(columns)
    if method == "mode":
        found = {c: mode_of(df, c).first()["value"] for c in columns}
        return FittedFill({c: UNKNOWN if v is None else v for c, v in found.items()})
    require_numeric(df, columns)
    simple = {"mean": F.avg, "min": F.min, "max": F.max}
    if method in simple:
        row = df.agg(*[simple[method](as_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        return FittedFill({c: row[f"s{i}"] for i, c in enumerate(columns)})
    probs = {"median": 0.5, "p10": 0.1, "p90": 0.9}
    if method not in probs:
        raise ValueError(f"cannot fit {method!r}")
    row = exact_quantiles(df, columns, [probs[method]]).first()
    return FittedFill({c: row[f"{c}__0"] for c in columns})
