"""Findings about a table: what stands out, what to drop, what to model on."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import as_double, col, numeric_columns, text_columns
from ..functions.moments import null_count, rows_from, safe_corr, sample_skew, share
from .correlation import correlation_pairs
from .profile import beside, duplicate_count, total, value_summary


def _row(level: str, kind: str, subject: str | Column, metric: Column, message: Column, shown: Column) -> Column:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(kind).alias("kind"),
        subject.alias("subject"),
        metric.cast("double").alias("metric"),
        message.alias("message"),
        F.coalesce(shown, F.lit(False)).alias("_shown"),
    )


def findings(df: DataFrame) -> DataFrame:
    """Rows (level, kind, subject, metric, message) on everything that stands out."""
    numbers, texts, names = numeric_columns(df), text_columns(df), df.columns
    pairs = list(combinations(numbers, 2))
    table = df.agg(
        *[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[sample_skew(as_double(df, c)).alias(f"k{i}") for i, c in enumerate(numbers)],
    )
    one_row = beside(table, duplicate_count(df), value_summary(df, names))
    rows = F.col("rows")
    nulls = [F.col(f"n{i}") for i in range(len(names))]
    incomplete = total([(n > 0).cast("int") for n in nulls])
    missing = total(nulls)
    dup_share = share(F.col("duplicates"), rows)

    found = [
        _row(
            "narrative", "missing", "table", missing,
            F.format_string("Found %d columns with missing values (%d cells total)", incomplete, missing), missing > 0,
        ),
        _row(
            "narrative", "duplicates", "table", F.col("duplicates"),
            F.format_string("%d rows repeat an earlier one (%.1f%%)", F.col("duplicates"), dup_share * 100), F.col("duplicates") > 0,
        ),
        _row("recommendation", "duplicates", "table", dup_share, F.lit("drop repeated rows"), dup_share > 0.1),
    ]
    for i, c in enumerate(names):
        part = share(nulls[i], rows)
        found.append(_row("warning", "high_missing", c, part, F.format_string("%s has >50%% missing data", F.lit(c)), part > 0.5))
        found.append(_row("warning", "constant", c, F.col(f"u{i}"), F.format_string("%s never varies", F.lit(c)), F.col(f"u{i}") <= 1))
        if c in texts:
            top = share(F.col(f"m{i}"), rows - nulls[i])
            found.append(
                _row(
                    "warning", "imbalance", c, top,
                    F.format_string("one value of '%s' covers %.1f%% of the rows", F.lit(c), top * 100),
                    F.col(f"u{i}").between(2, 10) & (top > 0.9),
                )
            )
    skewed = [F.abs(F.col(f"k{i}")) > 2 for i in range(len(numbers))]
    for i, c in enumerate(numbers):
        found.append(
            _row("narrative", "skewed", c, F.col(f"k{i}"), F.format_string("%s is highly skewed (|skew| > 2)", F.lit(c)), skewed[i])
        )
    if skewed:
        some = reduce(lambda a, b: a | b, [F.coalesce(s, F.lit(False)) for s in skewed])
        count = total([F.coalesce(s, F.lit(False)).cast("int") for s in skewed])
        found.append(_row("recommendation", "skewed", "table", count, F.lit("try logarithms on the skewed columns"), some))
    result = rows_from(one_row, found).filter("_shown").drop("_shown")
    if pairs:
        strong = correlation_pairs(df, numbers).filter(F.abs("correlation") > 0.9)
        result = result.unionByName(
            strong.select(
                F.lit("warning").alias("level"),
                F.lit("correlated").alias("kind"),
                F.concat_ws(" ~ ", "feature_1", "feature_2").alias("subject"),
                F.col("correlation").alias("metric"),
                F.lit("one column of the pair is enough").alias("message"),
            )
        )
    return result


def suggest_drops(df: DataFrame) -> DataFrame:
    """Columns that may be safe to drop: constant, mostly missing, or redundant."""
    names, numbers = df.columns, numeric_columns(df)
    one_row = beside(
        df.agg(F.count(F.lit(1)).alias("rows"), *[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]),
        value_summary(df, names),
    )

    def row(c: str, reason: Column, kind: str, shown: Column) -> Column:
        return F.struct(
            F.lit(c).alias("column"), reason.alias("reason"), F.lit(kind).alias("type"), F.lit("High").alias("priority"), shown.alias("_shown")
        )

    rows = []
    for i, c in enumerate(names):
        pct = share(F.col(f"n{i}"), F.col("rows")) * 100
        rows.append(row(c, F.lit("never varies"), "Constant", F.col(f"u{i}") <= 1))
        rows.append(row(c, F.format_string("empty in %.1f%% of the rows", pct), "High Missing", pct > 90))
    result = rows_from(one_row, rows).filter("_shown").drop("_shown")
    if len(numbers) >= 2:
        strong = correlation_pairs(df, numbers).filter(F.abs("correlation") > 0.95)
        result = result.unionByName(
            strong.select(
                F.col("feature_2").alias("column"),
                F.format_string("follows %s (r=%.3f)", "feature_1", F.abs("correlation")).alias("reason"),
                F.lit("High Correlation").alias("type"),
                F.lit("Medium").alias("priority"),
            )
        )
    return result


def select_features(df: DataFrame) -> DataFrame:
    """One row per column: selected for modelling or not, and why not.

    The first rule that fits decides; of two selected numeric columns with
    |r| > 0.95 the later one goes, unless its partner is already gone first.
    """
    names = df.columns
    numbers = numeric_columns(df, booleans=True)
    one_row = beside(
        df.agg(F.count(F.lit(1)).alias("rows"), *[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]),
        value_summary(df, names),
    )

    def reason(i: int, c: str) -> Column:
        dtype = df.schema[c].dataType
        distinct, missing = share(F.col(f"u{i}"), F.col("rows")), share(F.col(f"n{i}"), F.col("rows"))
        why = F.when(F.col(f"u{i}") <= 1, "never varies")
        if isinstance(dtype, (T.StringType, T.LongType, T.IntegerType)):
            why = why.when(distinct > 0.95, F.format_string("looks like a key (%.1f%% distinct)", distinct * 100))
        why = why.when(missing > 0.8, F.format_string("mostly empty (%.1f%%)", missing * 100))
        if isinstance(dtype, T.StringType):
            why = why.when(F.col(f"u{i}") > 20, "text that must be encoded first")
        return why

    ruled = rows_from(
        one_row,
        [
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(c in numbers).alias("_number"), reason(i, c).alias("reason"))
            for i, c in enumerate(names)
        ],
    )
    if len(numbers) >= 2:
        pairs = list(combinations(numbers, 2))
        stats = df.agg(*[safe_corr(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        strong = rows_from(
            stats,
            [F.struct(F.lit(a).alias("_first"), F.lit(b).alias("_second"), F.lit(names.index(a)).alias("_at"), F.abs(F.col(f"r{i}")).alias("_r")) for i, (a, b) in enumerate(pairs)],
        ).filter(F.col("_r") > 0.95)
        # A correlated pair counts only while both columns passed the rules above.
        passed = ruled.filter(F.col("reason").isNull()).select("column")
        strong = strong.join(F.broadcast(passed.withColumnRenamed("column", "_first")), "_first")
        first = strong.groupBy("_second").agg(F.min_by(F.struct("_first", "_r"), "_at").alias("_hit"))
        ruled = ruled.join(F.broadcast(first), F.col("column") == F.col("_second"), "left")
        redundant = F.format_string("follows %s (r=%.3f)", F.col("_hit._first"), F.col("_hit._r"))
        ruled = ruled.withColumn("reason", F.coalesce(F.col("reason"), F.when(F.col("_second").isNotNull(), redundant)))
    return ruled.select("column", F.col("reason").isNull().alias("selected"), "reason")
