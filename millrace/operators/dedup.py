"""Counting, listing and removing duplicate rows; NULLs compare equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..functions.moments import share
from .profile import duplicate_count

# Copies of one row are written out in chunks of this many, so that a row with
# any number of copies is spread over many tasks.
CHUNK = 100_000


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: duplicate rows (all but the first of each kind) and their %."""
    pct = share(F.col("duplicates"), F.col("rows")) * 100
    return duplicate_count(df).select(F.col("duplicates").alias("duplicate_rows"), pct.alias("duplicate_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of every group of equal rows."""
    names = [col(c) for c in df.columns]
    repeated = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(CHUNK).cast("bigint"))
    chunks = repeated.select(*names, "_n", F.explode(starts).alias("_start"))
    # A hot row has many chunks; spread them before writing the copies out.
    spread = chunks.repartition(F.xxhash64("_start", *names))
    size = F.least(F.lit(CHUNK).cast("bigint"), F.col("_n") - F.col("_start"))
    copies = spread.select(*names, F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("_copy"))
    return copies.select(*names)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
