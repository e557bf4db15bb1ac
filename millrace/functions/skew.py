"""Joins of a large table with one row per key, whose result is then aggregated by the key.

Adaptive execution splits a hot partition of a plain join, but not where an aggregate
by the same key follows: both share one shuffle. Here the large side is dealt over
``SALTS`` parts of every key, so aggregating per key and part, then per key, spreads a
key with any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kinds import col

SALTS = 16
SALT = "_salt"


def salted_join(large: DataFrame, small: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Inner join on (large column, small column) pairs; the result keeps the part as ``_salt``."""
    dealt = large.withColumn(SALT, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    parts = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [col(a) == col(b) for a, b in pairs]
    return dealt.join(parts, [*same, F.col(SALT) == F.col("_part")]).drop("_part")
