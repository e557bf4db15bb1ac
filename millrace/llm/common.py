"""Helpers shared by the operators: intermediate tables, numbering, words and their hashes.

The array code runs inside Spark tasks on Arrow batches. It works on pieces of at
most ``PIECE`` bytes of text (one document at least), so its memory follows the
longest document and never the size of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import fresh_path

PIECE = 1 << 20


class Scratch:
    """Intermediate tables in the shared folder; ``free`` deletes those no longer read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        done = self.paths[: len(self.paths) - keep]
        for path in done:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = self.paths[len(done) :]


def stamped(df: DataFrame) -> DataFrame:
    """Add ``__part`` and ``__pos``, the row's partition and its order; store the result before use."""
    return df.withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id())


def ordinal_within(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 in a stored table from ``stamped``.

    A key is numbered per partition and the partitions' counts are added up, so one
    key with any share of the rows spreads over as many tasks as the table has
    partitions.
    """
    by_key = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(by_key), F.lit(0))).drop("__n")
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__start")
    within = Window.partitionBy(*keys, "__part").orderBy("__pos")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = df.withColumn("__in", F.row_number().over(within) - 1).join(starts, same)
    return numbered.withColumn(name, F.col("__start") + F.col("__in")).drop("__start", "__in", "__p", *[f"__k{i}" for i in range(len(keys))])


# -- text as arrays ---------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACED = np.ones(256, dtype=bool)  # everything but white space
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)  # digits, a-z and all beyond ASCII
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of an array of 64-bit numbers; equal ranges hash equal."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    """Words of a run of texts: ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return ranges_hash(_BYTE[self.data], self.starts, self.ends)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def words(texts: pa.Array, kind: np.ndarray) -> Words:
    """Lower-case A-Z and cut each text into maximal runs of the bytes in ``kind``."""
    data, bounds = text_bytes(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[bounds[1:] - 1] = False  # an empty text names the last byte of one before it, or wraps to the spare
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds), bounds)


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of texts with at most ``most`` bytes together, or a single text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def with_columns(df: DataFrame, text: str, added: str, work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Add columns computed from a text column, piece by piece, in Arrow batches.

    ``added`` is the new columns' DDL; an input column of the same name is replaced.
    ``work`` gets an array of texts and returns one array per new column.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    schema = T.StructType([*kept, *new.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for lo, hi in pieces(texts):
                part = batch.slice(lo, hi - lo)
                made = work(texts.slice(lo, hi - lo))
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, *made], arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
