"""Order-sensitive operators over the whole table, without a one-task window.

The table is range-partitioned into slices and written once to the shared
folder, which fixes the slice of every row. A small table with one row per slice
(and partition key) carries counts or last values from slice to slice; inside a
slice an ordinary window does the work. A tie-break over all columns and a row id
lets Spark split even a key that holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import as_list, col, require
from ..session import materialize

_SLICE, _TIE, _ROW = "_slice", "_tie", "_row"


def sliced(
    df: DataFrame, order_by: Iterable[str], partition_by: Iterable[str] = (), slices: int | None = None
) -> DataFrame:
    """Adds slice number and tie-break: slices ascend in (partition, order) order."""
    partition, order = as_list(partition_by), as_list(order_by)
    require(df, partition + order)
    keyed = df.withColumns(
        {_TIE: F.xxhash64(*[col(c) for c in df.columns]), _ROW: F.monotonically_increasing_id()}
    )
    keys = [col(c) for c in partition + order] + [F.col(_TIE), F.col(_ROW)]
    ranged = keyed.repartitionByRange(slices, *keys) if slices else keyed.repartitionByRange(*keys)
    return materialize(ranged.withColumn(_SLICE, F.spark_partition_id()), "slices")


def _order(order: list[str]) -> list[Column]:
    return [col(c) for c in order] + [F.col(_TIE), F.col(_ROW)]


def _per_slice(table: DataFrame, partition: list[str], aggregates: list[Column]) -> DataFrame:
    """One row per partition key and slice, keys renamed for the join back."""
    grouped = table.groupBy(*[col(c) for c in partition], _SLICE).agg(*aggregates)
    for i, c in enumerate(partition):
        grouped = grouped.withColumnRenamed(c, f"_key{i}")
    return grouped.withColumnRenamed(_SLICE, "_at")


def _slice_order(partition: list[str]):
    keys = [F.col(f"_key{i}") for i in range(len(partition))] or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy("_at")


def _join_back(table: DataFrame, carried: DataFrame, partition: list[str]) -> DataFrame:
    """Attach the carried row of each slice.

    Without partition keys there is one row per slice, a number Spark fixes, so it
    is broadcast. With keys the size depends on the data and Spark decides.
    """
    if not partition:
        return table.join(F.broadcast(carried), F.col(_SLICE) == F.col("_at"))
    same = [F.col(_SLICE) == F.col("_at")]
    same += [col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(partition)]
    return table.join(carried, reduce(lambda a, b: a & b, same))


def running_sums(
    df: DataFrame, order_by: Iterable[str], weights: Mapping[str, str | None], partition_by: Iterable[str] = (), slices: int | None = None
) -> DataFrame:
    """Adds, for every target, the sum of its weight (1 if None) over all earlier rows, in one pass."""
    partition, order, targets = as_list(partition_by), as_list(order_by), list(weights)
    table = sliced(df, order, partition, slices)
    amounts = [col(w).cast("bigint") if w else F.lit(1).cast("bigint") for w in weights.values()]
    totals = _per_slice(table, partition, [F.sum(a).alias(f"_sum{i}") for i, a in enumerate(amounts)])
    before = _slice_order(partition).rowsBetween(Window.unboundedPreceding, -1)
    offsets = {f"_offset{i}": F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)) for i in range(len(targets))}
    carried = totals.withColumns(offsets).drop(*[f"_sum{i}" for i in range(len(targets))])
    joined = _join_back(table, carried, partition)
    inside = Window.partitionBy(*[col(c) for c in partition], _SLICE).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = {t: F.col(f"_offset{i}") + F.coalesce(F.sum(a).over(inside), F.lit(0)) for i, (t, a) in enumerate(zip(targets, amounts))}
    return joined.withColumns(sums).select(*[col(c) for c in df.columns], *[col(t) for t in targets])


def running_before(
    df: DataFrame,
    order_by: Iterable[str],
    target: str,
    weight: str | None = None,
    partition_by: Iterable[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Adds the sum of ``weight`` (default 1) over all earlier rows."""
    return running_sums(df, order_by, {target: weight}, partition_by, slices)


def with_position(
    df: DataFrame, order_by: Iterable[str], target: str = "index", partition_by: Iterable[str] = ()
) -> DataFrame:
    """Adds each row's position, counted from 0, in the given order."""
    if target in df.columns:
        raise ValueError(f"column {target!r} already exists")
    return running_before(df, order_by, target, partition_by=partition_by)


def ffill(
    df: DataFrame, columns: str | Iterable[str], order_by: Iterable[str], partition_by: Iterable[str] = ()
) -> DataFrame:
    """Fill NULLs with the last value before them in the given order."""
    return _fill(df, columns, order_by, partition_by, forward=True)


def bfill(
    df: DataFrame, columns: str | Iterable[str], order_by: Iterable[str], partition_by: Iterable[str] = ()
) -> DataFrame:
    """Fill NULLs with the next value after them in the given order."""
    return _fill(df, columns, order_by, partition_by, forward=False)


def _fill(
    df: DataFrame, columns: str | Iterable[str], order_by: Iterable[str], partition_by: Iterable[str], forward: bool
) -> DataFrame:
    columns, order, partition = as_list(columns), as_list(order_by), as_list(partition_by)
    require(df, columns)
    if set(columns) & set(order + partition):
        raise ValueError("a filled column cannot also be an order or partition key")
    table = sliced(df, order, partition)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order(order))])
    pick = F.max_by if forward else F.min_by
    ends = [
        pick(F.when(col(c).isNotNull(), col(c)), F.when(col(c).isNotNull(), place)).alias(f"_end{i}")
        for i, c in enumerate(columns)
    ]
    carried = _per_slice(table, partition, ends)
    span = _slice_order(partition)
    for i in range(len(columns)):
        if forward:
            near = F.last(f"_end{i}", ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, -1))
        else:
            near = F.first(f"_end{i}", ignorenulls=True).over(span.rowsBetween(1, Window.unboundedFollowing))
        carried = carried.withColumn(f"_carry{i}", near)
    carried = carried.drop(*[f"_end{i}" for i in range(len(columns))])
    joined = _join_back(table, carried, partition)
    # The backward fill runs the window in reverse order: a frame that ends at
    # the current row is kept as a running value instead of being rescanned.
    ordering = _order(order) if forward else [c.desc() for c in _order(order)]
    inside = Window.partitionBy(*[col(c) for c in partition], _SLICE).orderBy(*ordering)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(col(c), ignorenulls=True).over(inside), F.col(f"_carry{i}")) for i, c in enumerate(columns)}
    return joined.withColumns(filled).select(*[col(c) for c in df.columns])
