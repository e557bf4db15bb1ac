"""Exact quantiles that never gather a whole column, or group, in one task.

The built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here a sketch first brackets each wanted rank. The values below
a bracket are only counted; those inside it (a fixed small share of the group) are
counted by equal-width step, and only the step that covers the rank is sorted. All
passes combine on the map side, so a group holding a third of all rows costs no
more shuffle than any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import as_double, as_list, col
from ..functions.skew import SALT, salted_join
from ..session import materialize

# A sketch of accuracy A places a quantile within 1/A of its true rank; the
# bracket spans MARGIN times that on either side. A bracket must also reach a few
# whole ranks: small groups use the wide one, tiny groups their whole range.
GLOBAL_ACCURACY = 50_000
GROUP_ACCURACY = 10_000
MARGIN = 4
WIDE_REACH = 0.01
MIN_RANKS = 3
# Equal-width steps a bracket is cut into before anything is sorted.
STEPS = 1024


def exact_quantiles(
    df: DataFrame, columns: Iterable[str], probs: Sequence[float], by: Iterable[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group.

    Result columns are the ``by`` keys and ``<column>__<i>`` for the i-th
    probability. Without ``by`` there is exactly one row. NULL keys are left out,
    NULL and NaN values ignored.
    """
    columns, keys = as_list(columns), as_list(by)
    names = [f"_k{i}" for i in range(len(keys))]
    spots = [(j, i) for j in range(len(columns)) for i in range(len(probs))]
    base = df.select(
        *[col(k).alias(n) for k, n in zip(keys, names)],
        *[F.nanvl(as_double(df, c), F.lit(None)).alias(f"_v{j}") for j, c in enumerate(columns)],
    )
    for n in names:
        base = base.filter(F.col(n).isNotNull())

    joined = _with_brackets(base, names, len(columns), probs)
    below = joined.groupBy(*names, *([SALT] if names else [])).agg(
        *[F.max(f"_n{j}").alias(f"_n{j}") for j in range(len(columns))],
        *[F.count_if(F.col(f"_v{j}") < F.col(f"_lo{j}_{i}")).alias(f"_b{j}_{i}") for j, i in spots],
    )
    if names:
        below = below.groupBy(*names).agg(*[F.max(c).alias(c) if c.startswith("_n") else F.sum(c).alias(c) for c in below.columns if c[:2] in ("_n", "_b")])
    starts = _long(below, names, [_start(j, i, probs[i]) for j, i in spots]).filter(F.col("_h").isNotNull())

    counted = _inside(joined, names, spots)
    at = [*names, "_c", "_p"]
    per_step = counted.groupBy(*at, "_step").agg(F.sum("_count").alias("_size"))
    ladder = Window.partitionBy(*at).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    climbed = per_step.withColumn("_climb", F.sum("_size").over(ladder)).join(starts, at)
    climbed = climbed.withColumn("_after", F.col("_base") + F.col("_climb"))
    climbed = climbed.withColumn("_before", F.col("_after") - F.col("_size"))
    hit = climbed.filter(_covers(F.floor("_h")) | _covers(F.ceil("_h")))
    wanted = hit.select(*[F.col(n).alias("w" + n) for n in [*at, "_step"]], "_h", F.col("_before").alias("_offset"))
    close = counted.join(wanted, [F.col(n) == F.col("w" + n) for n in [*at, "_step"]])

    order = Window.partitionBy(*at, "_step").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = close.withColumn("_after", F.col("_offset") + F.sum("_count").over(order))
    ranked = ranked.withColumn("_before", F.col("_after") - F.col("_count"))
    picked = ranked.groupBy(*at).agg(
        F.max(F.when(_covers(F.floor("_h")), F.col("_value"))).alias("_x0"),
        F.max(F.when(_covers(F.ceil("_h")), F.col("_value"))).alias("_x1"),
    )
    # Every group with a value has a start; one without a pick would be an error.
    solved = starts.join(picked, at, "left").select(*at, _interpolated().alias("_q"))
    wide = solved.groupBy(*names).agg(
        *[F.max(F.when((F.col("_c") == j) & (F.col("_p") == i), F.col("_q"))).alias(f"{columns[j]}__{i}") for j, i in spots]
    )
    outputs = [col(f"{columns[j]}__{i}") for j, i in spots]
    return wide.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *outputs)


def _with_brackets(base: DataFrame, names: list[str], width: int, probs: Sequence[float]) -> DataFrame:
    """Each row with its group's bracket per column and probability.

    Sketches merge in no fixed order, so the brackets are computed once and kept:
    every later pass, and every retry of a task, sees the same ones.
    """
    accuracy = GROUP_ACCURACY if names else GLOBAL_ACCURACY
    reaches = [MARGIN / accuracy, WIDE_REACH]
    edges = [max(p - r, 0.0) for p in probs for r in reaches] + [min(p + r, 1.0) for p in probs for r in reaches]
    wanted = []
    for j in range(width):
        v = F.col(f"_v{j}")
        wanted += [F.count(v).alias(f"_n{j}"), F.min(v).alias(f"_min{j}"), F.max(v).alias(f"_max{j}")]
        wanted.append(F.percentile_approx(v, edges, accuracy).alias(f"_edges{j}"))
    sketch = base.groupBy(*names).agg(*wanted)
    brackets = sketch.select(
        *[F.col(n).alias("b" + n) for n in names],
        *[F.col(f"_n{j}") for j in range(width)],
        *[
            c
            for j in range(width)
            for i in range(len(probs))
            for c in (
                _edge(j, edges, 2 * i, reaches, "_min", 0.0).alias(f"_lo{j}_{i}"),
                _edge(j, edges, 2 * (len(probs) + i), reaches, "_max", 1.0).alias(f"_hi{j}_{i}"),
            )
        ],
    )
    if names:
        # Spark broadcasts the brackets when they are small.
        kept = materialize(brackets, "brackets")
        return salted_join(base, kept, [(n, "b" + n) for n in names])
    kept = base.sparkSession.createDataFrame(brackets.collect(), brackets.schema)  # a single row
    return base.crossJoin(F.broadcast(kept))


def _edge(j: int, edges: list[float], at: int, reaches: list[float], outermost: str, limit: float) -> Column:
    """The narrowest edge that lies at least MIN_RANKS ranks away from the target."""
    chosen = F.col(f"{outermost}{j}")
    for step in (1, 0):
        if edges[at + step] != limit:
            far_enough = F.col(f"_n{j}") * F.lit(reaches[step]) >= MIN_RANKS
            chosen = F.when(far_enough, F.col(f"_edges{j}")[at + step]).otherwise(chosen)
    return chosen


def _start(j: int, i: int, prob: float) -> Column:
    """Wanted rank _h and the number of values below the bracket."""
    n = F.col(f"_n{j}")
    rank = F.when(n > 0, (n - 1) * F.lit(float(prob)))
    return F.struct(F.lit(j).alias("_c"), F.lit(i).alias("_p"), rank.alias("_h"), F.col(f"_b{j}_{i}").alias("_base"))


def _long(df: DataFrame, names: list[str], cells: list[Column]) -> DataFrame:
    return df.select(*names, F.inline(F.array(*cells)))


def _inside(joined: DataFrame, names: list[str], spots: list[tuple[int, int]]) -> DataFrame:
    """Values inside a bracket, counted, with the step of the bracket they fall in."""
    near = [F.col(f"_v{j}").between(F.col(f"_lo{j}_{i}"), F.col(f"_hi{j}_{i}")) for j, i in spots]
    # Most rows lie in no bracket and go no further.
    few = joined.filter(reduce(lambda a, b: a | b, near))
    cells = [
        F.struct(
            F.lit(j).alias("_c"),
            F.lit(i).alias("_p"),
            F.col(f"_v{j}").alias("_value"),
            F.col(f"_lo{j}_{i}").alias("_lo"),
            F.col(f"_hi{j}_{i}").alias("_hi"),
        )
        for j, i in spots
    ]
    spread = _long(few, names, cells).filter(F.col("_value").between(F.col("_lo"), F.col("_hi")))
    height = F.try_divide((F.col("_value") - F.col("_lo")) * STEPS, F.col("_hi") - F.col("_lo"))
    step = F.least(F.floor(F.coalesce(height, F.lit(0.0))), F.lit(STEPS - 1)).cast("int")
    return spread.groupBy(*names, "_c", "_p", F.coalesce(step, F.lit(0)).alias("_step"), "_value").agg(
        F.count(F.lit(1)).alias("_count")
    )


def _covers(rank: Column) -> Column:
    """The entry whose copies cover the rank."""
    return (F.col("_before") <= rank) & (F.col("_after") > rank)


def _interpolated() -> Column:
    x0, x1, part = F.col("_x0"), F.col("_x1"), F.col("_h") - F.floor("_h")
    between = F.when(part < 0.5, x0 + (x1 - x0) * part).otherwise(x1 - (x1 - x0) * (1 - part))
    missed = F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")
    return F.when(x0.isNull() | x1.isNull(), missed).when(x0 == x1, x0).otherwise(between)
