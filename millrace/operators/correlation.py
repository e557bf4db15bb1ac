"""Pearson and Spearman correlation, pairwise complete."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, as_list, col, numeric_columns, require, require_numeric, text_columns
from ..functions.moments import rows_from, safe_corr
from ..session import materialize
from .ordering import running_before, running_sums
from .profile import value_summary

# Pairs of one aggregate; more are summed up in blocks of columns.
PAIRS_PER_PASS = 120


# More patterns of missing values than this are not told apart; then pairs are ranked one by one.
MOST_PATTERNS = 64
# Columns a side in one scan: a task keeps four numbers a pair.
BLOCK = 512
PARTS = 64


def _pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    if len(pairs) > PAIRS_PER_PASS:
        return _block_pairs(df, pairs)
    stats = df.agg(*[safe_corr(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return rows_from(
        stats,
        [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)],
    )


class Moments:
    """Counts, means and centred squares and products of all pairs of left and right columns, over rows that hold both."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        # Centred by the batch's own means first, so that sums of squares keep their digits.
        with np.errstate(invalid="ignore"):
            sides = []
            for x in (left, right):
                there = ~np.isnan(x)
                held = np.where(there, x, 0.0)
                shift = held.sum(axis=0) / np.maximum(there.sum(axis=0), 1)
                sides.append((there.astype(float), np.where(there, x - shift, 0.0), shift))
            (m, a, sa), (k, b, sb) = sides
            self.n = m.T @ k
            n = np.maximum(self.n, 1)
            ta, tb = a.T @ k, m.T @ b
            self.a, self.b = sa[:, None] + ta / n, sb[None] + tb / n
            self.aa, self.bb, self.ab = (a * a).T @ k - ta * ta / n, m.T @ (b * b) - tb * tb / n, a.T @ b - ta * tb / n

    def add(self, other: "Moments") -> None:
        n = self.n + other.n
        part = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        da, db = other.a - self.a, other.b - self.b
        both = self.n * part
        self.aa, self.bb, self.ab = self.aa + other.aa + da * da * both, self.bb + other.bb + db * db * both, self.ab + other.ab + da * db * both
        self.a, self.b, self.n = self.a + da * part, self.b + db * part, n

    def fields(self) -> list[np.ndarray]:
        return [self.n, self.a, self.b, self.aa, self.bb, self.ab]

    @classmethod
    def of(cls, fields: list[np.ndarray]) -> "Moments":
        made = cls.__new__(cls)
        made.n, made.a, made.b, made.aa, made.bb, made.ab = fields
        return made


def _block_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Many pairs in one scan: every task sums up whole blocks of columns, a row of a block at a time is put together."""
    firsts, seconds = (list(dict.fromkeys(p[side] for p in pairs)) for side in (0, 1))
    fields = ["n", "a", "b", "aa", "bb", "ab"]
    parts = []
    for lo in range(0, len(firsts), BLOCK):
        for at in range(0, len(seconds), BLOCK):
            left, right = firsts[lo : lo + BLOCK], seconds[at : at + BLOCK]
            wide = len(left)
            table = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate([*left, *right])])

            def summed(batches: Iterator[pa.RecordBatch], wide: int = wide) -> Iterator[pa.RecordBatch]:
                total = None
                for batch in batches:
                    if batch.num_rows:
                        values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                        mine = Moments(values[:, :wide], values[:, wide:])
                        if total is None:
                            total = mine
                        else:
                            total.add(mine)
                if total is not None:
                    rows = [pa.array(range(wide), pa.int32()), *[pa.array(list(f), pa.list_(pa.float64())) for f in total.fields()]]
                    yield pa.RecordBatch.from_arrays(rows, ["i", *fields])

            def merged(rows: pd.DataFrame) -> pd.DataFrame:
                total = None
                for r in rows.itertuples(index=False):
                    mine = Moments.of([np.asarray(getattr(r, f)) for f in fields])
                    if total is None:
                        total = mine
                    else:
                        total.add(mine)
                return pd.DataFrame({"i": [rows["i"].iloc[0]], "part": [0], **{f: [v] for f, v in zip(fields, total.fields())}})

            arrays = ", ".join(f"{f} array<double>" for f in fields)
            found = table.mapInArrow(summed, f"i int, {arrays}").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
            for keys in (["i", "part"], ["i"]):
                found = found.groupBy(*keys).applyInPandas(merged, f"i int, part int, {arrays}")
            names = [F.array(*[F.lit(c) for c in side]) for side in (left, right)]
            cells = found.select(F.element_at(names[0], F.col("i") + 1).alias("feature_1"), F.posexplode(F.arrays_zip("aa", "bb", "ab")).alias("j", "s"))
            r = F.try_divide(F.col("s.ab"), F.sqrt(F.greatest(F.col("s.aa"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("s.bb"), F.lit(0.0))))
            known = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
            parts.append(cells.select("feature_1", F.element_at(names[1], F.col("j") + 1).alias("feature_2"), known.alias("correlation")))
    wanted = df.sparkSession.createDataFrame(pairs, "feature_1 string, feature_2 string")
    return wanted.join(reduce(DataFrame.unionByName, parts), ["feature_1", "feature_2"], "left")


def _spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of average ranks, over each pair's complete rows.

    A value's rank among the rows that hold a partner too is the sum of its ranks in the
    patterns of missing values that hold both. So every column is ranked once, with a
    running count for each pattern, whatever the number of pairs.
    """
    names = sorted({c for pair in pairs for c in pair}, key=df.columns.index)
    if len(names) > 62:
        return _own_rank_pairs(df, pairs)
    there = [F.when(as_double(df, c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(names)]
    table = df.select(reduce(Column.__add__, there).alias("_p"), *[as_double(df, c).alias(f"_c{i}") for i, c in enumerate(names)])
    patterns = [r["_p"] for r in table.select("_p").distinct().limit(MOST_PATTERNS + 1).collect()]
    if len(patterns) > MOST_PATTERNS or not patterns:
        return _own_rank_pairs(df, pairs)
    return _pattern_rank_pairs(table, names, sorted(patterns), pairs)


def _pattern_rank_pairs(table: DataFrame, names: list[str], patterns: list[int], pairs: list[tuple[str, str]]) -> DataFrame:
    cells = table.unpivot(["_p"], [f"_c{i}" for i in range(len(names))], "_c", "_v").filter(F.col("_v").isNotNull())
    counts = cells.groupBy("_c", "_v").agg(*[F.count_if(F.col("_p") == p).alias(f"_n{k}") for k, p in enumerate(patterns)])
    placed = running_sums(counts, ["_v"], {f"_before{k}": f"_n{k}" for k in range(len(patterns))}, partition_by=["_c"])
    place = {c: i for i, c in enumerate(names)}

    def held(*columns: str) -> tuple[int, ...]:
        """The patterns that hold all of these columns."""
        return tuple(k for k, p in enumerate(patterns) if all(p >> place[c] & 1 for c in columns))

    ranks: dict[str, dict[tuple[int, ...], str]] = {c: {} for c in names}
    for pair in pairs:
        for c in pair:
            ranks[c].setdefault(held(*pair), f"_r{place[c]}_{len(ranks[c])}")
    for c, wanted in ranks.items():
        i = place[c]
        mine = placed.filter(F.col("_c") == f"_c{i}")
        # The average rank of equal values, less the one half that is the same for all.
        sums = [reduce(Column.__add__, [F.col(f"_before{k}") + F.col(f"_n{k}") / 2 for k in among], F.lit(0.0)).alias(name) for among, name in wanted.items()]
        # Hot values are split at run time: the rank side has one row per value.
        table = table.join(mine.select(F.col("_v").alias(f"_v{i}"), *sums), F.col(f"_c{i}") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    stats = table.agg(*[safe_corr(F.col(ranks[a][held(a, b)]), F.col(ranks[b][held(a, b)])).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return rows_from(
        stats,
        [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)],
    )


def _own_rank_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rank correlation of pairs that each have their own set of complete rows.

    Equal (x, y) combinations are counted first and carry their count from then
    on, so hot values collapse before anything is ranked or joined.
    """
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_p"), as_double(df, a).alias("_x"), as_double(df, b).alias("_y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    complete = df.select(F.inline(cells)).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # Read twice below, so written once.
    combos = materialize(complete.groupBy("_p", "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "combos")
    ends = F.array(
        F.struct(F.lit(0).alias("_s"), F.col("_x").alias("_v")), F.struct(F.lit(1).alias("_s"), F.col("_y").alias("_v"))
    )
    counts = combos.select("_p", "_n", F.inline(ends)).groupBy("_p", "_s", "_v").agg(F.sum("_n").alias("_n"))
    placed = running_before(counts, ["_v"], "_before", weight="_n", partition_by=["_p", "_s"])
    ranks = placed.select("_p", "_s", "_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))
    for side, value in ((0, "_x"), (1, "_y")):
        mine = ranks.filter(F.col("_s") == side).select("_p", F.col("_v").alias(value), F.col("_rank").alias(f"_r{side}"))
        combos = combos.join(mine, ["_p", value])
    # Average ranks of n values always have mean (n + 1) / 2: centre before
    # multiplying so that large tables lose no precision.
    sizes = combos.groupBy("_p").agg(((F.sum("_n") + 1) / 2).alias("_mid"))
    centred = combos.join(F.broadcast(sizes), "_p").select(
        "_p", "_n", (F.col("_r0") - F.col("_mid")).alias("_a"), (F.col("_r1") - F.col("_mid")).alias("_b")
    )
    n, a, b = F.col("_n"), F.col("_a"), F.col("_b")
    r = F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b)))
    solved = centred.groupBy("_p").agg(r.alias("_r"))
    labels = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "_p int, feature_1 string, feature_2 string")
    # greatest and least skip NULLs, so a constant column needs the guard.
    known = F.when(F.col("_r").isNotNull(), F.least(F.greatest(F.col("_r"), F.lit(-1.0)), F.lit(1.0)))
    return F.broadcast(labels).join(F.broadcast(solved), "_p", "left").select("feature_1", "feature_2", known.alias("correlation"))


def correlation_pairs(df: DataFrame, columns: Iterable[str] | None = None, method: str = "pearson") -> DataFrame:
    """(feature_1, feature_2, correlation) for every unordered pair of columns."""
    columns = as_list(columns) if columns is not None else numeric_columns(df)
    require_numeric(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        raise ValueError("need at least two numeric columns")
    if method == "pearson":
        return _pearson_pairs(df, pairs)
    if method == "spearman":
        return _spearman_pairs(df, pairs)
    raise ValueError(f"method must be pearson or spearman, not {method!r}")


def correlation(df: DataFrame, columns: Iterable[str] | None = None, method: str = "pearson") -> DataFrame:
    """The full matrix in long form, both triangles and the diagonal."""
    columns = as_list(columns) if columns is not None else numeric_columns(df)
    upper = correlation_pairs(df, columns, method)
    both = upper.select(
        F.inline(
            F.array(
                F.struct("feature_1", "feature_2", "correlation"),
                F.struct(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), F.col("correlation")),
            )
        )
    )
    varies = df.agg(*[F.when(F.min(col(c)) != F.max(col(c)), 1.0).alias(f"d{i}") for i, c in enumerate(columns)])
    diagonal = rows_from(
        varies,
        [
            F.struct(F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"), F.col(f"d{i}").alias("correlation"))
            for i, c in enumerate(columns)
        ],
    )
    return both.unionByName(diagonal)


def target_correlation(df: DataFrame, target: str, columns: Iterable[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation of every other column with the target, highest first."""
    columns = as_list(columns) if columns is not None else numeric_columns(df)
    others = [c for c in columns if c != target]
    require_numeric(df, others + [target])
    pairs = [(c, target) for c in others]
    found = _pearson_pairs(df, pairs) if method == "pearson" else _spearman_pairs(df, pairs)
    return found.select(F.col("feature_1").alias("feature"), "correlation").orderBy(F.desc_nulls_last("correlation"), "feature")


def correlated_pairs(df: DataFrame, threshold: float = 0.7, columns: Iterable[str] | None = None, k: int | None = None) -> DataFrame:
    """Pairs whose |r| exceeds the threshold, strongest first."""
    strong = correlation_pairs(df, columns).filter(F.abs("correlation") > threshold)
    ordered = strong.orderBy(F.desc(F.abs("correlation")), "feature_1", "feature_2")
    return ordered if k is None else ordered.limit(k)


# Text columns with more values than this are not turned into codes (fixed value).
MAX_CODES = 20


def codes_for_correlation(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, list[str]]:
    """Sorted values of each text column that has at most MAX_CODES of them."""
    columns = as_list(columns) if columns is not None else text_columns(df)
    if not columns:
        return {}
    require(df, columns)
    counts = value_summary(df, columns).first()
    small = [c for i, c in enumerate(columns) if counts[f"u{i}"] <= MAX_CODES]
    if not small:
        return {}
    values = df.agg(*[F.sort_array(F.collect_set(col(c))).alias(f"v{i}") for i, c in enumerate(small)]).first()
    return {c: list(values[f"v{i}"]) for i, c in enumerate(small)}


def encode_for_correlation(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace low-cardinality text columns by alphabetical codes; NULL stays NULL."""
    codes = codes_for_correlation(df, columns)
    encoded = {
        c: F.when(col(c).isNotNull(), (F.array_position(F.array(*[F.lit(v) for v in values]), col(c)) - 1).cast("int"))
        if values
        else F.lit(None).cast("int")
        for c, values in codes.items()
    }
    return df.withColumns(encoded) if encoded else df
