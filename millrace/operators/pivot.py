"""Group statistics and pivot tables with totals and percentages."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, as_list, col, require, require_numeric
from .chart import series
from .quantiles import exact_quantiles

AGGREGATES = ("sum", "mean", "median", "count", "min", "max", "std", "var")
TOTAL = "Total"
# A key may be named Total itself, so totals carry these flags until they are placed.
_ROW_TOTAL, _COLUMN_TOTAL = "_row_total", "_column_total"


def _aggregate(agg: str, c: Column) -> Column:
    return {
        "sum": F.coalesce(F.sum(c), F.lit(0.0)),
        "mean": F.avg(c),
        "count": F.count(c).cast("double"),
        "min": F.min(c),
        "max": F.max(c),
        "std": F.stddev_samp(c),
        "var": F.var_samp(c),
    }[agg]


def _plain(values: list[str], aggs: list[str]) -> list[Column]:
    return [_aggregate(a, col(v)).alias(f"{v}__{a}") for v in values for a in aggs if a != "median"]


def group_statistics(df: DataFrame, keys: Iterable[str], values: Iterable[str], aggs: Iterable[str]) -> DataFrame:
    """Aggregates per group as ``<value>__<agg>`` doubles.

    Groups with a NULL key are left out, and so are groups where every statistic
    is NULL; the sum of a group without values is 0.
    """
    keys, values, aggs = as_list(keys), as_list(values), as_list(aggs)
    base = df.select(*[col(k) for k in keys], *[as_double(df, v).alias(v) for v in values if v not in keys])
    for k in keys:
        base = base.filter(col(k).isNotNull())
    stats = base.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows"), *_plain(values, aggs)).drop("_rows")
    if "median" in aggs:
        stats = _with_medians(stats, base, keys, values)
    cells = [col(f"{v}__{a}") for v in values for a in aggs]
    some = reduce(lambda a, b: a | b, [c.isNotNull() for c in cells])
    return stats.filter(some).select(*[col(k) for k in keys], *cells)


def _with_medians(stats: DataFrame, base: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    medians = exact_quantiles(base, values, [0.5], keys)
    named = medians.select(
        *[col(k).alias(f"_m{i}") for i, k in enumerate(keys)],
        *[col(f"{v}__0").alias(f"{v}__median") for v in values],
    )
    if not keys:
        return stats.crossJoin(F.broadcast(named))
    joined = stats.join(named, [col(k) == F.col(f"_m{i}") for i, k in enumerate(keys)], "left")
    return joined.drop(*[f"_m{i}" for i in range(len(keys))])


def pivot(
    df: DataFrame,
    rows: str | Iterable[str],
    values: str | Iterable[str],
    columns: str | Iterable[str] = (),
    aggs: str | Iterable[str] = "sum",
    fill_value: float | None = 0.0,
    margins: bool = False,
    normalize: str | None = None,
    sort: str | None = None,
) -> DataFrame:
    """A pivot table, one row per ``rows`` key and one column per statistic.

    Columns are named ``<value>[_<agg>][_<column key>...]``; the aggregate is named
    when there are several. Rows with NULL keys are left out. ``margins`` adds a
    Total row and column computed from the source rows that are complete in every
    used column; row keys then become text. ``normalize`` is ``all``, ``index`` or
    ``columns`` and gives percentages of totals that include the margins shown.
    ``sort`` is ``asc`` or ``desc`` by the first value column.
    """
    rows, values, columns, aggs = as_list(rows), as_list(values), as_list(columns), as_list(aggs)
    require(df, rows + columns)
    require_numeric(df, values)
    if not rows and not columns:
        raise ValueError("choose at least one row or column field")
    if not values or not aggs or set(aggs) - set(AGGREGATES):
        raise ValueError(f"choose value fields and aggregates among {AGGREGATES}")
    if not rows:
        long = _long_by_value(df, columns, values)
        return pivot(long, "value", "cell", columns, aggs, fill_value, margins, normalize, sort)

    body = group_statistics(df, rows + columns, values, aggs)
    heads = _column_heads(df, columns) if columns else []
    if margins:
        body = body.select(*[col(k).cast("string").alias(k) for k in rows + columns], *_cells(values, aggs), F.lit(False).alias(_ROW_TOTAL), F.lit(False).alias(_COLUMN_TOTAL))
        body = body.unionByName(_margin_rows(df, rows, columns, values, aggs))
    wide = _spread(body, rows, columns, values, aggs, heads, margins) if columns else _rename(body, rows, values, aggs)
    outputs = [c for c in wide.columns if c not in rows]
    if fill_value is not None:
        wide = wide.withColumns({c: F.coalesce(col(c), F.lit(float(fill_value))) for c in outputs})
    if normalize:
        wide = _normalized(wide, rows, outputs, normalize)
    if sort:
        first = col(outputs[0])
        wide = wide.orderBy(first.desc_nulls_last() if sort == "desc" else first.asc_nulls_last())
    return wide


def _cells(values: list[str], aggs: list[str]) -> list[Column]:
    return [col(f"{v}__{a}") for v in values for a in aggs]


def _label(value: str, agg: str, aggs: list[str], head: Iterable[str] = ()) -> str:
    parts = [value] + ([agg] if len(aggs) > 1 else []) + list(head)
    return "_".join(parts)


def _rename(body: DataFrame, rows: list[str], values: list[str], aggs: list[str]) -> DataFrame:
    return body.select(*[col(r) for r in rows], *[col(f"{v}__{a}").alias(_label(v, a, aggs)) for v in values for a in aggs])


def _long_by_value(df: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    """Without row fields the value names become the rows."""
    keyed = df.select(*[col(c) for c in columns], *[as_double(df, v).alias(f"_v{i}") for i, v in enumerate(values)])
    cells = F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"_v{i}").alias("cell")) for i, v in enumerate(values)])
    return keyed.select(*[col(c) for c in columns], F.inline(cells))


def _column_heads(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """The distinct column keys, which become part of the schema."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    keys = df.select(*[col(c) for c in columns]).dropna().distinct()
    found = keys.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} column keys; raise spark.sql.pivotMaxValues or use a row field")
    ordered = sorted(found, key=tuple)
    strings = keys.sparkSession.createDataFrame(ordered, keys.schema) if ordered else None
    if strings is None:
        return []
    return [list(r) for r in strings.select(*[col(c).cast("string") for c in columns]).collect()]


def _margin_rows(df: DataFrame, rows: list[str], columns: list[str], values: list[str], aggs: list[str]) -> DataFrame:
    """Total cells from complete source rows: per row key, per column key, overall.

    All totals come from one pass over grouping sets; medians, which no pass can
    combine, are found per set.
    """
    base = df.select(*[col(k).cast("string").alias(k) for k in rows + columns], *[as_double(df, v).alias(v) for v in values])
    base = base.dropna()
    sets = [rows, columns, []] if columns else [[]]
    keys = rows + columns
    grouped = base.groupingSets([[col(k) for k in s] for s in sets], *[col(k) for k in keys])
    stats = grouped.agg(F.count(F.lit(1)).alias("_rows"), *_plain(values, aggs)).filter(F.col("_rows") > 0)
    # Complete rows hold no NULL key, so NULL marks a key that was totalled over.
    if "median" in aggs:
        medians = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [exact_quantiles(base, values, [0.5], s).withColumnsRenamed({f"{v}__0": f"{v}__median" for v in values}) for s in sets],
        )
        named = medians.select(
            *[(col(k) if k in medians.columns else F.lit(None).cast("string")).alias(f"_m{i}") for i, k in enumerate(keys)],
            *[col(f"{v}__median") for v in values],
        )
        stats = stats.join(named, [col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)], "left")
    labels = [
        F.coalesce(col(k), F.lit(TOTAL if i == 0 else "")).alias(k) for fields in (rows, columns) for i, k in enumerate(fields)
    ]
    flags = [(col(fields[0]).isNull() if fields else F.lit(False)).alias(flag) for fields, flag in ((rows, _ROW_TOTAL), (columns, _COLUMN_TOTAL))]
    return stats.select(*labels, *_cells(values, aggs), *flags)


def _spread(
    body: DataFrame, rows: list[str], columns: list[str], values: list[str], aggs: list[str], heads: list[list[str]], margins: bool
) -> DataFrame:
    """One column per value, aggregate and head; the total of all heads comes last."""
    flags = [F.col(_ROW_TOTAL)] if margins else []
    total = F.col(_COLUMN_TOTAL) if margins else F.lit(False)
    places = [(head, ~total & reduce(lambda a, b: a & b, [col(c).cast("string") == h for c, h in zip(columns, head, strict=True)])) for head in heads]
    if margins:
        places.append(([TOTAL], total))
    labels = [_label(v, a, aggs, head) for v in values for a in aggs for head, _ in places]
    twice = {x for x in [*labels, *rows] if [*labels, *rows].count(x) > 1}
    if twice:
        raise ValueError(f"column keys give one name to several columns: {', '.join(sorted(twice))}")
    wanted = [F.max(F.when(here, col(f"{v}__{a}"))) for v in values for a in aggs for _, here in places]
    wide = body.groupBy(*[col(r) for r in rows], *flags).agg(*[w.alias(x) for w, x in zip(wanted, labels, strict=True)])
    return wide.drop(_ROW_TOTAL)


def _normalized(wide: DataFrame, rows: list[str], outputs: list[str], normalize: str) -> DataFrame:
    def summed(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])

    cells = {c: col(c) for c in outputs}
    if normalize == "index":
        whole = summed(list(cells.values()))
        return wide.select(*[col(r) for r in rows], *[(F.try_divide(cells[c], whole) * 100).alias(c) for c in outputs])
    if normalize not in ("all", "columns"):
        raise ValueError(f"normalize must be all, index or columns, not {normalize!r}")
    sums = wide.agg(*[F.sum(cells[c]).alias(f"_t{i}") for i, c in enumerate(outputs)])
    joined = wide.crossJoin(F.broadcast(sums))
    if normalize == "all":
        whole = summed([F.col(f"_t{i}") for i in range(len(outputs))])
        bases = [whole] * len(outputs)
    else:
        bases = [F.col(f"_t{i}") for i in range(len(outputs))]
    return joined.select(
        *[col(r) for r in rows], *[(F.try_divide(cells[c], bases[i]) * 100).alias(c) for i, c in enumerate(outputs)]
    )


def pivot_series(table: DataFrame, rows: Iterable[str]) -> DataFrame:
    """A pivot table in long form for charts."""
    rows = as_list(rows)
    key = table.withColumn("_x", F.concat_ws(" / ", *[col(r).cast("string") for r in rows]))
    return series(key, "_x", [c for c in table.columns if c not in rows]).withColumnRenamed("_x", "x")
