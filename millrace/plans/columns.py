"""Columns, predicates and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chart, columns as ops, fuzzy, profile, text
from .registry import CUSTOMERS, EVENTS, LINES, MESSY, TYPED, query, table


# -- add, drop, list --------------------------------------------------------
@query("SELECT *, CAST(1.5 AS DOUBLE) AS rate, CAST(7 AS BIGINT) AS batch, CAST(NULL AS VARCHAR) AS remark FROM customer")
def add_column(spark: SparkSession, sf: str) -> DataFrame:
    df = ops.add_column(table(spark, sf, "customer"), "rate", "number", "1.5")
    df = ops.add_column(df, "batch", "integer", "7")
    return ops.add_column(df, "remark", "text")


@query("SELECT *, CAST(NULL AS VARCHAR) AS first, CAST(NULL AS VARCHAR) AS second FROM supplier")
def add_columns(spark: SparkSession, sf: str) -> DataFrame:
    return ops.add_columns(table(spark, sf, "supplier"), [" first ", "second", "s_name", ""])


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return ops.drop_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@query(
    f"WITH t AS {LINES.sql} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, COUNT(*) - COUNT({c}) AS missing, COUNT(DISTINCT {c}) AS \"unique\" FROM t"
        for c, t in _LINE_TYPES.items()
    )
)
def column_info(spark: SparkSession, sf: str) -> DataFrame:
    return profile.column_info(LINES.df(spark, sf))


@query(
    f"WITH t AS {TYPED.sql} "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, "
        f"(SELECT STRING_AGG(CAST(v AS VARCHAR), ' | ' ORDER BY o_orderkey) FROM "
        f"(SELECT o_orderkey, {c} AS v FROM t WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)) AS samples"
        for i, (c, t) in enumerate(
            [("o_orderkey", "bigint"), ("whole", "string"), ("fraction", "string"), ("flag", "string"), ("day", "string"), ("priority", "string"), ("mixed", "string")]
        )
    )
)
def type_listing(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_listing(TYPED.df(spark, sf), ["o_orderkey"]).withColumn("samples", F.array_join("samples", " | "))


# -- derive -----------------------------------------------------------------
@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_linenumber - 3 AS step,
    l_quantity + (l_linenumber - 3) AS plus, l_quantity - (l_linenumber - 3) AS minus, l_quantity * (l_linenumber - 3) AS times,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / CAST(l_linenumber - 3 AS DOUBLE) END AS over,
    ROUND(POWER(l_quantity, CAST(l_linenumber - 3 AS DOUBLE)), 6) AS power,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity - FLOOR(l_quantity / (l_linenumber - 3)) * (l_linenumber - 3) END AS rest
    FROM lineitem"""
)
def formula_ops(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_linenumber - 3 AS step")
    for name, op in (("plus", "+"), ("minus", "-"), ("times", "*"), ("over", "/"), ("power", "^"), ("rest", "%")):
        df = ops.formula(df, name, "l_quantity", op, "step")
    return df.withColumn("power", F.round("power", 6))


@query(
    """SELECT o_orderkey, ROUND(SQRT(o_totalprice) + LN(o_totalprice) - ABS(o_custkey - 500), 6) AS curve,
    ROUND(o_totalprice / (SELECT MAX(o_totalprice) FROM orders), 9) AS of_top FROM orders"""
)
def expr_column(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    df = ops.expr_column(df, "curve", "round(sqrt(o_totalprice) + ln(o_totalprice) - abs(o_custkey - 500), 6)")
    df = ops.expr_column(df, "of_top", "round(o_totalprice / top, 9)", {"top": "max(o_totalprice)"})
    return df.select("o_orderkey", "curve", "of_top")


@query(
    """SELECT p_partkey, p_retailprice, p_retailprice * CAST(1.1 AS DOUBLE) AS dearer, p_retailprice + CAST(5 AS DOUBLE) AS raised,
    UPPER(p_name) AS loud, LOWER(p_brand) AS quiet, REPLACE(p_name, ' ', '') AS tight,
    CAST(ROUND_EVEN(p_retailprice, 0) AS DOUBLE) AS rounded, p_size AS same FROM part"""
)
def copy_column(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part")
    df = ops.copy_column(df, "p_retailprice", "dearer", "multiply", 1.1)
    df = ops.copy_column(df, "p_retailprice", "raised", "add", 5)
    df = ops.copy_column(df, "p_name", "loud", "upper")
    df = ops.copy_column(df, "p_brand", "quiet", "lower")
    df = ops.copy_column(df, "p_name", "tight", "remove_spaces")
    df = ops.copy_column(df, "p_retailprice", "rounded", "round", 0)
    df = ops.copy_column(df, "p_size", "same")
    return df.select("p_partkey", "p_retailprice", "dearer", "raised", "loud", "quiet", "tight", "rounded", "same")


@query(
    f"""SELECT c_custkey, CASE WHEN COALESCE(c_acctbal > 5000, FALSE) THEN 'rich' ELSE 'other' END AS band,
    CASE WHEN COALESCE(c_mktsegment = 'BUILDING', FALSE) THEN 'site' ELSE c_mktsegment END AS c_mktsegment FROM {CUSTOMERS.sql} t"""
)
def conditional_column(spark: SparkSession, sf: str) -> DataFrame:
    df = CUSTOMERS.df(spark, sf)
    df = ops.conditional_column(df, "band", ops.predicate(df, "c_acctbal", ">", 5000), "rich", "other")
    df = ops.conditional_column(df, "c_mktsegment", ops.predicate(df, "c_mktsegment", "=", "BUILDING"), "site")
    return df.select("c_custkey", "band", "c_mktsegment")


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS c_mktsegment FROM {CUSTOMERS.sql} t")
def replace_value(spark: SparkSession, sf: str) -> DataFrame:
    return ops.replace_value(CUSTOMERS.df(spark, sf), "c_mktsegment", "MACHINERY", "TOOLS").select("c_custkey", "c_mktsegment")


# -- filter -----------------------------------------------------------------
@query(
    f"""SELECT c_custkey, COALESCE(c_mktsegment = 'BUILDING', FALSE) AS eq, NOT COALESCE(c_mktsegment = 'BUILDING', FALSE) AS ne,
    COALESCE(c_acctbal > 100, FALSE) AS gt, COALESCE(c_acctbal < 100, FALSE) AS lt, COALESCE(c_nationkey >= 7, FALSE) AS ge,
    COALESCE(c_nationkey <= 7, FALSE) AS le, COALESCE(REGEXP_MATCHES(c_mktsegment, '(?i)^h.*ld$'), FALSE) AS has,
    COALESCE(c_nationkey = 7, FALSE) AS whole FROM {CUSTOMERS.sql} t"""
)
def predicate_ops(spark: SparkSession, sf: str) -> DataFrame:
    df = CUSTOMERS.df(spark, sf)
    tests = {
        "eq": ("c_mktsegment", "=", "BUILDING"), "ne": ("c_mktsegment", "!=", "BUILDING"), "gt": ("c_acctbal", ">", "100"),
        "lt": ("c_acctbal", "<", "100"), "ge": ("c_nationkey", ">=", 7), "le": ("c_nationkey", "<=", 7),
        "has": ("c_mktsegment", "contains", "^h.*ld$"), "whole": ("c_nationkey", "=", "7"),
    }
    return df.select("c_custkey", *[ops.predicate(df, *t).alias(n) for n, t in tests.items()])


@query(
    f"""SELECT COUNT(*) FILTER (WHERE l_quantity > 40) AS matching, COUNT(*) FILTER (WHERE l_quantity <= 40 OR l_quantity IS NULL) AS not_matching
    FROM {LINES.sql} t"""
)
def predicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = LINES.df(spark, sf)
    return ops.predicate_counts(df, ops.predicate(df, "l_quantity", ">", 40))


@query(f"SELECT event_id, event_type, value FROM {EVENTS.sql} t WHERE event_type = 'error' AND value IS NULL ORDER BY event_id LIMIT 10")
def predicate_preview(spark: SparkSession, sf: str) -> DataFrame:
    df = EVENTS.df(spark, sf)
    affected = ops.predicate(df, "event_type", "=", "error") & df["value"].isNull()
    return ops.predicate_preview(df, affected, ["event_id", "event_type", "value"], ["event_id"])


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark: SparkSession, sf: str) -> DataFrame:
    return ops.filter_equals(table(spark, sf, "orders"), "o_orderstatus", "F")


@query(f"SELECT * FROM {CUSTOMERS.sql} t WHERE c_acctbal IS NOT NULL")
def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.drop_null_rows(CUSTOMERS.df(spark, sf), "c_acctbal")


@query(f"SELECT * FROM {CUSTOMERS.sql} t WHERE c_acctbal IS NULL OR c_mktsegment IS NULL")
def rows_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rows_with_missing(CUSTOMERS.df(spark, sf), ["c_acctbal", "c_mktsegment"])


@query(
    f"""SELECT COUNT(*) FILTER (WHERE l_quantity IS NULL OR l_shipdate IS NULL) AS "rows",
    2 * COUNT(*) - COUNT(l_quantity) - COUNT(l_shipdate) AS cells FROM {LINES.sql} t"""
)
def missing_cells(spark: SparkSession, sf: str) -> DataFrame:
    return ops.missing_cells(LINES.df(spark, sf), ["l_quantity", "l_shipdate"])


@query(f"SELECT DISTINCT event_type FROM {EVENTS.sql} t WHERE event_type IS NOT NULL")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return ops.distinct_values(EVENTS.df(spark, sf), "event_type")


# -- text -------------------------------------------------------------------
_SPACED = r"TRIM(REGEXP_REPLACE(note, '\s+', ' ', 'g'))"


@query(f"SELECT c_custkey, {_SPACED} AS note FROM {MESSY.sql} t")
def clean_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return text.clean_text(MESSY.df(spark, sf), "note", spaces=True)


@query(rf"SELECT c_custkey, REGEXP_REPLACE(note, '[^A-Za-z0-9\s]+', '', 'g') AS note FROM {MESSY.sql} t")
def clean_specials(spark: SparkSession, sf: str) -> DataFrame:
    return text.clean_text(MESSY.df(spark, sf), "note", specials=True)


@query(
    """SELECT p_partkey, ARRAY_TO_STRING(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(p_name || ' o''NEIL a1b', '[A-Za-z]+|[^A-Za-z]+'),
    lambda w: UPPER(w[1]) || LOWER(w[2:])), '') AS p_name FROM part"""
)
def title_case(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").selectExpr("p_partkey", "p_name || \" o'NEIL a1b\" AS p_name")
    return text.clean_text(named, "p_name", case="title")


@query(rf"SELECT c_custkey, LOWER(REGEXP_REPLACE({_SPACED}, '[^A-Za-z0-9\s]+', '', 'g')) AS note FROM {MESSY.sql} t")
def clean_all(spark: SparkSession, sf: str) -> DataFrame:
    return text.clean_text(MESSY.df(spark, sf), "note", spaces=True, specials=True, case="lower")


@query("SELECT doc_id, REPLACE(text, 'the', 'THE') AS text FROM documents")
def replace_text(spark: SparkSession, sf: str) -> DataFrame:
    return text.replace_text(table(spark, sf, "documents").select("doc_id", "text"), "text", "the", "THE")


@query(
    """SELECT ROUND(AVG(LENGTH(text)), 6) AS avg_length, CAST(MAX(LENGTH(text)) AS INTEGER) AS max_length,
    CAST(MIN(LENGTH(text)) AS INTEGER) AS min_length, ROUND(100.0 * COUNT(DISTINCT text) / COUNT(*), 6) AS unique_pct FROM documents"""
)
def text_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = text.text_profile(table(spark, sf, "documents"), "text")
    return found.withColumns({c: F.round(c, 6) for c in ("avg_length", "unique_pct")})


def histogram_sql(value: str, source: str, bins: int, group: str | None = None) -> str:
    """Equal-width bins of a value expression over a source."""
    by = f"{group}, " if group else ""
    return f"""WITH t AS (SELECT {by}CAST({value} AS DOUBLE) AS v FROM {source} AS s WHERE {value} IS NOT NULL),
    e AS (SELECT MIN(v) AS lo, MAX(v) AS hi, (MAX(v) - MIN(v)) / {bins} AS w FROM t)
    SELECT {by}CAST(LEAST(FLOOR((v - lo) / w), {bins - 1}) AS INTEGER) AS bin,
    ROUND(MIN(lo) + LEAST(FLOOR((v - lo) / w), {bins - 1}) * MIN(w), 6) AS bin_start, COUNT(*) AS "count"
    FROM t, e GROUP BY {by}LEAST(FLOOR((v - lo) / w), {bins - 1})"""


def rounded_bins(df: DataFrame) -> DataFrame:
    return df.withColumn("bin_start", F.round("bin_start", 6)).drop("bin_end")


@query(histogram_sql("LENGTH(text)", "documents", 30))
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_bins(text.length_histogram(table(spark, sf, "documents"), "text"))


_MISSPELT = "CASE WHEN p_partkey % 3 = 0 THEN SUBSTR(p_name, 1, p_partkey % 5) || SUBSTR(p_name, p_partkey % 5 + 2) ELSE p_name END"


def misspelt_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Part names, every third with one character dropped."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 3 = 0 THEN SUBSTR(p_name, 1, CAST(p_partkey % 5 AS INT)) || SUBSTR(p_name, CAST(p_partkey % 5 + 2 AS INT)) ELSE p_name END AS p_name",
    )


# The longest common subsequence row by row: each character of one value turns the
# row of lengths against the prefixes of the other into the next row.
_FUZZY = f"""WITH v AS (SELECT p_name AS s, COUNT(*) AS n, LENGTH(p_name) AS k, LIST_TRANSFORM(STRING_SPLIT(p_name, ''), lambda c: [UNICODE(c)]) AS cs
  FROM (SELECT {_MISSPELT} AS p_name FROM part) t WHERE p_name <> '' GROUP BY p_name),
p AS (SELECT a.s AS value_1, b.s AS value_2, a.n AS count_1, b.n AS count_2, a.k + b.k AS total, LIST_REDUCE(a.cs,
  lambda row, x: LIST_REDUCE(LIST_TRANSFORM(RANGE(1, b.k + 1), lambda j: [CAST(j AS INTEGER)]),
    lambda acc, j: LIST_APPEND(acc, GREATEST(acc[-1], row[j[1] + 1], CASE WHEN b.cs[j[1]][1] = x[1] THEN row[j[1]] + 1 ELSE 0 END)), [0]),
  LIST_TRANSFORM(RANGE(0, b.k + 1), lambda j: 0))[-1] AS lcs FROM v a JOIN v b ON a.s < b.s)
SELECT value_1, value_2, ROUND(200.0 * lcs / total, 6) AS similarity, count_1, count_2 FROM p WHERE 200 * lcs >= 80 * total"""


@query(_FUZZY)
def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = fuzzy.fuzzy_pairs(misspelt_parts(spark, sf), "p_name", 80)
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all documents that are nearly the same."""
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return fuzzy.fuzzy_pairs(lines, "line", 95)


@query("SELECT p_partkey, CASE p_name WHEN 'red widget' THEN 'widget' WHEN 'blue widget' THEN 'widget' ELSE p_name END AS p_name FROM part")
def merge_values(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return text.merge_values(parts, "p_name", {"red widget": "widget", "blue widget": "widget"})


@query(
    f"""WITH t AS (SELECT p_partkey, {_MISSPELT} AS p_name FROM part),
    m AS (SELECT p_name AS d, MIN(REPLACE(p_name, ' ', '-')) AS k FROM t WHERE p_name LIKE '% %' GROUP BY p_name)
    SELECT p_partkey, COALESCE(k, p_name) AS p_name FROM t LEFT JOIN m ON p_name = d"""
)
def merge_by_table(spark: SparkSession, sf: str) -> DataFrame:
    parts = misspelt_parts(spark, sf)
    mapping = parts.filter("p_name LIKE '% %'").selectExpr("p_name AS drop", "replace(p_name, ' ', '-') AS keep").distinct()
    return text.merge_values(parts, "p_name", mapping)


# -- charts -----------------------------------------------------------------
@query(
    """SELECT o_orderkey AS x, o_orderstatus AS "group", 'o_totalprice' AS "Series", o_totalprice AS "Value" FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders"""
)
def series(spark: SparkSession, sf: str) -> DataFrame:
    long = chart.series(table(spark, sf, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"], "o_orderstatus")
    return long.withColumnsRenamed({"o_orderkey": "x", "o_orderstatus": "group"})


@query("SELECT event_id, ts, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS \"index\" FROM events")
def with_position(spark: SparkSession, sf: str) -> DataFrame:
    return chart.with_position(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"])


_LINE_SQL = """ROUND(REGR_SLOPE({y}, {x}), 6) AS slope, ROUND(REGR_INTERCEPT({y}, {x}), 4) AS intercept,
ROUND(REGR_R2({y}, {x}), 8) AS r2, COUNT(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS "count\""""


def rounded_line(df: DataFrame) -> DataFrame:
    return df.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "r2": F.round("r2", 8)})


@query(f"SELECT l_linestatus, {_LINE_SQL.format(x='l_quantity', y='l_extendedprice')} FROM {LINES.sql} t GROUP BY l_linestatus")
def ols(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_line(chart.ols(LINES.df(spark, sf), "l_quantity", "l_extendedprice", "l_linestatus"))


@query(histogram_sql("l_extendedprice", "lineitem", 25))
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_bins(chart.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 25))


@query(histogram_sql("value", "events", 40, "event_type"))
def histogram_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_bins(chart.histogram(table(spark, sf, "events"), "value", 40, "event_type"))


@query(
    """WITH q AS (SELECT event_type, QUANTILE_CONT(value, CAST(0.25 AS DOUBLE)) AS q1, QUANTILE_CONT(value, CAST(0.5 AS DOUBLE)) AS median,
    QUANTILE_CONT(value, CAST(0.75 AS DOUBLE)) AS q3 FROM events GROUP BY event_type)
    SELECT e.event_type, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
    MIN(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_whisker,
    MAX(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_whisker,
    COUNT(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, COUNT(*) AS "count"
    FROM events e JOIN q ON e.event_type = q.event_type GROUP BY e.event_type, q1, median, q3"""
)
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = chart.box_stats(table(spark, sf, "events"), "value", "event_type")
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    f"""SELECT event_type, COUNT(*) AS "count", ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 9) AS share
    FROM {EVENTS.sql} t WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def value_share(spark: SparkSession, sf: str) -> DataFrame:
    return chart.value_share(EVENTS.df(spark, sf), "event_type").withColumn("share", F.round("share", 9))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return ops.preview(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], ["o_orderkey"])
