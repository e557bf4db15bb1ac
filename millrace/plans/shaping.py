"""Pivots, features, and reading and writing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, profile
from ..operators.pivot import pivot, pivot_series
from ..session import fresh_path
from ..sources import csv, sinks
from .quality import rounded, scored_orders
from .registry import CUSTOMERS, LINES, query, table

_KEYED = f"(SELECT * FROM {LINES.sql} t WHERE l_returnflag IS NOT NULL)"
_COMPLETE = f"(SELECT * FROM {LINES.sql} t WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL)"


def _round_all(df: DataFrame, digits: int, *keys: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in keys else F.round(F.col(f"`{c}`"), digits).alias(c) for c in df.columns])


# -- pivot ------------------------------------------------------------------
@query(
    f"""SELECT l_returnflag, ROUND(COALESCE(SUM(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS "l_quantity_F",
    ROUND(COALESCE(SUM(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS "l_quantity_O" FROM {_KEYED} t GROUP BY l_returnflag"""
)
def pivot_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(pivot(LINES.df(spark, sf), "l_returnflag", "l_quantity", "l_linestatus"), 2, "l_returnflag")


@query(
    f"""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 4) AS l_quantity_sum, ROUND(AVG(l_quantity), 4) AS l_quantity_mean,
    CAST(COUNT(l_quantity) AS DOUBLE) AS l_quantity_count, MIN(l_quantity) AS l_quantity_min, MAX(l_quantity) AS l_quantity_max,
    ROUND(STDDEV_SAMP(l_quantity), 4) AS l_quantity_std, ROUND(VAR_SAMP(l_quantity), 4) AS l_quantity_var,
    ROUND(QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)), 4) AS l_quantity_median FROM {_KEYED} t GROUP BY l_returnflag, l_linestatus"""
)
def pivot_multi(spark: SparkSession, sf: str) -> DataFrame:
    found = pivot(
        LINES.df(spark, sf), ["l_returnflag", "l_linestatus"], "l_quantity", aggs=["sum", "mean", "count", "min", "max", "std", "var", "median"]
    )
    return _round_all(found, 4, "l_returnflag", "l_linestatus")


@query(
    f"""WITH b AS (SELECT l_returnflag, AVG(l_quantity) FILTER (WHERE l_linestatus = 'F') f, AVG(l_quantity) FILTER (WHERE l_linestatus = 'O') o,
    AVG(l_quantity) t FROM {_COMPLETE} c GROUP BY l_returnflag UNION ALL SELECT 'Total', AVG(l_quantity) FILTER (WHERE l_linestatus = 'F'),
    AVG(l_quantity) FILTER (WHERE l_linestatus = 'O'), AVG(l_quantity) FROM {_COMPLETE} c)
    SELECT l_returnflag, ROUND(f, 6) AS "l_quantity_F", ROUND(o, 6) AS "l_quantity_O", ROUND(t, 6) AS "l_quantity_Total" FROM b"""
)
def pivot_margins(spark: SparkSession, sf: str) -> DataFrame:
    found = pivot(LINES.df(spark, sf), "l_returnflag", "l_quantity", "l_linestatus", "mean", margins=True)
    return _round_all(found, 6, "l_returnflag")


@query(
    f"""WITH b AS (SELECT l_returnflag, QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)) FILTER (WHERE l_linestatus = 'F') f,
    QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)) FILTER (WHERE l_linestatus = 'O') o, QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)) t FROM {_COMPLETE} c GROUP BY l_returnflag
    UNION ALL SELECT 'Total', QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)) FILTER (WHERE l_linestatus = 'F'),
    QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)) FILTER (WHERE l_linestatus = 'O'), QUANTILE_CONT(l_quantity, CAST(0.5 AS DOUBLE)) FROM {_COMPLETE} c)
    SELECT l_returnflag, ROUND(f, 6) AS "l_quantity_F", ROUND(o, 6) AS "l_quantity_O", ROUND(t, 6) AS "l_quantity_Total" FROM b"""
)
def pivot_median_margins(spark: SparkSession, sf: str) -> DataFrame:
    found = pivot(LINES.df(spark, sf), "l_returnflag", "l_quantity", "l_linestatus", "median", margins=True)
    return _round_all(found, 6, "l_returnflag")


_TITLED = "(SELECT CASE WHEN o_orderstatus = 'O' THEN 'Total' ELSE o_orderstatus END AS status, o_orderpriority, o_totalprice FROM orders)"


@query(
    f"""SELECT status, ROUND(SUM(o_totalprice), 2) AS o_totalprice FROM {_TITLED} t GROUP BY status
    UNION ALL SELECT 'Total', ROUND(SUM(o_totalprice), 2) FROM {_TITLED} t"""
)
def pivot_total_key(spark: SparkSession, sf: str) -> DataFrame:
    """A key that is itself named Total keeps a row of its own beside the total."""
    orders = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "Total").otherwise(F.col("o_orderstatus")))
    return _round_all(pivot(orders, "status", "o_totalprice", margins=True), 2, "status")


@query(
    """SELECT l_returnflag, """
    + ", ".join(f"""ROUND(COALESCE(SUM(l_quantity) FILTER (WHERE l_linestatus = '{s}' AND l_linenumber = {n}), 0), 2) AS "l_quantity_{s}_{n}\"""" for s in "FO" for n in range(1, 8))
    + """, ROUND(SUM(l_quantity), 2) AS "l_quantity_Total" FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'Total', """
    + ", ".join(f"""ROUND(COALESCE(SUM(l_quantity) FILTER (WHERE l_linestatus = '{s}' AND l_linenumber = {n}), 0), 2)""" for s in "FO" for n in range(1, 8))
    + """, ROUND(SUM(l_quantity), 2) FROM lineitem"""
)
def pivot_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(pivot(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", ["l_linestatus", "l_linenumber"], margins=True), 2, "l_returnflag")


_SUMS = f"""(SELECT l_returnflag, SUM(l_quantity) FILTER (WHERE l_linestatus = 'F') f, SUM(l_quantity) FILTER (WHERE l_linestatus = 'O') o
FROM {_KEYED} t GROUP BY l_returnflag)"""


def _normalized(spark: SparkSession, sf: str, how: str) -> DataFrame:
    return _round_all(pivot(LINES.df(spark, sf), "l_returnflag", "l_quantity", "l_linestatus", normalize=how), 6, "l_returnflag")


@query(
    f"""SELECT l_returnflag, ROUND(100 * f / SUM(f + o) OVER (), 6) AS "l_quantity_F", ROUND(100 * o / SUM(f + o) OVER (), 6) AS "l_quantity_O" FROM {_SUMS} s"""
)
def pivot_share_of_all(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, "all")


@query(f"""SELECT l_returnflag, ROUND(100 * f / (f + o), 6) AS "l_quantity_F", ROUND(100 * o / (f + o), 6) AS "l_quantity_O" FROM {_SUMS} s""")
def pivot_share_of_row(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, "index")


@query(
    f"""SELECT l_returnflag, ROUND(100 * f / SUM(f) OVER (), 6) AS "l_quantity_F", ROUND(100 * o / SUM(o) OVER (), 6) AS "l_quantity_O" FROM {_SUMS} s"""
)
def pivot_share_of_column(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf, "columns")


@query(
    """SELECT o_custkey, COALESCE(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS "o_totalprice_F",
    COALESCE(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS "o_totalprice_O", COALESCE(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS "o_totalprice_P"
    FROM (SELECT o_custkey, o_orderstatus, CAST(ROUND(o_totalprice, 0) AS DOUBLE) AS o_totalprice FROM orders) t GROUP BY o_custkey"""
)
def pivot_sorted(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("o_totalprice", F.round("o_totalprice", 0))
    return pivot(orders, "o_custkey", "o_totalprice", "o_orderstatus", sort="desc")


@query(
    """SELECT 'l_quantity' AS value, ROUND(AVG(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS "cell_F", ROUND(AVG(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS "cell_O" FROM lineitem
    UNION ALL SELECT 'l_tax', ROUND(AVG(l_tax) FILTER (WHERE l_linestatus = 'F'), 6), ROUND(AVG(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) FROM lineitem"""
)
def pivot_columns_only(spark: SparkSession, sf: str) -> DataFrame:
    return _round_all(pivot(table(spark, sf, "lineitem"), [], ["l_quantity", "l_tax"], "l_linestatus", "mean"), 6, "value")


@query(
    f"""SELECT l_returnflag AS x, 'l_quantity_F' AS "Series", ROUND(f, 2) AS "Value" FROM {_SUMS} s UNION ALL SELECT l_returnflag, 'l_quantity_O', ROUND(o, 2) FROM {_SUMS} s"""
)
def pivot_chart(spark: SparkSession, sf: str) -> DataFrame:
    wide = pivot(LINES.df(spark, sf), "l_returnflag", "l_quantity", "l_linestatus")
    return rounded(pivot_series(wide, "l_returnflag"), 2, "Value")


# -- features ---------------------------------------------------------------
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "SELECT c_custkey, "
    + ", ".join(f"COALESCE(c_mktsegment = '{s}', FALSE) AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + f" FROM {CUSTOMERS.sql} t"
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return features.one_hot(CUSTOMERS.df(spark, sf).select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    f"""WITH t AS {CUSTOMERS.sql}, k AS (SELECT COALESCE(c_name, 'nan') v, ROW_NUMBER() OVER (ORDER BY COALESCE(c_name, 'nan')) - 1 AS code FROM t GROUP BY COALESCE(c_name, 'nan'))
    SELECT c_custkey, c_name, CAST(code AS BIGINT) AS c_name_encoded FROM t JOIN k ON COALESCE(c_name, 'nan') = v"""
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return features.label_encode(CUSTOMERS.df(spark, sf).select("c_custkey", "c_name"), "c_name")


def _scaled_sql(center: str, spread: str) -> str:
    return f"""SELECT c_custkey, ROUND((c_acctbal - (SELECT {center} FROM {CUSTOMERS.sql} s)) / (SELECT {spread} FROM {CUSTOMERS.sql} s), 6) AS c_acctbal FROM {CUSTOMERS.sql} t"""


def _scaled(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return rounded(features.scale(CUSTOMERS.df(spark, sf), "c_acctbal", method).select("c_custkey", "c_acctbal"), 6, "c_acctbal")


@query(_scaled_sql("AVG(c_acctbal)", "STDDEV_POP(c_acctbal)"))
def scale_standard(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf, "standard")


@query(_scaled_sql("MIN(c_acctbal)", "MAX(c_acctbal) - MIN(c_acctbal)"))
def scale_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf, "minmax")


@query(
    _scaled_sql(
        "QUANTILE_CONT(c_acctbal, CAST(0.5 AS DOUBLE))",
        "QUANTILE_CONT(c_acctbal, CAST(0.75 AS DOUBLE)) - QUANTILE_CONT(c_acctbal, CAST(0.25 AS DOUBLE))",
    )
)
def scale_robust(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf, "robust")


@query(
    """SELECT event_id, CAST(YEAR(ts) AS INTEGER) AS ts_year, CAST(MONTH(ts) AS INTEGER) AS ts_month, CAST(DAY(ts) AS INTEGER) AS ts_day,
    CAST(ISODOW(ts) - 1 AS INTEGER) AS ts_dayofweek, CAST(HOUR(ts) AS INTEGER) AS ts_hour, CAST(QUARTER(ts) AS INTEGER) AS ts_quarter,
    CAST(WEEK(ts) AS INTEGER) AS ts_weekofyear FROM events"""
)
def datetime_parts(spark: SparkSession, sf: str) -> DataFrame:
    return features.datetime_parts(table(spark, sf, "events").select("event_id", "ts"), "ts", features.DATE_PARTS).drop("ts")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS l_quantity_multiply_l_extendedprice,
    CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS l_discount_divide_l_tax, l_quantity + l_tax AS l_quantity_add_l_tax,
    l_quantity - l_tax AS l_quantity_subtract_l_tax FROM lineitem"""
)
def interaction(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    df = features.interaction(df, "l_quantity", "multiply", "l_extendedprice")
    df = features.interaction(df, "l_discount", "divide", "l_tax")
    df = features.interaction(df, "l_quantity", "add", "l_tax")
    df = features.interaction(df, "l_quantity", "subtract", "l_tax")
    return df.select("l_orderkey", "l_linenumber", *df.columns[-4:])


@query(
    """SELECT p_partkey, p_size, p_retailprice, CAST(p_size * p_size AS DOUBLE) AS "p_size^2", p_size * p_retailprice AS "p_size p_retailprice",
    p_retailprice * p_retailprice AS "p_retailprice^2", CAST(p_size * p_size * p_size AS DOUBLE) AS "p_size^3",
    p_size * p_size * p_retailprice AS "p_size^2 p_retailprice", p_size * p_retailprice * p_retailprice AS "p_size p_retailprice^2",
    p_retailprice * p_retailprice * p_retailprice AS "p_retailprice^3" FROM part"""
)
def polynomial(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return features.polynomial(parts, ["p_size", "p_retailprice"], 3)


# -- files ------------------------------------------------------------------
def _stored(spark: SparkSession, df: DataFrame, label: str) -> str:
    path = fresh_path(spark, label)
    sinks.write_csv(df, path)
    return path


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write customers as CSV and read them back with inferred types."""
    return csv.read_csv(spark, _stored(spark, table(spark, sf, "customer"), "customers"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal,
    s_suppkey % 2 = 0 AS even FROM supplier"""
)
def csv_missing_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts such as NA and null in a CSV file read as missing values."""
    suppliers = table(spark, sf, "supplier").selectExpr(
        "s_suppkey",
        "CASE WHEN s_suppkey % 4 = 0 THEN 'N/A' ELSE s_name END AS s_name",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(s_acctbal AS STRING) END AS s_acctbal",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END AS even",
    )
    return csv.read_csv(spark, _stored(spark, suppliers, "suppliers"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000")
def csv_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Only the first 10,000 rows of a large CSV file, in a stated order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return csv.read_csv(spark, _stored(spark, orders, "orders"), limit=10_000, order_by=["o_orderkey"])


@query("SELECT 9007199254740993000 + c_custkey AS id, CAST('99999999999999999999' || CAST(c_nationkey + 10 AS VARCHAR) AS DECIMAL(38, 0)) AS wide FROM customer")
def csv_long_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of 19 and 22 digits keep every digit through CSV."""
    ids = table(spark, sf, "customer").selectExpr("9007199254740993000 + c_custkey AS id", "'99999999999999999999' || CAST(c_nationkey + 10 AS STRING) AS wide")
    return csv.read_csv(spark, _stored(spark, ids, "ids"))


@query("SELECT n_nationkey, n_name || 'é' AS n_name FROM nation")
def csv_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """A Latin-1 file is recognised and decoded."""
    path = fresh_path(spark, "nations")
    nations = table(spark, sf, "nation").selectExpr("n_nationkey", "n_name || 'é' AS n_name")
    nations.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    if csv.detect_encoding(spark, path) != "latin-1":
        raise AssertionError("a Latin-1 file was taken for UTF-8")
    return csv.read_csv(spark, path)


@query("SELECT * FROM supplier")
def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "suppliers")
    sinks.write_parquet(table(spark, sf, "supplier"), path)
    return spark.read.parquet(path)


@query(
    """WITH b AS (SELECT *, CASE WHEN o_orderkey % 8 = 5 THEN NULL ELSE o_totalprice - 20000 END AS net FROM
    (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 0) r)
    SELECT COUNT(*) AS rows_before, COUNT(net) AS rows_after, COUNT(*) - COUNT(net) AS rows_removed, CAST(2 AS BIGINT) AS total_actions FROM b"""
)
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    """A cleaning report written as JSON and read back."""
    before = scored_orders(spark, sf)
    path = fresh_path(spark, "report")
    sinks.write_report(profile.cleaning_report(before, before.dropna(), ["load", "drop rows"]), path)
    return spark.read.json(path).select("rows_before", "rows_after", "rows_removed", "total_actions")


@query(f"""SELECT l_returnflag, ROUND(f, 2) AS "l_quantity_F", ROUND(o, 2) AS "l_quantity_O" FROM {_SUMS} s""")
def pivot_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "pivot")
    sinks.write_pivot(pivot(LINES.df(spark, sf), "l_returnflag", "l_quantity", "l_linestatus"), path)
    return _round_all(csv.read_csv(spark, path), 2, "l_returnflag")
