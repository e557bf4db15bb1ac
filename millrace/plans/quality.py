"""Types, missing values, duplicates, outliers and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, correlation, dedup, insights, missing, outliers, profile, types
from ..operators.columns import predicate
from ..functions.kinds import as_double
from ..functions.moments import sample_skew
from .registry import CUSTOMERS, EVENTS, LINES, REPEATED_SQL, TYPED, query, repeated_orders, table


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- fill -------------------------------------------------------------------
@query(
    f"""WITH b AS {LINES.sql}, g AS (SELECT l_returnflag rf, l_linestatus ls, AVG(l_quantity) m FROM b
    WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag, l_linestatus)
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(COALESCE(l_quantity, m)), 2) AS total, COUNT(*) - COUNT(COALESCE(l_quantity, m)) AS still_missing
    FROM b LEFT JOIN g ON l_returnflag = rf AND l_linestatus = ls GROUP BY l_returnflag, l_linestatus"""
)
def fill_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    filled = missing.fill_by_group(LINES.df(spark, sf), ["l_returnflag", "l_linestatus"], ["l_quantity"], "mean")
    return filled.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("total"),
        F.count_if(F.col("l_quantity").isNull()).alias("still_missing"),
    )


@query(
    f"""WITH b AS {EVENTS.sql}, g AS (SELECT user_id u, QUANTILE_CONT(value, CAST(0.5 AS DOUBLE)) m FROM b GROUP BY user_id)
    SELECT event_id, user_id, ROUND(COALESCE(value, m), 6) AS value FROM b LEFT JOIN g ON user_id = u"""
)
def fill_group_median(spark: SparkSession, sf: str) -> DataFrame:
    filled = missing.fill_by_group(EVENTS.df(spark, sf), "user_id", "value", ["mean", "median"], mode="best")
    return rounded(filled.select("event_id", "user_id", "value"), 6, "value")


@query(
    f"""WITH b AS {EVENTS.sql}, g AS (SELECT user_id u, STDDEV_SAMP(value) s, MAX(value) m FROM b GROUP BY user_id)
    SELECT event_id, user_id, ROUND(COALESCE(value, s, m), 6) AS value FROM b LEFT JOIN g ON user_id = u"""
)
def fill_group_any(spark: SparkSession, sf: str) -> DataFrame:
    filled = missing.fill_by_group(EVENTS.df(spark, sf), "user_id", "value", ["std", "max"], mode="all")
    return rounded(filled.select("event_id", "user_id", "value"), 6, "value")


def _fill_sql(statistic: str) -> str:
    return f"""SELECT event_id, ROUND(COALESCE(value, (SELECT {statistic} FROM {EVENTS.sql} s)), 6) AS value FROM {EVENTS.sql} t"""


def _filled(spark: SparkSession, sf: str, method: str) -> DataFrame:
    filled = missing.fill(EVENTS.df(spark, sf), "value", method)
    return rounded(filled.select("event_id", "value"), 6, "value")


@query(_fill_sql("AVG(value)"))
def fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "mean")


@query(_fill_sql("QUANTILE_CONT(value, CAST(0.5 AS DOUBLE))"))
def fill_median(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "median")


@query(_fill_sql("MIN(value)"))
def fill_min(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "min")


@query(_fill_sql("MAX(value)"))
def fill_max(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "max")


@query(_fill_sql("QUANTILE_CONT(value, CAST(0.1 AS DOUBLE))"))
def fill_p10(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "p10")


@query(_fill_sql("QUANTILE_CONT(value, CAST(0.9 AS DOUBLE))"))
def fill_p90(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "p90")


@query(
    f"""WITH m AS (SELECT c_mktsegment v FROM {CUSTOMERS.sql} t WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
    ORDER BY COUNT(*) DESC, c_mktsegment LIMIT 1) SELECT c_custkey, COALESCE(c_mktsegment, (SELECT v FROM m)) AS c_mktsegment FROM {CUSTOMERS.sql} t"""
)
def fill_mode(spark: SparkSession, sf: str) -> DataFrame:
    return missing.fill(CUSTOMERS.df(spark, sf), "c_mktsegment", "mode").select("c_custkey", "c_mktsegment")


@query(f"SELECT c_custkey, COALESCE(c_acctbal, CAST(-1 AS DOUBLE)) AS c_acctbal FROM {CUSTOMERS.sql} t")
def fill_constant(spark: SparkSession, sf: str) -> DataFrame:
    return missing.fill(CUSTOMERS.df(spark, sf), "c_acctbal", "constant", "-1").select("c_custkey", "c_acctbal")


@query(f"SELECT c_custkey, COALESCE(c_mktsegment, 'Unknown') AS c_mktsegment FROM {CUSTOMERS.sql} t")
def fill_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return missing.fill(CUSTOMERS.df(spark, sf), "c_mktsegment", "unknown").select("c_custkey", "c_mktsegment")


@query(
    f"""SELECT c_custkey, CASE WHEN c_acctbal IS NULL AND COALESCE(c_mktsegment = 'BUILDING', FALSE) THEN CAST(25 AS DOUBLE) ELSE c_acctbal END AS c_acctbal
    FROM {CUSTOMERS.sql} t"""
)
def fill_where(spark: SparkSession, sf: str) -> DataFrame:
    df = CUSTOMERS.df(spark, sf)
    filled = missing.fill_where(df, "c_acctbal", predicate(df, "c_mktsegment", "=", "BUILDING"), "25")
    return filled.select("c_custkey", "c_acctbal")


@query(f"SELECT event_id, LAST_VALUE(value IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM {EVENTS.sql} t")
def ffill(spark: SparkSession, sf: str) -> DataFrame:
    return missing.ffill(EVENTS.df(spark, sf), "value", ["event_id"]).select("event_id", "value")


@query(
    f"""SELECT event_id, FIRST_VALUE(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
    FROM {EVENTS.sql} t"""
)
def bfill(spark: SparkSession, sf: str) -> DataFrame:
    return missing.bfill(EVENTS.df(spark, sf), "value", ["event_id"]).select("event_id", "value")


@query(f"SELECT event_id, LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value FROM {EVENTS.sql} t")
def ffill_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return missing.ffill(EVENTS.df(spark, sf), "value", ["ts", "event_id"], ["event_type"]).select("event_id", "value")


# -- what is missing --------------------------------------------------------
def _per_column(columns: list[str], select: str, source: str) -> str:
    return f"WITH t AS {source} " + " UNION ALL ".join(f"SELECT * FROM (SELECT {select.format(c=c)} FROM t)" for c in columns)


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
_LINE_NUMBERS = _LINE_COLUMNS[:8]


@query(
    "SELECT * FROM ("
    + _per_column(
        _LINE_COLUMNS,
        "'{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS missing_pct",
        LINES.sql,
    )
    + ") WHERE missing_count > 0"
)
def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(missing.missing_summary(LINES.df(spark, sf)), 6, "missing_pct")


def _skew_rule(skew: str, names: tuple[str, str, str, str]) -> str:
    mean, median, low, high = names
    return f"CASE WHEN ABS({skew}) < 0.5 THEN '{mean}' WHEN ABS({skew}) < 1.5 THEN '{median}' WHEN {skew} > 0 THEN '{low}' ELSE '{high}' END"


@query(
    f"""SELECT 'value' AS "column", ROUND(SKEWNESS(value), 6) AS skew,
    {_skew_rule('SKEWNESS(value)', ('mean', 'median', 'p10', 'p90'))} AS method FROM {EVENTS.sql} t"""
)
def recommend_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(missing.recommend_fill(EVENTS.df(spark, sf), "value"), 6, "skew")


_SUGGEST = f"""WITH t AS {{source}}, a AS (
SELECT 'c_acctbal' AS "column", 100.0 * (COUNT(*) - COUNT(c_acctbal)) / COUNT(*) AS p, 'double' AS type,
  {_skew_rule('SKEWNESS(c_acctbal)', ('Fill with Mean', 'Fill with Median', 'Fill with 10th Percentile', 'Fill with 90th Percentile'))} AS action FROM t
UNION ALL SELECT 'c_mktsegment', 100.0 * (COUNT(*) - COUNT(c_mktsegment)) / COUNT(*), 'string',
  CASE WHEN (SELECT MAX(n) FROM (SELECT COUNT(*) n FROM t WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)) > 0.5 * COUNT(*)
  THEN 'Fill with Mode' ELSE 'Fill with "Unknown"' END FROM t
UNION ALL SELECT 'c_name', 100.0 * (COUNT(*) - COUNT(c_name)) / COUNT(*), 'string', 'Fill with "Unknown"' FROM t)
SELECT "column", ROUND(p, 2) AS missing_pct, type, CASE WHEN p > 80 THEN 'Drop Column' ELSE action END AS action FROM a WHERE p > 0"""


@query(_SUGGEST.format(source=CUSTOMERS.sql))
def suggest_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    return missing.suggest_cleaning(CUSTOMERS.df(spark, sf)).drop("reason")


@query(
    f"""SELECT c_custkey, c_nationkey, ROUND(COALESCE(c_acctbal, (SELECT AVG(c_acctbal) FROM {CUSTOMERS.sql} s)), 6) AS c_acctbal,
    COALESCE(c_mktsegment, 'Unknown') AS c_mktsegment FROM {CUSTOMERS.sql} t"""
)
def apply_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    df = CUSTOMERS.df(spark, sf)
    return rounded(missing.apply_cleaning(df, missing.suggest_cleaning(df)), 6, "c_acctbal")


@query(
    f"""SELECT COUNT(*) - COUNT(l_quantity) AS filled, COUNT(*) - COUNT(l_quantity) AS filled_in_targets,
    2 * COUNT(*) - COUNT(l_returnflag) - COUNT(l_shipdate) AS remaining, 'l_quantity' AS columns_changed FROM {LINES.sql} t"""
)
def fill_report(spark: SparkSession, sf: str) -> DataFrame:
    before = LINES.df(spark, sf)
    found = missing.fill_report(before, missing.fill(before, "l_quantity", "mean"), ["l_quantity"])
    return found.withColumn("columns_changed", F.array_join("columns_changed", ","))


# -- duplicates -------------------------------------------------------------
@query(
    f"""SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {REPEATED_SQL} d)) AS duplicate_rows,
    ROUND(100.0 * (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {REPEATED_SQL} d))) / COUNT(*), 6) AS duplicate_pct FROM {REPEATED_SQL} t"""
)
def duplicate_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dedup.duplicate_stats(repeated_orders(spark, sf)), 6, "duplicate_pct")


@query(
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM
    (SELECT *, COUNT(*) OVER (PARTITION BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) AS n FROM {REPEATED_SQL} t) WHERE n > 1"""
)
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_rows(repeated_orders(spark, sf))


@query(f"SELECT DISTINCT * FROM {REPEATED_SQL} t")
def drop_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.drop_duplicates(repeated_orders(spark, sf))


# -- types ------------------------------------------------------------------
@query(f"SELECT o_orderkey, CAST(ROUND_EVEN(TRY_CAST(fraction AS DOUBLE), 0) AS BIGINT) AS fraction FROM {TYPED.sql} t")
def convert_long(spark: SparkSession, sf: str) -> DataFrame:
    return types.convert(TYPED.df(spark, sf), "fraction", "long").select("o_orderkey", "fraction")


@query(f"SELECT o_orderkey, TRY_CAST(fraction AS DOUBLE) AS fraction FROM {TYPED.sql} t")
def convert_double(spark: SparkSession, sf: str) -> DataFrame:
    return types.convert(TYPED.df(spark, sf), "fraction", "double").select("o_orderkey", "fraction")


@query(f"SELECT o_orderkey, CASE WHEN flag IN ('yes', '1') THEN TRUE WHEN flag = 'N' THEN FALSE END AS flag FROM {TYPED.sql} t")
def convert_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return types.convert(TYPED.df(spark, sf), "flag", "boolean").select("o_orderkey", "flag")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def convert_string(spark: SparkSession, sf: str) -> DataFrame:
    return types.convert(table(spark, sf, "orders"), "o_custkey", "string").select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, TRY_STRPTIME(day, '%d/%m/%Y') AS day FROM {TYPED.sql} t")
def convert_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return types.convert(TYPED.df(spark, sf), "day", "timestamp", ["d/M/yyyy"]).select("o_orderkey", "day")


@query(f"SELECT o_orderkey, TRY_CAST(mixed AS INTEGER) AS mixed FROM {TYPED.sql} t")
def convert_named(spark: SparkSession, sf: str) -> DataFrame:
    return types.convert(TYPED.df(spark, sf), "mixed", "int").select("o_orderkey", "mixed")


@query(f"SELECT COUNT(TRY_CAST(mixed AS INTEGER)) AS converted, COUNT(mixed) - COUNT(TRY_CAST(mixed AS INTEGER)) AS lost FROM {TYPED.sql} t")
def conversion_loss(spark: SparkSession, sf: str) -> DataFrame:
    return types.conversion_loss(TYPED.df(spark, sf), "mixed", "int")


_TYPE_CHECK = """WITH t AS {source}, s AS (
SELECT 'whole' AS "column", 'integer' AS suggested_type, 'High' AS confidence, 100.0 * COUNT(TRY_CAST(whole AS DOUBLE)) / COUNT(whole) AS match_pct FROM t
UNION ALL SELECT 'fraction', 'float', CASE WHEN COUNT(TRY_CAST(fraction AS DOUBLE)) > 0.95 * COUNT(fraction) THEN 'High' ELSE 'Medium' END,
  100.0 * COUNT(TRY_CAST(fraction AS DOUBLE)) / COUNT(fraction) FROM t
UNION ALL SELECT 'flag', 'category', 'High', 100.0 * COUNT(DISTINCT flag) / COUNT(*) FROM t
UNION ALL SELECT 'day', 'datetime', 'High', 100.0 * COUNT(TRY_STRPTIME(day, '%d/%m/%Y')) / COUNT(day) FROM t
UNION ALL SELECT 'priority', 'category', 'High', 100.0 * COUNT(DISTINCT priority) / COUNT(*) FROM t
UNION ALL SELECT 'mixed', 'string', 'Medium', NULL FROM t HAVING COUNT(*) > 0)
SELECT "column", suggested_type, confidence, ROUND(match_pct, 6) AS match_pct FROM s"""


@query(_TYPE_CHECK.format(source=TYPED.sql))
def suggest_types(spark: SparkSession, sf: str) -> DataFrame:
    found = types.suggest_types(TYPED.df(spark, sf))
    return rounded(found.select("column", "suggested_type", "confidence", "match_pct"), 6, "match_pct")


@query(
    f"""SELECT o_orderkey, CAST(whole AS BIGINT) AS whole, TRY_CAST(fraction AS DOUBLE) AS fraction, flag,
    TRY_STRPTIME(day, '%d/%m/%Y') AS day, priority, mixed FROM {TYPED.sql} t"""
)
def apply_types(spark: SparkSession, sf: str) -> DataFrame:
    df = TYPED.df(spark, sf)
    return types.apply_types(df, types.suggest_types(df))


@query("SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity, l_tax FROM lineitem")
def whole_floats_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return types.whole_floats_to_long(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax"))


_NARROW = """CASE WHEN MIN({c}) >= 0 THEN CASE WHEN MAX({c}) < 256 THEN 'uint8' WHEN MAX({c}) < 65536 THEN 'uint16' WHEN MAX({c}) < 4294967296 THEN 'uint32' END
ELSE CASE WHEN MIN({c}) > -128 AND MAX({c}) < 128 THEN 'int8' WHEN MIN({c}) > -32768 AND MAX({c}) < 32768 THEN 'int16'
WHEN MIN({c}) > -2147483648 AND MAX({c}) < 2147483648 THEN 'int32' END END"""
_FLOAT = "CASE WHEN BOOL_AND({c} = CAST(CAST({c} AS FLOAT) AS DOUBLE)) THEN 'float32' END"
_CATEGORY = "CASE WHEN COUNT(DISTINCT {c}) < 0.5 * COUNT(*) THEN 'category' END"
_NARROW_RULES = {
    **{c: _NARROW for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "shifted")},
    **{c: _FLOAT for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    **{c: _CATEGORY for c in ("l_returnflag", "l_linestatus")},
}


@query(
    "WITH t AS (SELECT *, l_linenumber - 3 AS shifted FROM lineitem), r AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rule.format(c=c)} AS narrow FROM t" for c, rule in _NARROW_RULES.items())
    + ") SELECT * FROM r WHERE narrow IS NOT NULL"
)
def narrow_types(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("shifted", F.col("l_linenumber") - 3)
    _, changes = types.narrow_types(lines)
    return changes.select("column", "narrow")


# -- outliers ---------------------------------------------------------------
_IQR = """(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
(SELECT QUANTILE_CONT(value, CAST(0.25 AS DOUBLE)) AS q1, QUANTILE_CONT(value, CAST(0.75 AS DOUBLE)) AS q3 FROM {source} s))"""
_EVENT_IQR = _IQR.format(source=EVENTS.sql)


@query(f"SELECT ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(lo, 6) AS lower, ROUND(hi, 6) AS upper FROM {_EVENT_IQR} b")
def iqr_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.iqr_bounds(EVENTS.df(spark, sf), "value"), 6, "q1", "q3", "lower", "upper")


@query(f"SELECT event_id, value FROM {EVENTS.sql} t, {_EVENT_IQR} b WHERE value < lo OR value > hi")
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outliers(EVENTS.df(spark, sf), "value", "iqr").select("event_id", "value")


@query(
    f"""SELECT event_id, value FROM {EVENTS.sql} t, (SELECT AVG(value) m, STDDEV_SAMP(value) d FROM {EVENTS.sql} s) b
    WHERE ABS(value - m) / d > 2.5"""
)
def zscore_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outliers(EVENTS.df(spark, sf), "value", "zscore", threshold=2.5).select("event_id", "value")


@query(f"SELECT event_id, value FROM {EVENTS.sql} t WHERE value < 2 OR value > 90")
def range_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outliers(EVENTS.df(spark, sf), "value", "range", lo=2, hi=90).select("event_id", "value")


@query(
    f"""SELECT COUNT(*) FILTER (WHERE value < lo OR value > hi) AS outliers,
    ROUND(100.0 * COUNT(*) FILTER (WHERE value < lo OR value > hi) / COUNT(*), 6) AS outlier_pct FROM {EVENTS.sql} t, {_EVENT_IQR} b"""
)
def outlier_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.outlier_stats(EVENTS.df(spark, sf), "value"), 6, "outlier_pct")


@query(f"SELECT event_id, value FROM {EVENTS.sql} t, {_EVENT_IQR} b WHERE NOT COALESCE(value < lo OR value > hi, FALSE)")
def remove_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.treat(EVENTS.df(spark, sf), "value", "remove").select("event_id", "value")


@query(f"SELECT event_id, value FROM {EVENTS.sql} t, {_EVENT_IQR} b WHERE NOT COALESCE(value < lo OR value > hi, FALSE)")
def treat_flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Rows flagged before are removed, with the flag."""
    flagged = outliers.treat(EVENTS.df(spark, sf), "value", "flag").select("event_id", "value", "is_outlier")
    return outliers.treat_flagged(flagged, "remove")


@query(f"SELECT event_id, ROUND(CASE WHEN value IS NOT NULL THEN LEAST(GREATEST(value, lo), hi) END, 6) AS value FROM {EVENTS.sql} t, {_EVENT_IQR} b")
def cap_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers.treat(EVENTS.df(spark, sf), "value", "cap").select("event_id", "value"), 6, "value")


@query(
    f"""SELECT event_id, ROUND(CASE WHEN value IS NOT NULL THEN LEAST(GREATEST(value, m - 2 * d), m + 2 * d) END, 6) AS value
    FROM {EVENTS.sql} t, (SELECT AVG(value) m, STDDEV_SAMP(value) d FROM {EVENTS.sql} s) b"""
)
def cap_zscore(spark: SparkSession, sf: str) -> DataFrame:
    capped = outliers.treat(EVENTS.df(spark, sf), "value", "cap", "zscore", threshold=2.0)
    return rounded(capped.select("event_id", "value"), 6, "value")


@query(f"SELECT event_id, value, COALESCE(value < lo OR value > hi, FALSE) AS is_outlier FROM {EVENTS.sql} t, {_EVENT_IQR} b")
def flag_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.treat(EVENTS.df(spark, sf), "value", "flag").select("event_id", "value", "is_outlier")


@query(
    f"""SELECT COUNT(value) AS "count", ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std, MIN(value) AS min,
    ROUND(QUANTILE_CONT(value, CAST(0.25 AS DOUBLE)), 6) AS q25, ROUND(QUANTILE_CONT(value, CAST(0.5 AS DOUBLE)), 6) AS q50,
    ROUND(QUANTILE_CONT(value, CAST(0.75 AS DOUBLE)), 6) AS q75, MAX(value) AS max FROM {EVENTS.sql} t, {_EVENT_IQR} b WHERE value < lo OR value > hi"""
)
def describe_flagged(spark: SparkSession, sf: str) -> DataFrame:
    found = outliers.describe_flagged(outliers.treat(EVENTS.df(spark, sf), "value", "flag"), "value")
    return rounded(found, 6, "mean", "std", "q25", "q50", "q75")


@query("SELECT 'warning' AS level, 'contamination' AS code, '0.40 of all values would be anomalies' AS message FROM (SELECT COUNT(value) AS n FROM events) WHERE n >= 50")
def validate_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.validate_anomaly(table(spark, sf, "events"), "value", 0.4)


@query()
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.isolation_forest(EVENTS.df(spark, sf), "value", 0.1, key="event_id").select("event_id", "value", "is_outlier")


_LOF = """WITH v AS (SELECT value, ROW_NUMBER() OVER (ORDER BY value) AS p FROM {source} t WHERE value IS NOT NULL),
c AS (SELECT a.p, b.p AS o, ABS(a.value - b.value) AS d, ROW_NUMBER() OVER (PARTITION BY a.p ORDER BY ABS(a.value - b.value), b.value, b.p) AS r
  FROM v a JOIN v b ON b.p BETWEEN a.p - {k} AND a.p + {k} AND b.p <> a.p),
n AS (SELECT p, o, d FROM c WHERE r <= {k}),
kd AS (SELECT p, MAX(d) AS kd FROM n GROUP BY p),
den AS (SELECT n.p, 1.0 / (AVG(GREATEST(d, kd.kd)) + CAST(1e-10 AS DOUBLE)) AS den FROM n JOIN kd ON n.o = kd.p GROUP BY n.p),
f AS (SELECT n.p, AVG(b.den) / MIN(a.den) AS lof FROM n JOIN den a ON n.p = a.p JOIN den b ON n.o = b.p GROUP BY n.p)
SELECT value, ROUND(LN(lof), 5) AS log_factor FROM v JOIN f ON v.p = f.p"""


@query(_LOF.format(source="events", k=20))
def local_outlier_factors(spark: SparkSession, sf: str) -> DataFrame:
    scored = anomaly.local_outlier_factors(table(spark, sf, "events"), "value", k=20)
    return scored.select("value", F.round(F.log("lof"), 5).alias("log_factor"))


# The rows whose factor lies above the quantile of all factors that leaves a tenth.
_LOF_FLAGS = _LOF.format(source=EVENTS.sql, k=20).replace(
    "SELECT value, ROUND(LN(lof), 5) AS log_factor FROM v JOIN f ON v.p = f.p",
    """, s AS (SELECT value, lof FROM v JOIN f ON v.p = f.p), q AS (SELECT QUANTILE_CONT(lof, 0.9) AS cut FROM s),
    top AS (SELECT value, MAX(lof) AS lof FROM s GROUP BY value)
    SELECT e.event_id, e.value, COALESCE(top.lof > q.cut, FALSE) AS is_outlier FROM {source} e LEFT JOIN top ON e.value = top.value, q""".replace("{source}", EVENTS.sql),
)


@query(_LOF_FLAGS)
def local_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.local_outlier_factor(EVENTS.df(spark, sf), "value", 0.1).select("event_id", "value", "is_outlier")


# -- profile ----------------------------------------------------------------
@query(
    f"""SELECT COUNT(*) AS "rows", 11 AS columns, 3 * COUNT(*) - COUNT(l_quantity) - COUNT(l_returnflag) - COUNT(l_shipdate) AS missing_cells,
    ROUND(100.0 * (3 * COUNT(*) - COUNT(l_quantity) - COUNT(l_returnflag) - COUNT(l_shipdate)) / (COUNT(*) * 11), 6) AS missing_pct,
    8 AS numeric_columns, 0 AS boolean_columns, 2 AS text_columns, 1 AS datetime_columns, 0 AS other_columns FROM {LINES.sql} t"""
)
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.overview(LINES.df(spark, sf)), 6, "missing_pct")


_STAT = """'{c}' AS "column", COUNT({c}) AS "count", COUNT(*) - COUNT({c}) AS missing, ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS missing_pct,
COUNT(DISTINCT {c}) AS "unique", """
_STAT_NUMBER = _STAT + """ROUND(AVG({c}), 4) AS mean, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), CAST(0.5 AS DOUBLE)), 4) AS median,
ROUND(STDDEV_SAMP({c}), 4) AS std, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max"""
_STAT_OTHER = _STAT + "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
_STATS_SQL = f"WITH t AS {LINES.sql} " + " UNION ALL ".join(
    f"SELECT {(_STAT_NUMBER if c in _LINE_NUMBERS else _STAT_OTHER).format(c=c)} FROM t" for c in _LINE_COLUMNS
)


@query(_STATS_SQL)
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(profile.column_stats(LINES.df(spark, sf)).drop("type"), 6, "missing_pct"), 4, "mean", "median", "std")


@query(
    f"""SELECT event_type, COUNT(*) AS "count" FROM {EVENTS.sql} t WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY COUNT(*) DESC, event_type LIMIT 3"""
)
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(EVENTS.df(spark, sf), "event_type", 3)


@query(f"SELECT event_type, COUNT(*) AS \"count\" FROM {EVENTS.sql} t GROUP BY event_type ORDER BY COUNT(*) DESC LIMIT 20")
def value_counts_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(EVENTS.df(spark, sf), "event_type", 20, dropna=False)


_TOP = """SELECT '{c}' AS "column", RANK AS "rank", value, n AS "count" FROM
(SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR)) AS rank
FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""


@query(" UNION ALL ".join(_TOP.format(c=c) for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 5)


@query(_STATS_SQL)
def whole_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile(LINES.df(spark, sf), k=1).drop("type", "top")
    return rounded(rounded(found, 6, "missing_pct"), 4, "mean", "median", "std")


_SCORE = f"""WITH t AS (SELECT *, CASE WHEN o_orderkey % 8 = 5 THEN NULL ELSE o_totalprice - 20000 END AS net FROM {REPEATED_SQL} r),
s AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(net) AS miss, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t)) AS dup,
  CASE WHEN MIN(o_orderkey) < 0 THEN 1 ELSE 0 END + CASE WHEN MIN(o_custkey) < 0 THEN 1 ELSE 0 END + CASE WHEN MIN(o_totalprice) < 0 THEN 1 ELSE 0 END
  + CASE WHEN MIN(net) < 0 THEN 1 ELSE 0 END AS neg FROM t),
p AS (SELECT (1 - CAST(miss AS DOUBLE) / (n * 7)) * 40 AS c, 20 - CAST(dup AS DOUBLE) / n * 20 AS u, CAST(10 - neg AS DOUBLE) AS v, * FROM s)
SELECT ROUND(c + 30 + u + v, 2) AS total_score, ROUND(c, 2) AS completeness, CAST(30 AS DOUBLE) AS consistency, ROUND(u, 2) AS uniqueness, ROUND(v, 2) AS validity,
ROUND(100.0 * miss / (n * 7), 2) AS missing_percentage, dup AS duplicate_rows, ROUND(100.0 * dup / n, 2) AS duplicate_percentage,
CAST(5 AS DOUBLE) / 7 AS typed_column_share FROM p"""


def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    net = F.when(F.col("o_orderkey") % 8 != 5, F.col("o_totalprice") - 20000)
    return repeated_orders(spark, sf).withColumn("net", net)


@query(_SCORE)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return profile.quality_score(scored_orders(spark, sf))


@query(
    f"""SELECT total_score, CASE WHEN total_score >= 80 THEN 'excellent' WHEN total_score >= 60 THEN 'good' WHEN total_score >= 40 THEN 'fair' ELSE 'poor' END AS band
    FROM ({_SCORE}) q"""
)
def quality_band(spark: SparkSession, sf: str) -> DataFrame:
    score = profile.quality_score(scored_orders(spark, sf)).select("total_score")
    return score.withColumn("band", profile.quality_band(F.col("total_score")))


@query(
    f"""WITH p AS (SELECT 100.0 * (3 * COUNT(*) - COUNT(c_acctbal) - COUNT(c_mktsegment) - COUNT(c_name)) / (5 * COUNT(*)) AS p FROM {CUSTOMERS.sql} t)
    SELECT ROUND(p, 6) AS missing_pct, CASE WHEN p > 20 THEN 'impute' ELSE 'clean text' END AS advice FROM p"""
)
def next_step(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.next_step(CUSTOMERS.df(spark, sf)), 6, "missing_pct")


_FLAWED = f"""(SELECT *, CAST(1.0 AS DOUBLE) AS unit, CASE WHEN event_id % 10 < 9 THEN NULL ELSE user_id END AS sparse,
CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END AS side, event_id * 2 + 1 AS twice FROM {EVENTS.sql} e)"""


def flawed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a constant, a sparse, an imbalanced and a redundant column."""
    return EVENTS.df(spark, sf).selectExpr(
        "*",
        "CAST(1.0 AS DOUBLE) AS unit",
        "CASE WHEN event_id % 10 < 9 THEN NULL ELSE user_id END AS sparse",
        "CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END AS side",
        "event_id * 2 + 1 AS twice",
    )


@query(
    f"""WITH t AS {_FLAWED}, m AS (SELECT 3 * COUNT(*) - COUNT(event_type) - COUNT(value) - COUNT(sparse) AS n FROM t), r AS (
    SELECT 'narrative' AS level, 'missing' AS kind, 'table' AS subject, CAST(n AS DOUBLE) AS metric FROM m WHERE n > 0
    UNION ALL SELECT 'warning', 'high_missing', 'value', 1 - CAST(COUNT(value) AS DOUBLE) / COUNT(*) FROM t HAVING COUNT(value) < 0.5 * COUNT(*)
    UNION ALL SELECT 'warning', 'high_missing', 'sparse', 1 - CAST(COUNT(sparse) AS DOUBLE) / COUNT(*) FROM t HAVING COUNT(sparse) < 0.5 * COUNT(*)
    UNION ALL SELECT 'warning', 'constant', 'unit', CAST(COUNT(DISTINCT unit) AS DOUBLE) FROM t HAVING COUNT(DISTINCT unit) <= 1
    UNION ALL SELECT 'warning', 'imbalance', 'side', AVG(CASE WHEN side = 'a' THEN 1.0 ELSE 0.0 END) FROM t HAVING AVG(CASE WHEN side = 'a' THEN 1.0 ELSE 0.0 END) > 0.9
    UNION ALL SELECT 'narrative', 'skewed', 'value', SKEWNESS(value) FROM t HAVING ABS(SKEWNESS(value)) > 2
    UNION ALL SELECT 'recommendation', 'skewed', 'table', CAST(1 AS DOUBLE) FROM t HAVING ABS(SKEWNESS(value)) > 2
    UNION ALL SELECT 'warning', 'correlated', 'user_id ~ sparse', CORR(user_id, sparse) FROM t HAVING ABS(CORR(user_id, sparse)) > 0.9
    UNION ALL SELECT 'warning', 'correlated', 'event_id ~ twice', CORR(event_id, twice) FROM t HAVING ABS(CORR(event_id, twice)) > 0.9)
    SELECT level, kind, subject, ROUND(metric, 6) AS metric FROM r"""
)
def findings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(insights.findings(flawed_events(spark, sf)).drop("message"), 6, "metric")


@query(
    f"""WITH t AS {_FLAWED} SELECT * FROM (SELECT 'unit' AS "column", 'Constant' AS type, 'High' AS priority FROM t HAVING COUNT(DISTINCT unit) <= 1
    UNION ALL SELECT 'twice', 'High Correlation', 'Medium' FROM t HAVING ABS(CORR(event_id, twice)) > 0.95
    UNION ALL SELECT 'sparse', 'High Correlation', 'Medium' FROM t HAVING ABS(CORR(user_id, sparse)) > 0.95
    UNION ALL SELECT 'sparse', 'High Missing', 'High' FROM t HAVING COUNT(*) - COUNT(sparse) > 0.9 * COUNT(*))"""
)
def suggest_drops(spark: SparkSession, sf: str) -> DataFrame:
    return insights.suggest_drops(flawed_events(spark, sf)).drop("reason")


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, p_size * 2 AS doubled, p_size + 1 AS shifted FROM part)
    SELECT 'p_partkey' AS "column", FALSE AS selected, 'looks like a key' AS reason FROM t HAVING COUNT(DISTINCT p_partkey) > 0.95 * COUNT(*)
    UNION ALL SELECT 'p_name', FALSE, 'text that must be encoded first' FROM t HAVING COUNT(DISTINCT p_name) > 20
    UNION ALL SELECT 'p_brand', FALSE, 'text that must be encoded first' FROM t HAVING COUNT(DISTINCT p_brand) > 20
    UNION ALL SELECT 'p_size', TRUE, NULL FROM t HAVING COUNT(DISTINCT p_size) > 1
    UNION ALL SELECT 'p_retailprice', TRUE, NULL FROM t HAVING COUNT(DISTINCT p_retailprice) > 1 AND ABS(CORR(p_size, p_retailprice)) <= 0.95
    UNION ALL SELECT 'doubled', FALSE, 'follows p_size' FROM t HAVING ABS(CORR(p_size, doubled)) > 0.95
    UNION ALL SELECT 'shifted', FALSE, 'follows p_size' FROM t HAVING ABS(CORR(p_size, shifted)) > 0.95"""
)
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", "p_size * 2 AS doubled", "p_size + 1 AS shifted"
    )
    found = insights.select_features(parts)
    # Percentages in the reason depend on rounding; the rule itself is compared.
    return found.withColumn("reason", F.regexp_replace("reason", r" \((\d|r=).*\)$", ""))


@query(
    f"""WITH b AS (SELECT *, CASE WHEN o_orderkey % 8 = 5 THEN NULL ELSE o_totalprice - 20000 END AS net FROM {REPEATED_SQL} r),
    a AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, net FROM b WHERE net IS NOT NULL)
    SELECT (SELECT COUNT(*) FROM b) AS rows_before, (SELECT COUNT(*) FROM a) AS rows_after, 7 AS columns_before, 6 AS columns_after,
    (SELECT COUNT(*) FROM b) - (SELECT COUNT(*) FROM a) AS rows_removed, 'o_orderpriority' AS columns_removed, '' AS columns_added,
    (SELECT COUNT(*) - COUNT(net) FROM b) AS missing_before, CAST(0 AS BIGINT) AS missing_after, (SELECT COUNT(*) - COUNT(net) FROM b) AS missing_values_removed,
    (SELECT COUNT(*) FROM b) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM b)) AS duplicates_removed,
    CASE WHEN (SELECT MIN(net) FROM a) < 0 THEN 99.0 ELSE 100.0 END AS data_quality_score, 3 AS total_actions, 'fill,drop,dedup' AS recent_actions"""
)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    before = scored_orders(spark, sf)
    after = before.filter("net IS NOT NULL").drop("o_orderpriority").distinct()
    found = profile.cleaning_report(before, after, ["fill", "drop", "dedup"])
    lists = ("columns_removed", "columns_added", "recent_actions")
    return found.withColumns({c: F.array_join(c, ",") for c in lists})


# -- correlation ------------------------------------------------------------
_PAIRED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    f"WITH t AS {LINES.sql} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, ROUND(CORR({a}, {b}), 6) AS correlation FROM t" for a in _PAIRED for b in _PAIRED
    )
)
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlation(LINES.df(spark, sf), _PAIRED), 6, "correlation")


def _spearman_sql(a: str, b: str) -> str:
    def rank(c: str) -> str:
        return f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, ROUND(CORR(x, y), 6) AS correlation FROM
    (SELECT CAST({rank(a)} AS DOUBLE) AS x, CAST({rank(b)} AS DOUBLE) AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(f"WITH t AS {LINES.sql} " + " UNION ALL ".join(_spearman_sql(a, b) for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]))
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.correlation_pairs(LINES.df(spark, sf), _PAIRED, "spearman"), 6, "correlation")


@query(
    f"WITH t AS {LINES.sql} "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(CORR({c}, l_quantity), 6) AS correlation FROM t" for c in _PAIRED[1:])
)
def target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation.target_correlation(LINES.df(spark, sf), "l_quantity", _PAIRED), 6, "correlation")


@query(
    f"""WITH t AS (SELECT event_id, user_id, value, value * 2 + 1 AS twice, event_id + user_id AS total FROM {EVENTS.sql} e), r AS (
    SELECT 'value' AS feature_1, 'twice' AS feature_2, CORR(value, twice) AS r FROM t UNION ALL SELECT 'event_id', 'user_id', CORR(event_id, user_id) FROM t
    UNION ALL SELECT 'event_id', 'value', CORR(event_id, value) FROM t UNION ALL SELECT 'event_id', 'twice', CORR(event_id, twice) FROM t
    UNION ALL SELECT 'event_id', 'total', CORR(event_id, total) FROM t UNION ALL SELECT 'user_id', 'value', CORR(user_id, value) FROM t
    UNION ALL SELECT 'user_id', 'twice', CORR(user_id, twice) FROM t UNION ALL SELECT 'user_id', 'total', CORR(user_id, total) FROM t
    UNION ALL SELECT 'value', 'total', CORR(value, total) FROM t UNION ALL SELECT 'twice', 'total', CORR(twice, total) FROM t)
    SELECT feature_1, feature_2, ROUND(r, 6) AS correlation FROM r WHERE ABS(r) > 0.7 ORDER BY ABS(r) DESC LIMIT 10"""
)
def correlated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    df = EVENTS.df(spark, sf).selectExpr("event_id", "user_id", "value", "value * 2 + 1 AS twice", "event_id + user_id AS total")
    return rounded(correlation.correlated_pairs(df, 0.7, k=10), 6, "correlation")


@query(f"SELECT event_type, ROUND(SKEWNESS(value), 6) AS skew FROM {EVENTS.sql} t GROUP BY event_type")
def skew(spark: SparkSession, sf: str) -> DataFrame:
    df = EVENTS.df(spark, sf)
    return df.groupBy("event_type").agg(F.round(sample_skew(as_double(df, "value")), 6).alias("skew"))


@query(
    f"""WITH k AS (SELECT c_mktsegment v, ROW_NUMBER() OVER (ORDER BY c_mktsegment) - 1 AS code FROM {CUSTOMERS.sql} t WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
    SELECT c_custkey, CAST(code AS INTEGER) AS c_mktsegment FROM {CUSTOMERS.sql} t LEFT JOIN k ON c_mktsegment = v"""
)
def encode_for_correlation(spark: SparkSession, sf: str) -> DataFrame:
    df = CUSTOMERS.df(spark, sf)
    return correlation.encode_for_correlation(df).select("c_custkey", "c_mktsegment")
