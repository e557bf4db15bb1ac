"""The registered queries and the SQL that gives the same answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Derived:
    """A projection of one table, written once for both engines."""

    source: str
    columns: tuple[str, ...]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.columns)} FROM {self.source})"


# Driver tables hold no missing values; these projections add some by arithmetic.
LINES = Derived(
    "lineitem",
    (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "CASE WHEN l_orderkey % 7 = 3 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
        "CASE WHEN l_partkey % 5 = 3 THEN NULL ELSE l_returnflag END AS l_returnflag",
        "l_linestatus",
        "CASE WHEN l_suppkey % 11 = 4 THEN NULL ELSE l_shipdate END AS l_shipdate",
    ),
)
EVENTS = Derived(
    "events",
    (
        "event_id", "ts", "user_id",
        "CASE WHEN event_id % 6 = 1 THEN NULL ELSE event_type END AS event_type",
        "CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS value",
    ),
)
CUSTOMERS = Derived(
    "customer",
    (
        "c_custkey", "c_nationkey",
        "CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_acctbal END AS c_acctbal",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment",
        "CASE WHEN c_custkey % 10 < 9 THEN NULL ELSE c_name END AS c_name",
    ),
)
MESSY = Derived(
    "customer",
    (
        "c_custkey",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '  ' || c_name || '#  x!  ' || c_mktsegment || ' ' END AS note",
    ),
)
# Text columns that hold numbers, dates, booleans, codes and free text.
TYPED = Derived(
    "orders",
    (
        "o_orderkey",
        "CAST(o_custkey AS STRING) AS whole",
        "CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) || '.5' END AS fraction",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'yes' WHEN o_orderkey % 4 = 1 THEN 'N' WHEN o_orderkey % 4 = 2 THEN '1' ELSE NULL END AS flag",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE "
        "CAST(1 + o_orderkey % 28 AS STRING) || '/' || CAST(1 + o_orderkey % 12 AS STRING) || '/20' || CAST(10 + o_orderkey % 15 AS STRING) END AS day",
        "o_orderpriority AS priority",
        "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) ELSE 'order ' || CAST(o_orderkey AS STRING) END AS mixed",
    ),
)
REPEATED_SQL = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 0)"


def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with some rows repeated once or twice more."""
    orders = table(spark, sf_dir, "orders")
    return orders.unionAll(orders.filter("o_orderkey % 50 = 0")).unionAll(orders.filter("o_orderkey % 100 = 0"))


# A two-class and a numeric prediction table derived from events and lineitem.
CLASSIFIED = Derived(
    "events",
    (
        "event_id",
        "CASE WHEN value > 20 THEN 1 ELSE 0 END AS label",
        "CASE WHEN (event_id * 37) % 100 + value > 70 THEN 1 ELSE 0 END AS prediction",
        "CAST((event_id * 37) % 100 AS DOUBLE) + value AS score",
        "CAST(0.3 AS DOUBLE) + CAST((event_id * 13) % 70 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence",
    ),
)
ESTIMATED = Derived(
    "lineitem",
    ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice AS label", "l_quantity * CAST(1500 AS DOUBLE) AS prediction"),
)
