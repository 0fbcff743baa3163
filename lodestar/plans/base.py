"""What the query modules share: tables, the registry decorator, and SQL fragments for the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import values as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Reports are as of this day; balances times CAPITAL stand for a company's capital.
AS_OF, CAPITAL = "2001-08-01", 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def capital() -> Column:
    return F.col("c_acctbal") * CAPITAL


def sql_round(x: str, digits: int = 0) -> str:
    return f"round_even(({x}) * {10.0**digits}, 0) / {10.0**digits}"


def sql_bucket(x: str, steps: list, default: str = "unknown") -> str:
    whens = " ".join(f"WHEN {x} < {limit} THEN '{name}'" for limit, name in steps if limit is not None)
    return f"CASE WHEN {x} IS NULL THEN '{default}' {whens} ELSE '{steps[-1][1]}' END"


SQL_TIER = sql_bucket(f"(CASE WHEN c_acctbal * {CAPITAL} > 0 THEN c_acctbal * {CAPITAL} END)", V.CAPITAL_TIERS)
SQL_AGE = f"(CASE WHEN date_diff('day', d, DATE '{AS_OF}') >= 0 THEN date_diff('day', d, DATE '{AS_OF}') / 365.25 END)"
SQL_MATURITY = sql_bucket(SQL_AGE, V.MATURITY)
#: customers with first and last order
SQL_CUSTOMERS = "(SELECT c.*, f.first_order, f.last_order, f.n_orders FROM customer c LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order, CAST(max(o_orderdate) AS DATE) AS last_order, count(*) AS n_orders FROM orders GROUP BY 1) f ON f.o_custkey = c.c_custkey)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_order"), F.max("o_orderdate").cast("date").alias("last_order"), F.count("*").alias("n_orders"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").drop("o_custkey")


def share(c: Column, digits: int = 2) -> Column:
    """Percent of rows for which a condition holds; NULL counts as not."""
    from lodestar.functions.features import rounded

    return rounded(F.avg(F.when(c, 100.0).otherwise(0.0)), digits)


def sql_share(c: str, digits: int = 2) -> str:
    return sql_round(f"avg(CASE WHEN {c} THEN 100.0 ELSE 0.0 END)", digits)
