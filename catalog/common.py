"""Adapters from the given tables to the library's inputs, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.plans.daily import to_observations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Types that read the same from any client: text, bigint, double, boolean."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType,)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all shuffle partitions before a large text is made of each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# --- observations from the given tables ------------------------------------


def event_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Daily value per event type."""
    return to_observations(
        table(spark, sf, "events"), series=F.col("event_type"), day=F.to_date("ts"),
        value=F.col("value"),
    )


def user_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Daily value per user and event type: many short series with gaps."""
    return to_observations(
        table(spark, sf, "events"), series=F.concat_ws("/", "event_type", "user_id"),
        day=F.to_date("ts"), value=F.col("value"),
    )


def order_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order value per priority: multi-year series."""
    return to_observations(
        table(spark, sf, "orders"), series=F.col("o_orderpriority"), day=F.to_date("o_orderdate"),
        value=F.col("o_totalprice"), scale=2,
    )


def ship_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Daily shipped value per return flag."""
    return to_observations(
        table(spark, sf, "lineitem"), series=F.col("l_returnflag"), day=F.to_date("l_shipdate"),
        value=F.col("l_extendedprice"), scale=2,
    )


def quarter_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly order value per priority: series_id, ordinal, obs_date, value."""
    rows = table(spark, sf, "orders")
    return rows.groupBy(
        F.col("o_orderpriority").alias("series_id"),
        (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("ordinal"),
    ).agg(
        F.max(F.to_date("o_orderdate")).alias("obs_date"),
        F.sum(F.col("o_totalprice").cast("decimal(28,2)")).cast("double").alias("value"),
    )


# The same inputs as common table expressions.
EVENTS_CTE = """ev AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS obs_date,
  CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"""
USERS_CTE = """us AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS series_id,
  CAST(ts AS DATE) AS obs_date,
  CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"""
ORDERS_CTE = """ob AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""
SHIP_CTE = """sh AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS obs_date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"""
QUARTER_CTE = """qo AS (SELECT o_orderpriority AS series_id,
  CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS ordinal,
  MAX(CAST(o_orderdate AS DATE)) AS obs_date,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""
