"""Panels, bars and histories derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspan.operators.histories import centred_pnl, ordered_pnl
from quantspan.operators.scans import ranged

# Lifts the averaged amounts to an index level with daily moves of a few percent.
PRIORITY_LEVEL = 5_000_000.0
BRAND_LEVEL = 1_000_000.0
PNL_SCALE = 1999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars: every order is one; dates repeat and include weekends."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("instrument"),
        F.to_date("o_orderdate").alias("dt"),
        F.col("o_orderkey").alias("ord"),
        F.col("o_totalprice").alias("close"),
    )


def balance_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars with non-positive prices: the buyer's balance at each order."""
    customers = table(spark, sf_dir, "customer")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("instrument"),
            F.to_date("o_orderdate").alias("dt"),
            F.col("o_orderkey").alias("ord"),
            F.col("c_acctbal").alias("close"),
        )
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars with heavy tails: event values per user."""
    return table(spark, sf_dir, "events").select(
        F.format_string("U%05d", "user_id").alias("instrument"),
        F.to_date("ts").alias("dt"),
        F.col("event_id").alias("ord"),
        F.col("value").alias("close"),
    )


def ohlc_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, highest, lowest and last order amount of each date."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("dt")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
    )


def event_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.format_string("U%05d", "user_id").alias("instrument"), F.to_date("ts").alias("dt")
    ).agg(
        F.min_by("value", "event_id").alias("open"),
        F.max_by("value", "event_id").alias("close"),
    )


def priority_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return (
        orders.groupBy(
            F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("dt")
        )
        .agg((F.lit(PRIORITY_LEVEL) + F.avg("o_totalprice")).alias("close"))
        .select(F.lit("priority").alias("panel"), "instrument", "dt", "close")
    )


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("instrument"), F.to_date("l_shipdate").alias("dt"))
        .agg((F.lit(BRAND_LEVEL) + F.avg("l_extendedprice")).alias("close"))
        .select(F.lit("brand").alias("panel"), "instrument", "dt", "close")
    )


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a history of gains and losses -> (user_id, ts, day, r, pnl)

    Cut by user, time and id, so that neither a user nor one hour of a user is a single task.
    """
    path, order = ["user_id"], ["ts", "event_id"]
    events = table(spark, sf_dir, "events").select(*path, *order, "value")
    steps = centred_pnl(ranged(events, path, order, "events"), path, order, None, "value", PNL_SCALE)
    return steps.select("user_id", "ts", "day", "r", "pnl")


def user_steps_in_order(spark: SparkSession, sf_dir: str, users: DataFrame) -> DataFrame:
    """`user_steps` of some users, each added up row after row."""
    events = table(spark, sf_dir, "events").join(users, "user_id", "left_semi").select("user_id", "ts", "event_id", "value")
    steps = ordered_pnl(events, ["user_id"], ["ts", "event_id"], "value", PNL_SCALE)
    return steps.select("user_id", "ts", "day", "r", "pnl")
