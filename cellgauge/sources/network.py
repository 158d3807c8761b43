"""Observation table derived from the order tables.

Deterministic and linear in `lineitem`. It breaks every validation rule somewhere:
out-of-range signals, negative traffic and user counts, unknown devices and
locations, nulls and repeated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.sources import schema as S
from cellgauge.sources.tables import cached, spread


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table cached for queries that fit statistics first and then read it again.

    Both joins run once. Rows spill to disk when memory is short; lost ones are rebuilt.
    """
    return cached(network(spark, sf_dir))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both joins are plain equi-joins: sizes decide their strategy at run time."""
    lineitem = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")

    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    key = F.concat(F.lit("T"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    signal = (
        F.when(F.col("l_partkey") % 211 == 0, 5.0)
        .when(F.col("l_quantity") == 13, None)
        .otherwise(-50.0 - F.col("l_quantity"))
    )
    traffic = (
        F.when(F.col("l_partkey") % 223 == 0, -1.0)
        .when(F.col("l_partkey") % 37 == 0, None)
        .otherwise(F.col("l_extendedprice") / 250.0)
    )
    load = (
        5.0
        + F.col("l_extendedprice") / 2000.0
        + F.col("p_size") * 0.5
        + F.col("l_quantity") * 0.5
        + F.col("l_tax") * 100.0
    )
    latency = F.when(
        F.coalesce(F.col("l_suppkey") != 41, F.lit(True)),
        load * F.when(F.col("l_orderkey") % 97 == 0, 3.0).otherwise(1.0),
    )
    users = (
        F.when(F.col("p_size") == 7, None)
        .when(F.col("l_orderkey") % 499 == 0, -3)
        .otherwise(F.col("p_size") + 10)
    )
    priority = F.col("o_orderpriority")
    device = (
        F.when(priority == "1-URGENT", "Mobile")
        .when(priority == "2-HIGH", "Laptop")
        .when(priority == "3-MEDIUM", "Smartphone")
        .when(priority == "5-LOW", "Tablet")
        .when(F.col("l_linenumber") % 2 == 0, "Satellite")
    )
    flag = F.col("l_returnflag")
    location = (
        F.when(flag == "A", "Urban")
        .when(flag == "R", "Rural")
        .when(F.col("l_linestatus") == "O", "Suburban")
    )
    return joined.select(
        key.alias(S.KEY),
        signal.cast("double").alias(S.SIGNAL),
        traffic.cast("double").alias(S.TRAFFIC),
        latency.alias(S.LATENCY),
        users.cast("int").alias(S.USERS),
        device.alias(S.DEVICE),
        location.alias(S.LOCATION),
    )
