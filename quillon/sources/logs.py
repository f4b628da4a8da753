"""Interaction and impression logs from the source tables.

Interactions have record_id, user_id, item_id, ts and a rating; impressions have record_id, user_id and a list of
items. Columns are projected in the scan, so the readers fetch no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit feedback in time order: ts and record_id are unique."""
    e = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("record_id"), "user_id", item.alias("item_id"), "ts", F.col("value").alias("rating"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases: customers, parts, order dates and quantities."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").alias("rating"), F.col("l_orderkey").alias("order_id"))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of parts for each order, sorted, repeats kept; an order has few lines, so lists are short."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("items"))
    return orders.join(lists, orders["o_orderkey"] == lists["l_orderkey"]).select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("user_id"), "items")


def mean_in_order(value: Column, order: Column) -> Column:
    """The mean of a group's values, added one by one in the order of a unique key; nulls don't count.

    A sum of doubles depends on the order of its terms. What is rounded afterwards, near a tie, must not depend on how a
    group's rows are dealt to tasks.
    """
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("n"), value.alias("x")))))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["x"]), F.size(rows))


def micros(ts: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
