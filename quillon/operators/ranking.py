"""Ranks and top-k. Ties are broken by id, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import written

DIGITS = 12


def prefix_sums(df: DataFrame, order: list[Column | str], value: str | None = None, by: list[str] = (), name: str = "before") -> DataFrame:
    """df with the sum of value (or the number) of the rows that come before in each group by the order, which is total.

    Rows are dealt in ranges of the order, whose bounds Spark samples, and written, so that the ranges are fixed. Each
    range sums for itself, after the totals of the ranges before it: no task sorts a whole group, however large.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(df.repartitionByRange(parts, *by, *columns).withColumn("_part", F.spark_partition_id()))
    weight = F.lit(1) if value is None else F.col(value)
    none = F.lit(0).cast("bigint") if value is None else F.lit(0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_sum"))
    base = totals.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), none).alias("_base"))  # a row for each group and range
    own = Window.partitionBy(*by, "_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum(weight).over(own), none)).join(base, [*by, "_part"])
    return summed.withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_own", "_base")


def dense_index(ids: DataFrame, column: str) -> DataFrame:
    """Distinct ids of any type that has an order, with idx, their 0-based place in it."""
    return prefix_sums(ids, [column], name="idx")


def top_k(df: DataFrame, group: str, score: str, item: str, k: int, position: str = "pos") -> DataFrame:
    """The k best of each group with their 1-based position; scores are compared at 12 digits, ties by item."""
    order = Window.partitionBy(group).orderBy(F.round(F.col(score), DIGITS).desc(), F.col(item))
    return df.withColumn(position, F.row_number().over(order)).where(F.col(position) <= k)


def rank_rows(df: DataFrame, row: str, column: str, keys: list[str]) -> DataFrame:
    """Ordinal rank 1..n within each row, ascending; the last key counts most, equal ones keep the column's order."""
    order = Window.partitionBy(row).orderBy(*[F.col(k) for k in reversed(keys)], F.col(column))
    return df.withColumn("rank", F.row_number().over(order))


def average_rank(value: Column, *by: Column | str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2.0
