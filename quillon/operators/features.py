"""Features of user-item pairs from logs. All project first, explode lists, and drop rows with nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from quillon.operators.clean import Cut, deduplicate, mark

UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0}


def prepared(df: DataFrame, user: str, items: str, *others: str) -> DataFrame:
    """Only the named columns, lists exploded, rows with a null dropped (an empty list leaves no row)."""
    out = df.select(user, items, *others)
    if isinstance(df.schema[items].dataType, ArrayType):
        out = out.withColumn(items, F.explode(items))
    return out.dropna()


def frequency(df: DataFrame, user: str, items: str) -> DataFrame:
    return prepared(df, user, items).groupBy(user, items).agg(F.count("*").alias("frequency"))


def last_seen(df: DataFrame, user: str, items: str, ts: str, tie: str, *, skip_null: bool = False) -> Cut:
    """Time since a pair was last seen, for pairs seen at least twice.

    The last row of a pair is kept, the earlier ones are removed. Timestamps give last_seen_seconds to _weeks, null
    where the distance is zero; numbers give last_seen_euclidean, zero kept. skip_null: rows without distance are
    dropped before the last one is taken, and all others of the input are removed, pairs seen once among them.
    """
    rows = prepared(df, user, items, ts, tie)
    by = Window.partitionBy(user, items).orderBy(ts, tie)
    every = Window.partitionBy(user, items)
    numeric = isinstance(df.schema[ts].dataType, NumericType)
    if numeric:
        out = rows.withColumn("last_seen_euclidean", F.col(ts) - F.lag(ts).over(by))
        main = "last_seen_euclidean"
    else:
        before = F.lag(ts).over(by)
        out = rows.withColumn("_before", before).withColumn("_since", F.expr(f"timestampdiff(MICROSECOND, _before, {ts})") / 1e6)
        out = out.select("*", *[F.nullif(F.col("_since") / n, F.lit(0.0)).alias(f"last_seen_{u}") for u, n in UNITS.items()]).drop("_before", "_since")
        main = "last_seen_seconds"
    if skip_null:
        has = F.col(main).isNotNull()
        rank = F.row_number().over(Window.partitionBy(user, items, has).orderBy(F.col(ts).desc(), F.col(tie).desc()))
        return mark(out, has & (rank == 1))
    counted = out.withColumn("_n", F.count("*").over(every)).withColumn("_rank", F.row_number().over(Window.partitionBy(user, items).orderBy(F.col(ts).desc(), F.col(tie).desc())))
    return Cut(mark(counted.where("_n > 1"), F.col("_rank") == 1).marked.drop("_n", "_rank"))


def position(df: DataFrame, user: str, items: str, tie: str, *, positions: str | None = None, keep: str = "first") -> Cut:
    """Place of an item in the list it was shown in: 0-based, or from a parallel list."""
    if not isinstance(df.schema[items].dataType, ArrayType):
        raise ValueError("positions need a column of lists")
    if positions is None:
        flat = df.select(user, tie, F.posexplode(items).alias("_at", "_item")).withColumn("position", F.col("_at"))
    else:
        flat = df.select(user, tie, F.posexplode(F.arrays_zip(F.col(items).alias("i"), F.col(positions).alias("p"))).alias("_at", "_z")).select(user, tie, "_at", F.col("_z.i").alias("_item"), F.col("_z.p").alias("position"))
    flat = flat.withColumnRenamed("_item", items).withColumn("position", F.col("position").cast("int")).dropna()
    cut = deduplicate(flat, [user, items], [tie, "_at"], keep)
    return Cut(cut.marked.drop("_at"))


def timestamp(df: DataFrame, user: str, items: str, ts: str, tie: str, *, keep: str = "first") -> Cut:
    """When a pair was seen, in true seconds since 1970 (numbers as they are), first, last, or only once."""
    rows = prepared(df, user, items, ts, tie)
    value = F.col(ts).cast("double") if isinstance(df.schema[ts].dataType, NumericType) else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1e6
    return deduplicate(rows.withColumn("seconds", value), [user, items], [ts, tie], keep)
