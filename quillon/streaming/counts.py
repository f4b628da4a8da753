"""Running interaction counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, ts: str, item: str, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Interactions of each item in tumbling windows; rows later than the watermark are dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width), item).agg(F.count("*").alias("n")).select("window.start", "window.end", item, "n")


def first_seen(stream: DataFrame, ts: str, keys: list[str], *, late: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")
