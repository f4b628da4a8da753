"""The data behind charts and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import prefix_sums


def popularity_curve(df: DataFrame, column: str) -> DataFrame:
    """value, n and its place in the order of counts, nulls left out.

    Places are numbered in ranges of the order, so the many values of the lowest counts are no single task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return prefix_sums(counts, [F.col("n").desc(), "value"]).select("value", "n", (F.col("before") + 1).alias("place"))


PARTS = {
    "date": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "hour": lambda c: F.hour(c),
    "minute": lambda c: F.minute(c),
    "round_hour": lambda c: F.date_format(F.date_trunc("HOUR", c + F.expr("INTERVAL 30 MINUTES")), "yyyy-MM-dd HH"),
    "round_minute": lambda c: F.date_format(F.date_trunc("MINUTE", c + F.expr("INTERVAL 30 SECONDS")), "yyyy-MM-dd HH:mm"),
    "day_name": lambda c: F.date_format(c, "EEEE"),
}


def histogram(df: DataFrame, ts: str, by: str) -> DataFrame:
    """Rows by a part of the timestamp: date, hour, minute, round_hour, round_minute, day_name."""
    if by not in PARTS:
        raise ValueError(f"by is one of {', '.join(PARTS)}")
    return df.groupBy(PARTS[by](F.col(ts)).alias("part")).agg(F.count("*").alias("n"))


def profile_curves(datasets: dict[str, DataFrame], column: str) -> DataFrame:
    """dataset, id, n, share and place of profile lengths, by dataset."""
    out = None
    for name, df in datasets.items():
        curve = popularity_curve(df, column).crossJoin(df.where(F.col(column).isNotNull()).agg(F.count("*").alias("total")))
        curve = curve.select(F.lit(name).alias("dataset"), F.col("value").alias("id"), "n", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"), "place")
        out = curve if out is None else out.unionByName(curve)
    return out


def records(datasets: dict[str, DataFrame], cell: list[str]) -> DataFrame:
    """dataset, records, distinct_records."""
    out = None
    for name, df in datasets.items():
        one = df.agg(F.count("*").alias("records"), F.count_distinct(*cell).alias("distinct_records")).select(F.lit(name).alias("dataset"), "records", "distinct_records")
        out = one if out is None else out.unionByName(one)
    return out


def min_max(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """value scaled to 0..1 within each group; a constant group becomes 0."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    span = F.col("_hi") - F.col("_lo")
    return joined.withColumn(value, F.when(span == 0, F.col(value) - F.col("_lo")).otherwise((F.col(value) - F.col("_lo")) / span)).drop("_lo", "_hi")


def blank_zeros(df: DataFrame, value: str, small: float = 1e-8) -> DataFrame:
    return df.withColumn(value, F.when(F.abs(value) > small, F.col(value)))


def results_table(results: DataFrame, metric: str, names: list[str] | None = None) -> DataFrame:
    """recommender by cutoff for one metric. results: recommender, cutoff and metrics."""
    cutoffs = names or [str(r[0]) for r in results.select("cutoff").distinct().orderBy("cutoff").collect()]
    return results.groupBy("recommender").pivot("cutoff", [int(c) for c in cutoffs]).agg(F.first(metric))


def hyper_parameters(metadata: DataFrame) -> DataFrame:
    """algorithm, hyperparameter, value of search results read from JSON (algorithm, best map<string,string>)."""
    return metadata.select("algorithm", F.explode("best").alias("hyperparameter", "value"))


def heat_map(cells: DataFrame) -> DataFrame:
    """Weights in the order of a heat map: x and y (places of items and users by popularity), value, and both means."""
    users = cells.groupBy("u").agg(F.count("*").alias("n"), F.avg("r").alias("user_mean"))
    items = cells.groupBy("i").agg(F.count("*").alias("n"), F.avg("r").alias("item_mean"))
    y = prefix_sums(users, [F.col("n").desc(), "u"], name="y").drop("n")
    x = prefix_sums(items, [F.col("n").desc(), "i"], name="x").drop("n")
    return cells.join(y, "u").join(x, "i").select("u", "i", "x", "y", F.col("r").alias("value"), "user_mean", "item_mean")
