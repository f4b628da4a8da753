"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the smallest id reachable, of every id in edges (a, b).

    Labels pass along edges and then jump to their label's label, so the rounds grow with the logarithm of the
    longest chain. Each round is written to the shared folder; nothing is gathered on the driver.
    """
    spark = edges.sparkSession
    both, both_at = materialize(spark, edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels, at = materialize(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        offered = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(offered, "id", "left").select("id", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        near, near_at = materialize(spark, step, "labels")
        up = near.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        jumped = near.join(up, "comp", "left").select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        new, new_at = materialize(spark, jumped, "labels")
        changed = new.where("comp <> was").limit(1).count()
        discard(spark, at, near_at)
        labels, at = new.select("id", "comp"), new_at
        if not changed:
            discard(spark, both_at)
            return labels
