"""Train, validation and test splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Splits:
    """One table with a split column: train, validation, test."""

    rows: DataFrame

    def get(self, *names: str) -> DataFrame:
        return self.rows.where(F.col("split").isin(*names)).drop("split")

    @property
    def train(self) -> DataFrame:
        return self.get("train")

    @property
    def validation(self) -> DataFrame:
        return self.get("validation")

    @property
    def train_validation(self) -> DataFrame:
        return self.get("train", "validation")

    @property
    def test(self) -> DataFrame:
        return self.get("test")

    def violations(self, user: str, item: str, k: int | None = None) -> DataFrame:
        """check, violations: cells that two splits share, and users without exactly k rows held out."""
        cells = self.rows.select(user, item, "split").distinct()
        shared = cells.groupBy(user, item).agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
        out = shared.agg(F.count_if(F.expr("n > 1")).alias("disjoint"), F.count_if(F.expr("n > 1 and t > 0")).alias("disjoint_test"))
        checks = ["disjoint", "disjoint_test"]
        if k is not None:
            held = self.rows.groupBy(user).agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("validation", "test")])
            out = out.crossJoin(held.agg(*[F.count_if(F.col(s) != k).alias(f"leave_{k}_{s}") for s in ("validation", "test")]))
            checks += [f"leave_{k}_validation", f"leave_{k}_test"]
        return out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in checks])))


def by_threshold(df: DataFrame, column: str, value) -> Splits:
    """Rows up to the value train, the others (null among them) test."""
    return Splits(df.withColumn("split", F.when(F.coalesce(F.col(column) <= F.lit(value), F.lit(False)), "train").otherwise("test")))


def last_k(df: DataFrame, group: str, order_by: list[str], k: int, *, validation: bool = False, strict: bool = True) -> Splits:
    """The last k rows of each group test; with validation, the k before them validate: one window for all.

    order_by must be a total order. strict: raise if a group has too few rows, naming some; otherwise such groups go to
    training whole.
    """
    needed = k * (2 if validation else 1) + 1
    if strict:
        few = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < needed).limit(10).collect()
        if few:
            raise ValueError(f"groups with fewer than {needed} rows: {sorted(str(r[0]) for r in few)}")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order_by]))
    ranked = df.withColumn("_rank", rank)
    if not strict:
        ranked = ranked.withColumn("_rank", F.when(F.count("*").over(Window.partitionBy(group)) >= needed, F.col("_rank")).otherwise(needed))
    split = F.when(F.col("_rank") <= k, "test")
    if validation:
        split = split.when(F.col("_rank") <= 2 * k, "validation")
    return Splits(ranked.withColumn("split", split.otherwise("train")).drop("_rank"))
