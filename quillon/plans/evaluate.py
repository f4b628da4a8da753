"""Evaluation of top-k lists: from logs to a table of metrics by cutoff."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import metrics
from quillon.operators.ranking import dense_index, prefix_sums
from quillon.scratch import written
from quillon.sources.store import read_or_build_all


@dataclass(frozen=True)
class Holdout:
    """What a recommender is evaluated on: cells of train and test, lists' cutoffs, and ids that are left out."""

    train: DataFrame  # user_id, item_id
    test: DataFrame  # user_id, item_id, r
    cutoffs: tuple[int, ...] = (5, 10)
    least_test: int = 1
    ignored_users: DataFrame | None = None
    ignored_items: DataFrame | None = None

    def written(self) -> Holdout:
        """The same with train and test as tables of their own, so that no part of an evaluation makes them again."""
        return replace(self, train=written(self.train), test=written(self.test))

    def users(self) -> DataFrame:
        """Users with enough test items that are not ignored."""
        u = self.test.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= self.least_test).select("user_id")
        return u if self.ignored_users is None else u.join(self.ignored_users.select("user_id"), "user_id", "left_anti")

    def items(self) -> DataFrame:
        i = self.train.select("item_id").union(self.test.select("item_id")).distinct()
        return i if self.ignored_items is None else i.join(self.ignored_items.select("item_id"), "item_id", "left_anti")

    def all_users(self) -> DataFrame:
        return self.train.select("user_id").union(self.test.select("user_id")).distinct()

    def evaluated_test(self) -> DataFrame:
        return self.test.join(self.users(), "user_id", "left_semi")

    def scores(self, recs: DataFrame) -> DataFrame:
        """Metrics per user and cutoff."""
        pop = self.train.groupBy("item_id").agg(F.count("*").alias("n"))
        return metrics.per_user(recs, self.evaluated_test(), pop, self.items().count(), list(self.cutoffs))

    def table(self, recs: DataFrame) -> DataFrame:
        """All metrics by cutoff, those of the corpus of lists and their ratios to training among them."""
        recs = written(recs)
        n_users, n_items = self.all_users().count(), self.items().count()
        n_ignored = 0 if self.ignored_users is None else self.ignored_users.count()
        users = metrics.mean_metrics(self.scores(recs), n_users - n_ignored)
        counts = metrics.item_counts(recs, self.evaluated_test(), self.items(), list(self.cutoffs))
        items = metrics.diversity(counts, "n_rec", "cutoff")
        hits = metrics.diversity(counts, "n_rec_relevant", "cutoff").select("cutoff", F.col("coverage_item").alias("coverage_item_hit"))
        trained = self.items().join(self.train.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").fillna(0, ["n"])
        base = metrics.diversity(trained, "n").select(*[F.col(c).alias(f"{c}_train") for c in ("diversity_gini", "diversity_herfindahl", "shannon_entropy")])
        novelty = metrics.train_novelty(self.train, n_users, n_items)
        out = users.join(items, "cutoff").join(hits, "cutoff").crossJoin(F.broadcast(base)).crossJoin(F.broadcast(novelty))
        ratios = [F.try_divide(F.col(c), F.col(f"{c}_train")).alias(f"ratio_{c}") for c in ("diversity_gini", "diversity_herfindahl", "shannon_entropy", "novelty")]
        return out.select(*[c for c in out.columns if not c.endswith("_train")], *ratios)


#: Places of the popularity order that are sent to every task.
HEAD = 100_000
#: Rows of a log that one task is dealt by user.
DEALT = 1_000_000


def most_popular(train: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The k most popular items that each user has not seen: user_id, item_id, pos, score.

    A user who has seen n items needs the first n + k of the popularity order at most: those whose places they have not
    seen are found in the list of the user's places, so that only k rows a user are made. Users are dealt to tasks of about
    DEALT rows. The head of the order, if it is short enough, is sent to all tasks, and places beyond it are joined.
    """
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    order = prefix_sums(counts, [F.col("n").desc(), "item_id"])
    ranked = written(order.select("item_id", F.col("n").cast("double").alias("score"), (F.col("before") + 1).cast("int").alias("place")))
    head, tail = ranked.where(F.col("place") <= HEAD), ranked.where(F.col("place") > HEAD)
    far = not tail.isEmpty()

    def joined(rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
        if not far:
            return rows.join(F.broadcast(head), key).select(*kept)
        return rows.join(ranked, key).select(*kept)

    parts = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-train.count() // DEALT))
    places = joined(train.select("user_id", "item_id"), "item_id", ["user_id", "place"]).repartition(parts, "user_id")
    seen = places.groupBy("user_id").agg(F.collect_set("place").alias("seen"))
    of = users.repartition(parts, "user_id").join(seen.hint("merge"), "user_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.size("seen") + k), F.col("seen")), 1, k)
    fresh = of.select("user_id", F.posexplode(free).alias("at", "place")).withColumn("pos", F.col("at") + 1)
    return joined(fresh, "place", ["user_id", "item_id", "pos", "score"])


def cached(spark: SparkSession, path: str, holdout: Holdout, recs: Callable[[], DataFrame]) -> dict[str, DataFrame]:
    """Scores per user and counts per item of a recommender, read if both are at path, else computed and written."""
    made: list[DataFrame] = []

    def lists() -> DataFrame:
        if not made:
            made.append(written(recs()))
        return made[0]

    found = read_or_build_all(
        spark,
        {
            f"{path}/users": lambda: holdout.scores(lists()),
            f"{path}/items": lambda: metrics.item_counts(lists(), holdout.evaluated_test(), holdout.items(), list(holdout.cutoffs)),
        },
    )
    return {name: found[f"{path}/{name}"] for name in ("users", "items")}


__all__ = ["Holdout", "cached", "dense_index", "most_popular"]
