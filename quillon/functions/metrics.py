"""Accuracy and beyond-accuracy metrics as aggregates over recommendation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_USER = ("precision", "recall", "map", "ndcg", "mrr", "hit_rate", "arhr", "f1", "novelty", "position_first_relevant")


def log2(x) -> F.Column:
    return F.log2(x)


def judged(recs: DataFrame, test: DataFrame) -> DataFrame:
    """recs (user_id, item_id, pos) with rel, the relevance of the item for the user, 0 if it isn't in test.

    test: user_id, item_id, r, one row a cell.
    """
    t = test.select("user_id", "item_id", F.col("r").alias("rel"))
    return recs.join(t, ["user_id", "item_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))


def per_user(recs: DataFrame, test: DataFrame, popularity: DataFrame, n_items: int, cutoffs: list[int]) -> DataFrame:
    """A row per evaluated user and cutoff; evaluated users are those of test, with or without a list.

    popularity: item_id, n of the training cells. Precision and average precision divide by the list's own length.
    """
    cuts = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    by_pos = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("rel") > 0).cast("int")
    total = popularity.agg(F.sum("n").alias("nnz"))
    known = judged(recs, test).join(popularity, "item_id", "left").crossJoin(F.broadcast(total))
    scored = known.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(by_pos)).withColumn("info", F.when(F.col("n") > 0, -log2(F.col("n") / F.col("nnz"))).otherwise(0.0))
    gain = lambda r, p: (F.pow(F.lit(2.0), r) - 1.0) / log2(p + F.lit(1.0))
    lists = (
        scored.select("*", cuts).where("pos <= cutoff").groupBy("user_id", "cutoff").agg(
            F.count("*").alias("n_list"), F.sum("hit").alias("n_hit"), F.sum(F.col("hit") * F.col("hits") / F.col("pos")).alias("ap"), F.sum(gain(F.col("rel"), F.col("pos"))).alias("dcg"),
            F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"), F.sum(F.col("hit") / F.col("pos")).alias("arhr"), F.sum("info").alias("info"),
        )
    )
    best = Window.partitionBy("user_id").orderBy(F.col("r").desc(), "item_id")
    ideal = test.withColumn("p", F.row_number().over(best)).select("*", cuts).groupBy("user_id", "cutoff").agg(F.count("*").alias("n_pos"), F.sum(F.when(F.col("p") <= F.col("cutoff"), gain(F.col("r"), F.col("p")))).alias("idcg"))
    both = ideal.join(lists, ["user_id", "cutoff"], "left").fillna(0, ["n_list", "n_hit", "ap", "dcg", "arhr", "info"])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = both.withColumn("precision", safe(F.col("n_hit").cast("double"), F.col("n_list"))).withColumn("recall", safe(F.col("n_hit").cast("double"), F.col("n_pos")))
    return out.select(
        "user_id", "cutoff", "precision", "recall", safe(F.col("ap"), F.col("n_list")).alias("map"), safe(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("n_hit") > 0).cast("int").alias("hit_rate"), F.col("arhr").cast("double").alias("arhr"),
        safe(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), (F.col("info") / n_items).alias("novelty"),
        F.coalesce(F.col("cutoff") - F.col("first") + 1, F.lit(0)).cast("int").alias("position_first_relevant"), (F.col("n_list") > 0).cast("int").alias("covered"),
    )


def item_counts(recs: DataFrame, test: DataFrame, items: DataFrame, cutoffs: list[int]) -> DataFrame:
    """cutoff, item_id, n_rec, n_rec_relevant of every item of the dimension, zeros included."""
    cuts = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    counts = judged(recs, test).select("*", cuts).where("pos <= cutoff").groupBy("cutoff", "item_id").agg(F.count("*").alias("n_rec"), F.count_if(F.expr("rel > 0")).alias("n_rec_relevant"))
    return items.select("item_id").distinct().select("item_id", cuts).join(counts, ["cutoff", "item_id"], "left").fillna(0, ["n_rec", "n_rec_relevant"])


def diversity(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """coverage, gini diversity (high is diverse), Herfindahl and Shannon entropy of item counts.

    The Gini sum runs over the histogram of counts, so no window holds all items.
    """
    per = counts.groupBy(*by, F.col(value).alias("c")).agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by).orderBy("c")
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*by)
    ranked = per.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2.0).withColumn("k", F.sum("m").over(whole)).withColumn("s", F.sum(F.col("m") * F.col("c")).over(whole))
    share = F.try_divide(F.col("c").cast("double"), F.col("s"))
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).cast("double"), F.max("k")).alias("coverage_item"),
        (2.0 * F.sum((F.col("m") * (F.col("k") + 1) - F.col("ranks")) / (F.col("k") + 1) * share)).alias("diversity_gini"),
        (1.0 - F.sum(F.col("m") * share * share)).alias("diversity_herfindahl"),
        F.sum(F.when(F.col("c") > 0, -F.col("m") * share * log2(share)).otherwise(0.0)).alias("shannon_entropy"),
    )


def mean_metrics(users: DataFrame, n_users: int) -> DataFrame:
    """Means over evaluated users by cutoff; F1 of the mean precision and recall (f1) and the mean of F1 (f1_mean).

    coverage_user and coverage_user_hit divide by all users.
    """
    aggs = [F.avg(m).alias(m) for m in PER_USER if m != "f1"] + [F.avg("f1").alias("f1_mean")]
    out = users.groupBy("cutoff").agg(*aggs, (F.sum("covered") / n_users).alias("coverage_user"), (F.sum("hit_rate") / n_users).alias("coverage_user_hit"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def train_novelty(train: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """The mean novelty of all users' training profiles: one row."""
    pop = train.groupBy("item_id").agg(F.count("*").alias("n"))
    # a profile's novelty is a sum over its cells, so the mean needs only each item's count
    info = pop.crossJoin(F.broadcast(pop.agg(F.sum("n").alias("nnz")))).agg(F.sum(-F.col("n") * log2(F.col("n") / F.col("nnz"))).alias("info"))
    return info.select((F.col("info") / n_items / n_users).alias("novelty_train"))
