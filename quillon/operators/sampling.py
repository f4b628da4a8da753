"""Seeded samples of cells: positives, negatives, and triples for pairwise training.

Every draw is the hash of its number, so a sample does not depend on partitioning and can be made again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import dense_index, prefix_sums
from quillon.scratch import written

TRIES = 20
#: Tries that are made at once, from and to: most draws find a free cell at the first, and only the others go on.
ROUNDS = ((1, 1), (2, 4), (5, 10), (11, TRIES))


def _number(*parts) -> Column:
    """60 bits of the MD5 digest of the parts joined by colons, which any SQL engine can make again."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 15), 16, 10).cast("bigint")


def _numbered(cells: DataFrame) -> DataFrame:
    """Cells with a dense number n, in the order of user and item."""
    return prefix_sums(cells, ["u", "i"], name="n")


def stored(cells: DataFrame) -> int:
    """The number of stored cells: what an epoch of training draws."""
    return cells.where("r <> 0").count()


def positives(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement of stored cells: draw, u, i, r."""
    stored = cells.where("r <> 0")
    total = stored.count()
    if not total:
        raise ValueError("no cell to draw from")
    draws = cells.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("n", _number(seed, "p", F.col("draw")) % total)
    return draws.join(_numbered(stored).hint("merge"), "n").select("draw", "u", "i", "r")


def _first_free(left: DataFrame, drawn: Callable[[DataFrame], DataFrame], seen: DataFrame, key: list[str], kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of each draw in left, the first of TRIES candidates that is not seen: draws with key, and those that found none.

    drawn: adds the candidates' key to the rows of a draw and a try t. kept: columns of the draw that go on with it. Tables of
    the size of the log are joined by sorting, and never sent to the driver.
    """
    got, seen = [], seen.select(*key, F.lit(True).alias("_taken"))
    for begin, end in ROUNDS:
        tries = left.withColumn("t", F.lit(begin) if begin == end else F.explode(F.sequence(F.lit(begin), F.lit(end))))
        tried = drawn(tries).join(seen.hint("merge"), key, "left").withColumn("_x", F.when(F.col("_taken").isNull(), F.struct("t", *key)))
        if begin < end:
            tried = tried.groupBy("draw").agg(F.min("_x").alias("_x"), *[F.any_value(c).alias(c) for c in kept])
        tried = written(tried.select("draw", *kept, "_x"))
        got.append(tried.where("_x is not null").select("draw", *[c for c in kept if c not in key], *[f"_x.{c}" for c in key]))
        left = tried.where("_x is null").select("draw", *kept)
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, got), left


def negatives(cells: DataFrame, users: DataFrame, items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws of cells that are not stored, uniform over users and items of the dimensions (u) and (i): draw, u, i, r = 0.

    Each draw makes TRIES candidates and takes the first free one; draws that find none (a user who has nearly all
    items) are made again with other numbers until all are filled. A full matrix raises.
    """
    spark = cells.sparkSession
    nu, ni = users.count(), items.count()
    stored = written(cells.select("u", "i").distinct())
    if stored.count() >= nu * ni:
        raise ValueError("no cell is free")
    by_u, by_i = (written(dense_index(of.select(c).distinct(), c).withColumnRenamed("idx", to)) for of, c, to in ((users, "u", "a"), (items, "i", "b")))
    left, found, turn = spark.range(n).withColumnRenamed("id", "draw"), None, 0
    while True:
        pick = lambda k, size: _number(seed, turn, k, F.col("draw"), F.col("t")) % size  # noqa: B023, E731
        drawn = lambda tries: tries.withColumn("a", pick("u", nu)).withColumn("b", pick("i", ni)).join(by_u, "a").join(by_i, "b")  # noqa: B023, E731
        got, left = _first_free(left, drawn, stored, ["u", "i"], [])
        got = got.select("draw", "u", "i", F.lit(0.0).alias("r"))
        found = got if found is None else found.unionByName(got)
        turn += 1
        if left.isEmpty():
            return found


def mixed(cells: DataFrame, users: DataFrame, items: DataFrame, n: int, negative: float, seed: int = 0) -> DataFrame:
    """floor(n * negative) negatives and the rest positives, in hashed order of draw."""
    k = int(n * negative)
    parts = []
    if n - k:
        parts.append(positives(cells, n - k, seed))
    if k:
        parts.append(negatives(cells, users, items, k, seed).withColumn("draw", F.col("draw") + n - k))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def triples(cells: DataFrame, items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """u, i (seen), j (unseen): positives with the first free of TRIES drawn items.

    Positives that find none draw from the list of their user's free items; only users who have seen every item are
    left out.
    """
    ni = items.count()
    by_i = written(dense_index(items.select("i").distinct(), "i").select(F.col("i").alias("j"), F.col("idx").alias("b")))
    seen = written(cells.select("u", F.col("i").alias("j")))
    p = written(positives(cells, n, seed).select("draw", "u", "i"))
    drawn = lambda tries: tries.withColumn("b", _number(seed, "n", F.col("draw"), F.col("t")) % ni).join(by_i, "b")
    got, left = _first_free(p, drawn, seen, ["u", "j"], ["u", "i"])
    if left.isEmpty():
        return got.select("u", "i", "j")
    rest = left.select("u").distinct().crossJoin(by_i.select("j")).join(seen, ["u", "j"], "left_anti")
    last = left.join(rest, "u").groupBy("draw").agg(F.min(F.struct(_number(seed, "last", F.col("draw"), F.col("j")), "u", "i", "j")).alias("x")).select("x.u", "x.i", "x.j")
    return got.select("u", "i", "j").union(last)
