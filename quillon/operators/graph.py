"""Item similarities and graph propagation as joins and aggregates over coordinate tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranking import DIGITS, prefix_sums, top_k
from quillon.scratch import written


#: Cells of a user that meet as many others in one group.
PROFILE = 1024
#: Scores, before they are summed, of the users that one task is dealt.
DEALT = 10_000_000
#: Pairs of cells that one group of `walks` makes for its items, and that it holds at once.
WORK, HELD = 1 << 24, 1 << 21


def pairs(left: DataFrame, right: DataFrame, cells: DataFrame) -> DataFrame:
    """left (u, i, …) and right (u, j, …), which have one row for each of the cells, joined on u: all pairs of a user's cells.

    A profile of d cells has d squared pairs. Those of more than PROFILE cells are cut in chunks, and each chunk of one
    side meets each chunk of the other in a group of its own, so that a user who has every item is no single task.
    """
    heavy = cells.groupBy("u").agg(F.count("*").alias("_d")).where(F.col("_d") > PROFILE).select("u", F.ceil(F.col("_d") / PROFILE).cast("int").alias("_k"))

    def dealt(side: DataFrame, own: str, other: str, key: str) -> DataFrame:
        known = side.join(heavy, "u", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
        known = known.withColumn(own, F.pmod(F.xxhash64(F.col(key)), F.col("_k")).cast("int"))
        return known.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")

    if heavy.isEmpty():
        return left.join(right, "u")
    return dealt(left, "_l", "_r", "i").join(dealt(right, "_r", "_l", "j"), ["u", "_l", "_r"]).drop("_l", "_r")


def _walk(cells: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Transition weights from users to items (of the ratings) and from items to users (of the binary matrix)."""
    power = lambda c: c if alpha == 1 else F.pow(c, F.lit(alpha))
    users = cells.groupBy("u").agg(F.sum(F.abs("r")).alias("norm"))
    items = cells.groupBy("i").agg(F.count("*").alias("degree"))
    out = cells.join(users, "u").select("u", F.col("i").alias("j"), power(F.col("r") / F.col("norm")).alias("to_item"))
    back = cells.join(items, "i").select("i", "u", power(1.0 / F.col("degree")).alias("to_user"))
    return back, out


def _few(cells: DataFrame) -> bool:
    """Whether there are so few items that sums by pair of items, taken before the shuffle, are fewer than the cells."""
    tasks = max(8, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.select("i").distinct().count() ** 2 * tasks <= max(cells.count(), 1 << 20)


def _rows_of(i: pa.Array, block: np.ndarray, starts: np.ndarray, y: np.ndarray, own: int, k: int, alpha: float):
    """Batches of i, j, w of one block: profiles (the cells of user n from starts[n] on) that have items of the block.

    A row of the product is the sum of y over the profiles of its users. Rows are made a few at once, and of each only
    the k largest and what equals the last one at DIGITS digits stay.
    """
    coded = pc.dictionary_encode(i)
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(starts)
    user = np.repeat(np.arange(len(lengths)), lengths)
    mine = np.flatnonzero(block == own)
    mine = mine[np.argsort(code[mine], kind="stable")]
    rows, first, degree = np.unique(code[mine], return_index=True, return_counts=True)
    scale = np.repeat((1.0 / degree) ** alpha, degree)
    made = np.concatenate([[0], np.cumsum(lengths[user[mine]])])
    upto = made[np.append(first, len(mine))]
    at = 0
    while at < len(rows):
        end = min(max(at + 1, int(np.searchsorted(upto, upto[at] + HELD, "right")) - 1), at + (1 << 16))
        sums = []
        begin, last = int(first[at]), int(first[end - 1] + degree[end - 1])
        while begin < last:  # one row at most is made in several parts
            stop = min(last, max(begin + 1, int(np.searchsorted(made, made[begin] + HELD, "right")) - 1))
            some = mine[begin:stop]
            n = lengths[user[some]]
            place = np.arange(n.sum()) + np.repeat(starts[user[some]] - (np.cumsum(n) - n), n)
            key = np.repeat(np.searchsorted(rows, code[some]), n) * len(names) + code[place]
            order = np.argsort(key)
            key = key[order]
            cuts = np.flatnonzero(np.diff(key, prepend=-1))
            sums.append((key[cuts], np.add.reduceat((y[place] * np.repeat(scale[begin:stop], n))[order], cuts)))
            begin = stop
        key, w = (np.concatenate(x) for x in zip(*sums, strict=True))
        if len(sums) > 1:
            key, to = np.unique(key, return_inverse=True)
            w = np.bincount(to, w)
        row, j = np.divmod(key, len(names))
        other = (rows[row] != j) & (w != 0)
        row, j, w = row[other], j[other], w[other]
        order = np.argsort(-w)
        order = order[np.argsort((row[order] - at).astype(np.uint16), kind="stable")]
        row, j, w = row[order], j[order], w[order]
        heads = np.searchsorted(row, row)
        least = w[np.minimum(heads + k - 1, np.searchsorted(row, row, "right") - 1)]
        keep = w >= least - 2 * 10.0**-DIGITS
        yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[row[keep]])), names.take(pa.array(j[keep])), pa.array(w[keep])], names=["i", "j", "w"])
        at = end


def walks(out: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """i, j, w of out (u, j, to_item): the sum of to_item over the users of i, by the degree of i to the power alpha.

    Without zeros and i itself; of each i, the k largest (and ties) are there. Items are cut in blocks of about WORK pairs in
    the order of ids. A user's profile goes once to each block that it has an item of, and pairs are made and summed
    there, so that no pair is a row, and what is sent is less than the pairs by the items of a block that users share.
    """
    cells = written(out)
    degree = cells.groupBy("u").agg(F.count("*").alias("d"))
    work = cells.join(degree, "u").groupBy("j").agg(F.sum("d").alias("d"))
    blocks = written(prefix_sums(work, ["j"], "d").select("j", F.floor(F.col("before") / WORK).cast("int").alias("b")))
    n = (blocks.agg(F.max("b")).first()[0] or 0) + 1
    whole = cells.join(blocks, "j").groupBy("u").agg(F.collect_list(F.struct("j", "b", "to_item")).alias("c"), F.collect_set("b").alias("own"))
    sent = whole.select(F.explode("own").alias("own"), F.col("c.j").alias("i"), F.col("c.b").alias("b"), F.col("c.to_item").alias("y")).repartition(n, "own")
    kind = cells.schema["j"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        flat = lambda name: group[name].combine_chunks().flatten()
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(group["i"]).to_numpy())]).astype(np.int64)
        made = _rows_of(flat("i"), flat("b").to_numpy(), starts, flat("y").to_numpy(), group["own"][0].as_py(), k, alpha)
        return pa.Table.from_batches(list(made))

    return sent.groupBy("own").applyInArrow(run, f"i {kind}, j {kind}, w double")


def p3_alpha(cells: DataFrame, *, k: int = 100, alpha: float = 1.0, beta: float = 0.0, normalize: bool = False) -> DataFrame:
    """Random walks of three steps: (i, j, w), the k largest of each item, without zeros and itself.

    beta > 0 divides column j by its degree to the power beta (popularity-discounted walks). With few items, the self-join
    is on the user, heavy profiles in chunks, and products are summed before the shuffle by pair; with many, see `walks`.
    """
    used = written(cells.where("r <> 0"))
    back, out = _walk(used, alpha)
    if beta:
        degree = used.groupBy(F.col("i").alias("j")).agg(F.count("*").alias("d"))
        out = out.join(degree, "j").select("u", "j", (F.col("to_item") * F.pow(F.col("d"), F.lit(-beta))).alias("to_item"))
    if _few(used):
        w = pairs(back, out, used).where("i <> j").groupBy("i", "j").agg(F.sum(F.col("to_user") * F.col("to_item")).alias("w")).where("w <> 0")
    else:
        w = walks(out, k, alpha)
    best = top_k(w, "i", "w", "j", k).drop("pos")
    if normalize:
        best = best.withColumn("w", F.col("w") / F.sum(F.abs("w")).over(Window.partitionBy("i")))
    return best


def p3_alpha_symmetric(cells: DataFrame, *, k: int = 100) -> DataFrame:
    """The same walk for binary cells and alpha 1. C = Bt diag(1/d_u) B is symmetric, w = C_ij / d_i.

    Where few items make it worth while, half of C is summed by pair; else whole rows of it are made where they are used.
    """
    b = written(cells.where("r <> 0").select("u", "i"))
    half = b.join(b.groupBy("u").agg((1.0 / F.count("*")).alias("p")), "u")
    if not _few(b):
        return top_k(walks(half.select("u", F.col("i").alias("j"), F.col("p").alias("to_item")), k), "i", "w", "j", k).drop("pos")
    c = pairs(half, b.withColumnRenamed("i", "j"), b).where("i < j").groupBy("i", "j").agg(F.sum("p").alias("c"))
    both = c.union(c.select("j", "i", "c"))
    degree = b.groupBy("i").agg(F.count("*").alias("d"))
    return top_k(both.join(degree, "i").select("i", "j", (F.col("c") / F.col("d")).alias("w")), "i", "w", "j", k).drop("pos")


def item_knn(cells: DataFrame, *, k: int = 100, shrink: float = 0.0, normalize: bool = True) -> DataFrame:
    """Cosine similarity with shrinkage (dot / (norms' product + shrink)): (i, j, w), k largest of each item."""
    used = written(cells.where("r <> 0"))
    dots = pairs(used.select("u", "i", F.col("r").alias("a")), used.select("u", F.col("i").alias("j"), F.col("r").alias("b")), used).where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    norms = used.groupBy("i").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    full = dots.join(norms, "i").join(norms.select(F.col("i").alias("j"), F.col("norm").alias("norm_j")), "j")
    below = F.col("norm") * F.col("norm_j") + F.lit(shrink) if normalize else F.lit(shrink if shrink else 1.0)
    half = full.select("i", "j", (F.col("dot") / below).alias("w"))
    return top_k(half.union(half.select("j", "i", "w")).where("w <> 0"), "i", "w", "j", k).drop("pos")


def score(cells: DataFrame, similarity: DataFrame) -> DataFrame:
    """u, j, score: the sum of r * w over the items of the user's profile. Only items that can be reached have a row."""
    return cells.join(similarity, "i").groupBy("u", "j").agg(F.sum(F.col("r") * F.col("w")).alias("score"))


def recommend(scores: DataFrame, seen: DataFrame, k: int, *, ignored: DataFrame | None = None) -> DataFrame:
    """user_id, item_id, pos, score of the k best unseen items that are not ignored."""
    fresh = scores.join(seen.select("u", F.col("i").alias("j")), ["u", "j"], "left_anti")
    if ignored is not None:
        fresh = fresh.join(ignored.select(F.col("item_id").alias("j")), "j", "left_anti")
    return top_k(fresh, "u", "score", "j", k).select(F.col("u").alias("user_id"), F.col("j").alias("item_id"), "pos", "score")


def recommend_from(cells: DataFrame, similarity: DataFrame, k: int) -> DataFrame:
    """What `recommend` gives for the scores of the cells by the similarity, with the cells as seen.

    Cells are dealt by user to tasks of about DEALT scores, and all that follows stays there: a seen item is a row of its
    own among those that are summed, so no scores are dealt again or joined with the cells.
    """
    own = cells.select(F.col("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))
    near = written(similarity.select("i", "j", F.col("w").cast("double").alias("w"), F.lit(False).alias("own")).unionByName(own))
    items = own.count()
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() * max(1, near.count() // max(1, items)) // DEALT))
    scored = cells.repartition(parts, "u").join(near, "i").groupBy("u", "j").agg(F.sum(F.col("r") * F.col("w")).alias("score"), F.bool_or("own").alias("own")).where("not own")
    return top_k(scored, "u", "score", "j", k).select(F.col("u").alias("user_id"), F.col("j").alias("item_id"), "pos", "score")


def normalized_adjacency(cells: DataFrame) -> DataFrame:
    """src, dst, norm of the bipartite graph: users keep their number as 'u', items as 'i' nodes (kind, id)."""
    b = cells.where("r <> 0").select("u", "i").distinct()
    du, di = b.groupBy("u").agg(F.count("*").alias("du")), b.groupBy("i").agg(F.count("*").alias("di"))
    e = b.join(du, "u").join(di, "i").select(F.concat(F.lit("u"), "u").alias("src"), F.concat(F.lit("i"), "i").alias("dst"), (1.0 / F.sqrt(F.col("du").cast("double") * F.col("di"))).alias("norm"))
    return e.union(e.select("dst", "src", "norm"))


def slot_sums(width: int, weight: Column, vector: str) -> Column:
    """A vector of weighted sums; one aggregate a slot keeps the sums in generated code."""
    return F.array(*[F.sum(weight * F.col(vector)[k]) for k in range(width)])


def propagate(adjacency: DataFrame, vectors: DataFrame, layers: int, width: int) -> DataFrame:
    """id, vector: the mean of the vectors after 0 to `layers` steps over the graph. Nodes without neighbours get zeros."""
    steps = [vectors.select("id", F.col("vector").alias("v0"))]
    current = vectors
    zero = F.array(*[F.lit(0.0)] * width)
    for n in range(1, layers + 1):
        summed = adjacency.join(current.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(slot_sums(width, F.col("norm"), "vector").alias("vector"))
        current = vectors.select("id").join(summed, "id", "left").select("id", F.coalesce("vector", zero).alias("vector"))
        steps.append(current.withColumnRenamed("vector", f"v{n}"))
    joined = reduce(lambda a, b: a.join(b, "id"), steps)
    return joined.select("id", F.array(*[reduce(lambda a, b: a + b, [F.col(f"v{n}")[k] for n in range(layers + 1)]) / (layers + 1) for k in range(width)]).alias("vector"))
