"""Latent-factor and linear models: training loops over partitions, scoring by expressions.

Training draws and updates are deterministic for a seed: every draw is a hash of its number. Gradients are summed by
id, so an epoch is a few joins and aggregates whatever the size; factors are written out between epochs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import normalized_adjacency, pairs, propagate
from quillon.operators.ranking import top_k
from quillon.scratch import written

#: The most users and items that meet at once in a task.
USERS, ITEMS = 16384, 16384
#: The first columns of scores, which give each row a least score; every further part is as long as all before it.
PART = 256


@dataclass
class Optimizer:
    """Gradient steps by their published formulas: sgd, adagrad, rmsprop, adam.

    `step` keeps its moments for numpy arrays; `columns` gives the same steps as expressions over moments that the table
    of parameters keeps in the columns m and v.
    """

    kind: str = "sgd"
    rate: float = 0.01
    decay: float = 0.9
    second: float = 0.999
    small: float = 1e-8

    def __post_init__(self):
        if self.kind not in ("sgd", "adagrad", "rmsprop", "adam"):
            raise ValueError("kind is sgd, adagrad, rmsprop or adam")
        self.state: dict[str, np.ndarray] = {}
        self.turn = 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        """What to add to the parameters to follow the gradient upwards."""
        g, s = np.asarray(gradient, float), self.state
        self.turn += 1
        if self.kind == "sgd":
            return self.rate * g
        zero = np.zeros_like(g)
        if self.kind == "adagrad":
            s["v"] = s.get("v", zero) + g * g
            return self.rate * g / (np.sqrt(s["v"]) + self.small)
        if self.kind == "rmsprop":
            s["v"] = self.decay * s.get("v", zero) + (1 - self.decay) * g * g
            return self.rate * g / (np.sqrt(s["v"]) + self.small)
        s["m"] = self.decay * s.get("m", zero) + (1 - self.decay) * g
        s["v"] = self.second * s.get("v", zero) + (1 - self.second) * g * g
        return self.rate * (s["m"] / (1 - self.decay**self.turn)) / (np.sqrt(s["v"] / (1 - self.second**self.turn)) + self.small)

    def columns(self, gradient: Column, m: Column, v: Column, turn: int) -> tuple[Column, Column, Column]:
        """The step, the new m and the new v of one parameter in its turn-th step (from 1)."""
        g = gradient
        if self.kind == "sgd":
            return self.rate * g, m, v
        if self.kind == "adam":
            m, v = self.decay * m + (1 - self.decay) * g, self.second * v + (1 - self.second) * g * g
            return self.rate * (m / (1 - self.decay**turn)) / (F.sqrt(v / (1 - self.second**turn)) + self.small), m, v
        v = v + g * g if self.kind == "adagrad" else self.decay * v + (1 - self.decay) * g * g
        return self.rate * g / (F.sqrt(v) + self.small), m, v


@dataclass(frozen=True)
class Factors:
    users: DataFrame  # id, factors, bias
    items: DataFrame
    mean: float = 0.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def initial(ids: DataFrame, width: int, *, mean: float = 0.0, std: float = 0.1, seed: int = 0) -> DataFrame:
    """id, factors, bias 0: normal numbers from hashes of (seed, id, slot), by Box and Muller."""
    unit = lambda *k: (F.xxhash64(F.lit(seed), "id", *map(F.lit, k)).cast("double") / float(1 << 64)) + 0.5
    normal = lambda k: F.sqrt(-2.0 * F.log(F.greatest(unit(k, 1), F.lit(1e-12)))) * F.cos(unit(k, 2) * 2 * np.pi)
    return ids.select("id", F.array(*[normal(k) * std + mean for k in range(width)]).alias("factors"), F.lit(0.0).alias("bias"))


def _moments(table: DataFrame, width: int) -> DataFrame:
    """The table with the moments m and v of its factors and bias, zero at first."""
    zeros = F.array(*[F.lit(0.0)] * (width + 1))
    return table.withColumn("m", zeros).withColumn("v", zeros)


def _stepped(table: DataFrame, grads: DataFrame, optimizer: Optimizer, turn: int, width: int) -> DataFrame:
    """Factors and biases moved by the mean gradient g (the bias's last) of each id; ids without gradient stay."""
    joined = table.join(grads, "id", "left")
    was = [F.col("factors")[k] for k in range(width)] + [F.col("bias")]
    moved = [optimizer.columns(F.col("g")[k], F.col("m")[k], F.col("v")[k], turn) for k in range(width + 1)]
    new = [w + F.coalesce(step, F.lit(0.0)) for w, (step, _, _) in zip(was, moved, strict=True)]
    moments = [F.array(*[F.coalesce(parts[at], F.col(name)[k]) for k, parts in enumerate(moved)]).alias(name) for at, name in ((1, "m"), (2, "v"))]
    return joined.select("id", F.array(*new[:width]).alias("factors"), new[width].alias("bias"), *moments)


def _mean_vector(width: int, name: str) -> Column:
    return F.array(*[F.avg(F.col(name)[k]) for k in range(width)])


def _parts(samples: DataFrame, batches: int, *key: str) -> list[DataFrame]:
    """An epoch's samples, written, as a number of batches."""
    drawn = written(samples)
    return [drawn] if batches == 1 else [drawn.where(F.pmod(F.xxhash64(*key), F.lit(batches)) == n) for n in range(batches)]


def _epochs(model, epochs: int, epoch_of: Callable, checked: Callable | None, patience: int | None):
    """The model after its epochs; with checked, the best one seen, and the end after `patience` epochs without a better one."""
    best, best_score, waited = model, float("-inf"), 0
    for epoch in range(epochs):
        model = epoch_of(model, epoch)
        if checked is not None:
            score = checked(model)
            best, best_score, waited = (model, score, 0) if score > best_score else (best, best_score, waited + 1)
            if patience is not None and waited >= patience:
                break
    return best if checked is not None and epochs else model


def fit_mf(
    samples: Callable[[int], DataFrame], ids: tuple[DataFrame, DataFrame], *, width: int = 16, epochs: int = 5, rate: float = 0.05, reg: float = 0.01, seed: int = 0,
    optimizer: str = "sgd", batches: int = 1, patience: int | None = None, checked: Callable[[Factors], float] | None = None,
) -> Factors:
    """Biased matrix factorisation by gradient steps on samples(epoch): u, i, r.

    checked: a score to maximise after each epoch; the best factors are kept, and `patience` epochs without a better
    one end the training. batches: steps an epoch.
    """
    first = written(samples(0))
    mean = first.agg(F.avg("r")).first()[0] or 0.0
    method = Optimizer(optimizer, rate)

    def epoch_of(model: Factors, epoch: int) -> Factors:
        for n, s in enumerate(_parts(first if epoch == 0 else samples(epoch), batches, "u", "i")):
            turn = epoch * batches + n + 1
            u, i = model.users.select(F.col("id").alias("u"), F.col("factors").alias("p"), F.col("bias").alias("bu")), model.items.select(F.col("id").alias("i"), F.col("factors").alias("q"), F.col("bias").alias("bi"))
            e = s.join(u, "u").join(i, "i").withColumn("err", F.col("r") - (mean + F.col("bu") + F.col("bi") + dot(F.col("p"), F.col("q"))))
            e = written(e)

            def grad(key: str, own: str, other: str, bias: str, e=e) -> DataFrame:
                slots = [F.avg(F.col("err") * F.col(other)[k] - reg * F.col(own)[k]) for k in range(width)]
                return e.groupBy(F.col(key).alias("id")).agg(F.array(*slots, F.avg(F.col("err") - reg * F.col(bias))).alias("g"))

            model = replace(model, users=written(_stepped(model.users, grad("u", "p", "q", "bu"), method, turn, width)), items=written(_stepped(model.items, grad("i", "q", "p", "bi"), method, turn, width)))
        return model

    start = Factors(_moments(initial(ids[0], width, seed=seed), width), _moments(initial(ids[1], width, seed=seed + 1), width), mean)
    return _epochs(start, epochs, epoch_of, checked, patience)


def fit_bpr(
    triples: Callable[[int], DataFrame], ids: tuple[DataFrame, DataFrame], *, width: int = 16, epochs: int = 5, rate: float = 0.1, reg: float = 0.01, seed: int = 0,
    optimizer: str = "sgd", batches: int = 1, dropout: float = 0.0, patience: int | None = None, checked: Callable[[Factors], float] | None = None,
) -> Factors:
    """Pairwise ranking on triples(epoch): u, i (seen), j (unseen).

    dropout: the share of slots that a step leaves out, by the digest of the step and the slot; the others weigh more.
    """
    method = Optimizer(optimizer, rate)

    def epoch_of(model: Factors, epoch: int) -> Factors:
        for n, t in enumerate(_parts(triples(epoch), batches, "u", "i", "j")):
            turn = epoch * batches + n + 1
            kept = _kept_slots(width, dropout, seed, turn)
            name = lambda table, key, f: table.select(F.col("id").alias(key), F.col("factors").alias(f))
            e = t.join(name(model.users, "u", "p"), "u").join(name(model.items, "i", "qi"), "i").join(name(model.items, "j", "qj"), "j")
            x = sum((F.col("p")[k] * (F.col("qi")[k] - F.col("qj")[k]) * w for k, w in enumerate(kept) if w), F.lit(0.0))
            e = written(e.withColumn("s", 1.0 / (1.0 + F.exp(x))))
            s, p, qi, qj = F.col("s"), F.col("p"), F.col("qi"), F.col("qj")
            slots = lambda of: F.array(*[of(k, w) if w else F.lit(0.0) for k, w in enumerate(kept)], F.lit(0.0)).alias("g")
            gu = e.select(F.col("u").alias("id"), slots(lambda k, w: s * w * (qi[k] - qj[k]) - reg * p[k]))  # noqa: B023
            gi = e.select(F.col("i").alias("id"), slots(lambda k, w: s * w * p[k] - reg * qi[k]))  # noqa: B023
            gj = e.select(F.col("j").alias("id"), slots(lambda k, w: -s * w * p[k] - reg * qj[k]))  # noqa: B023
            mean = lambda g: g.groupBy("id").agg(_mean_vector(width + 1, "g").alias("g"))
            model = replace(model, users=written(_stepped(model.users, mean(gu), method, turn, width)), items=written(_stepped(model.items, mean(gi.union(gj)), method, turn, width)))
        return model

    start = Factors(_moments(initial(ids[0], width, seed=seed), width), _moments(initial(ids[1], width, seed=seed + 1), width))
    return _epochs(start, epochs, epoch_of, checked, patience)


def _kept_slots(width: int, dropout: float, seed: int, turn: int) -> list[float]:
    """The weight of each slot in a step: 0 for those dropped."""
    if not 0 <= dropout < 1:
        raise ValueError("dropout lies between 0 and 1")
    if not dropout:
        return [1.0] * width
    dice = np.random.Generator(np.random.PCG64([seed, turn]))
    return (np.where(dice.random(width) < dropout, 0.0, 1 / (1 - dropout))).tolist()


def fit_lightgcn(
    cells: DataFrame, triples: Callable[[int], DataFrame], *, width: int = 8, layers: int = 2, epochs: int = 3, rate: float = 0.5, reg: float = 1e-4, seed: int = 0,
    optimizer: str = "sgd", batches: int = 1, dropout: float = 0.0, patience: int | None = None, checked: Callable[[DataFrame], float] | None = None,
) -> DataFrame:
    """id ('u…', 'i…'), vector after propagation, trained on pairwise loss.

    The graph matrix A is symmetric, so the gradient of the first layer is the mean of A^k times the gradient at the
    propagated vectors: the same propagation runs backwards. dropout: the share of edges that a step leaves out, by
    digest, the same ones in both directions; checked is given the propagated vectors.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout lies between 0 and 1")
    graph = written(normalized_adjacency(cells))
    nodes = graph.select(F.col("src").alias("id")).distinct()
    method = Optimizer(optimizer, rate)

    def epoch_of(base: DataFrame, epoch: int) -> DataFrame:
        for n, part in enumerate(_parts(triples(epoch), batches, "u", "i", "j")):
            turn, edges = epoch * batches + n + 1, graph
            if dropout:
                unit = F.xxhash64(F.lit(seed), F.lit(turn), F.least("src", "dst"), F.greatest("src", "dst")).cast("double") / float(1 << 64) + 0.5
                edges = graph.where(unit >= dropout).withColumn("norm", F.col("norm") / (1 - dropout))
            now = written(propagate(edges, base.select("id", F.col("factors").alias("vector")), layers, width))
            t = part.select(F.concat(F.lit("u"), "u").alias("u"), F.concat(F.lit("i"), "i").alias("i"), F.concat(F.lit("i"), "j").alias("j"))
            name = lambda key, v: now.select(F.col("id").alias(key), F.col("vector").alias(v))  # noqa: B023, E731
            e = t.join(name("u", "p"), "u").join(name("i", "qi"), "i").join(name("j", "qj"), "j")
            e = e.withColumn("d", F.zip_with("qi", "qj", lambda x, y: x - y)).withColumn("s", 1.0 / (1.0 + F.exp(dot(F.col("p"), F.col("d")))))
            parts = [e.select(F.col(k).alias("id"), F.transform(v, lambda x, sign=sign: sign * F.col("s") * x).alias("g")) for k, v, sign in (("u", "d", 1.0), ("i", "p", 1.0), ("j", "p", -1.0))]
            at_top = parts[0].union(parts[1]).union(parts[2]).groupBy("id").agg(_mean_vector(width, "g").alias("vector"))
            zero = F.array(*[F.lit(0.0)] * width)
            full = nodes.join(at_top, "id", "left").select("id", F.coalesce("vector", zero).alias("vector"))
            back = propagate(edges, full, layers, width)
            with_base = back.join(base.select("id", "factors"), "id").select("id", F.array(*[F.col("vector")[k] - reg * F.col("factors")[k] for k in range(width)], F.lit(0.0)).alias("g"))
            base = written(_stepped(base, with_base, method, turn, width))
        return base

    final = lambda base: propagate(graph, base.select("id", F.col("factors").alias("vector")), layers, width)
    start = written(_moments(initial(nodes, width, seed=seed), width))
    return final(_epochs(start, epochs, epoch_of, None if checked is None else lambda base: checked(final(base)), patience))


def _best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row, at 12 digits and of equal ones the lower columns; what isn't finite is left out.

    The first columns give each row a least score, which rises with every further part. Only what reaches it is looked at
    again, so that nearly all scores are compared once and neither rounded nor sorted.
    """
    kept_r, kept_c, kept_s, least = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.full(len(scores), -np.inf)]
    at, end = 0, PART
    while at < scores.shape[1]:
        part = scores[:, at:end]
        if not at and k < part.shape[1]:
            least = np.partition(np.where(np.isfinite(part), part, -np.inf), -k, axis=1)[:, -k]
        margin = 1e-11 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
        r, c = np.divmod(np.flatnonzero(part >= (least - margin)[:, None]), part.shape[1])
        s = np.round(part[r, c], 12)
        good = np.isfinite(s)
        r, c, s = (np.concatenate(x) for x in ((kept_r, r[good]), (kept_c, c[good] + at), (kept_s, s[good])))
        order = np.argsort(-s, kind="stable")  # kept ones come first, and their columns are lower
        order = order[np.argsort(r[order], kind="stable")]
        r, c, s = r[order], c[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        least[r[place == k - 1]] = s[place == k - 1]
        kept_r, kept_c, kept_s = (x[place < k] for x in (r, c, s))
        at, end = end, 2 * end
    return kept_r, kept_c


def recommend(model: Factors, seen: DataFrame, k: int) -> DataFrame:
    """The k best unseen items of each user by factors and biases.

    Users and items are grouped in blocks, and each block of users meets each block of items: scores are one matrix
    product, of which only the k best of each user survive. Every user meets every item, which is what the model
    defines; no pair is a row.
    """
    taken = seen.groupBy("u").agg(F.collect_list("i").alias("taken"))
    users = model.users.join(taken, F.col("id") == F.col("u"), "left").select("id", "factors", "taken")

    def blocks(side: DataFrame, n: int, rows: int, least: int, name: str) -> DataFrame:
        parts = max(least, -(-n // rows))
        dealt = side.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition(parts, "block")
        return dealt.groupBy("block").agg(F.collect_list(F.struct(*side.columns)).alias(name)).select(name)

    paired = blocks(users, model.users.count(), USERS, 16, "users").crossJoin(blocks(model.items.select("id", "factors", "bias"), model.items.count(), ITEMS, 1, "items"))
    kind = model.users.schema["id"].dataType.simpleString()
    plain = lambda a: a.to_numpy(zero_copy_only=False)

    def best(batches):
        for b in batches:
            for people, things in zip(b["users"], b["items"], strict=True):
                people, things = people.values, things.values
                things = things.take(pa.compute.sort_indices(things.field("id")))  # ties go to the lower id
                names, width = things.field("id"), len(things.field("factors")[0])
                q, bias = plain(things.field("factors").flatten()).reshape(-1, width), plain(things.field("bias"))
                room = np.empty((256, len(names)))  # used again: new memory costs more than the product
                for at in range(0, len(people), 256):
                    some = people.slice(at, 256)
                    scores = np.matmul(plain(some.field("factors").flatten()).reshape(-1, width), q.T, out=room[: len(some)])
                    if bias.any():
                        scores += bias
                    known = some.field("taken")
                    row = np.repeat(np.arange(len(some)), plain(pa.compute.fill_null(pa.compute.list_value_length(known), 0)))
                    col = pa.compute.index_in(known.flatten(), value_set=names)
                    hit = plain(col.is_valid())
                    scores[row[hit], plain(col.drop_null())] = -np.inf
                    r, c = _best_columns(scores, k)
                    yield pa.RecordBatch.from_arrays([some.field("id").take(pa.array(r)), names.take(pa.array(c)), pa.array(scores[r, c])], names=["u", "j", "score"])

    found = paired.mapInArrow(best, f"u {kind}, j {model.items.schema['id'].dataType.simpleString()}, score double")
    return top_k(found, "u", "score", "j", k).select(F.col("u").alias("user_id"), F.col("j").alias("item_id"), "pos", "score")


def slim_elastic_net(cells: DataFrame, *, k: int = 100, l1_ratio: float = 0.1, alpha: float = 1e-3, candidates: int = 200, sweeps: int = 1000) -> DataFrame:
    """(i, j, w): each target j is regressed on all other items with non-negative weights, of which the k largest stay.

    A target starts with its `candidates` most co-occurring items. Coordinate descent runs on their Gram matrix in one
    group a target; then every item left out is held to the optimality condition (its correlation with the rest is at
    most the l1 penalty), and the up to `candidates` that break it most join the target's items. Targets without such
    items are done, so the weights are those of the regression on all items.
    """
    used = written(cells.where("r <> 0"))
    n = used.select("u").distinct().count()
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    left, right = used.select("u", "i", F.col("r").alias("x")), used.select("u", F.col("i").alias("j"), F.col("r").alias("y"))
    pair = written(pairs(left, right, used).groupBy(F.col("i").alias("a"), F.col("j").alias("b")).agg(F.sum(F.col("x") * F.col("y")).alias("g")))
    kind = cells.schema["i"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        a, b = group["a"].to_numpy(), group["b"].to_numpy()
        names, at = np.unique(a, return_inverse=True)
        g = np.zeros((len(names), len(names)))
        g[at, np.searchsorted(names, b)] = group["g"].to_numpy()
        c = np.zeros(len(names))
        c[at] = group["c"].to_numpy()
        w = np.zeros(len(names))
        for _ in range(sweeps):
            was = w.copy()
            for m in range(len(names)):
                w[m] = max(0.0, c[m] - g[m] @ w + g[m, m] * w[m] - l1) / (g[m, m] + l2)
            if np.abs(w - was).max(initial=0) < 1e-7:
                break
        keep = np.flatnonzero(w)
        return pa.table({"i": pa.array(names[keep], group.schema.field("a").type), "j": pa.array([group["j"][0].as_py()] * len(keep), group.schema.field("j").type), "w": w[keep]})

    with_target = pair.where("a <> b").select(F.col("b").alias("j"), F.col("a").alias("i"), F.col("g").alias("c"))
    near = written(top_k(with_target, "j", "c", "i", candidates).select("j", "i", "c"))
    open_, done = near, None
    while True:
        gram = open_.select("j", F.col("i").alias("a"), "c").join(open_.select("j", F.col("i").alias("b")), "j").join(pair, ["a", "b"], "left").select("j", "a", "b", "c", F.coalesce("g", F.lit(0.0)).alias("g"))
        w = written(gram.groupBy("j").applyInArrow(solve, f"i {kind}, j {kind}, w double"))
        taken = w.join(pair.select(F.col("b").alias("i"), "a", "g"), "i").groupBy("j", F.col("a").alias("i")).agg(F.sum(F.col("g") * F.col("w")).alias("taken"))
        # items without a common user come in as well, where values below 0 tie them to the target
        left = with_target.join(open_.select("j").distinct(), "j", "left_semi").join(taken, ["j", "i"], "full").where("i <> j").join(open_, ["j", "i"], "left_anti")
        left = left.select("j", "i", F.coalesce("c", F.lit(0.0)).alias("c"), (F.coalesce("c", F.lit(0.0)) - F.coalesce("taken", F.lit(0.0)) - l1).alias("over"))
        more = written(top_k(left.where(F.col("over") > l1 * 1e-6 + 1e-9), "j", "over", "i", candidates).select("j", "i", "c"))
        again = more.select("j").distinct()
        settled = w.join(again, "j", "left_anti")
        done = settled if done is None else done.union(settled)
        if more.isEmpty():
            return top_k(done, "j", "w", "i", k).drop("pos").select("i", "j", "w")
        open_ = written(open_.join(again, "j", "left_semi").union(more))


def slim_bpr(
    cells: DataFrame, triples: Callable[[int], DataFrame], *, epochs: int = 3, rate: float = 0.05, reg: float = 1e-3, k: int = 100,
    symmetric: bool = False, optimizer: str = "sgd", batches: int = 1, patience: int | None = None, checked: Callable[[DataFrame], float] | None = None,
) -> DataFrame:
    """(i, j, w): item-item weights by pairwise steps on triples(epoch): u, i (seen), j (unseen).

    Each weight moves by its mean gradient, so that a step doesn't grow with the number of triples. symmetric: the
    weights of (i, j) and (j, i) are one. checked is given the weights of k items a target.
    """
    seen = written(cells.where("r <> 0").select("u", F.col("i").alias("l")))
    method = Optimizer(optimizer, rate)

    def epoch_of(w: DataFrame | None, epoch: int) -> DataFrame:
        for n, part in enumerate(_parts(triples(epoch), batches, "u", "i", "j")):
            t = written(part.withColumn("t", F.monotonically_increasing_id()).select("t", "u", "i", "j"))
            both = t.join(seen.hint("merge"), "u").where("l <> i")
            if w is None:
                x = t.select("t", F.lit(0.0).alias("x"))
            else:
                of = lambda target: both.join(w.select(F.col("i").alias("l"), F.col("j").alias(target), "w"), ["l", target]).groupBy("t").agg(F.sum("w").alias("s"))  # noqa: B023, E731
                x = t.join(of("i").withColumnRenamed("s", "si").hint("merge"), "t", "left").join(of("j").withColumnRenamed("s", "sj").hint("merge"), "t", "left").select("t", (F.coalesce("si", F.lit(0.0)) - F.coalesce("sj", F.lit(0.0))).alias("x"))
            # the score goes to the triple, so that its pairs, which are many more, are not dealt again
            scored = t.join(x.hint("merge"), "t").withColumn("s", 1.0 / (1.0 + F.exp("x"))).select("u", "i", "j", "s")
            step = scored.join(seen.hint("merge"), "u").where("l <> i")
            g = step.select(F.col("l").alias("i"), F.col("i").alias("j"), F.col("s").alias("g")).union(step.where("l <> j").select(F.col("l").alias("i"), F.col("j").alias("j"), -F.col("s")))
            if symmetric:
                g = g.union(g.select("j", "i", "g"))
            g = g.groupBy("i", "j").agg(F.avg("g").alias("g"))
            known = cells.sparkSession.createDataFrame([], f"i {seen.schema['l'].dataType.simpleString()}, j {seen.schema['l'].dataType.simpleString()}, w double, m double, v double") if w is None else w
            joined = known.join(g, ["i", "j"], "full").select("i", "j", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("v", F.lit(0.0)).alias("v"), "g")
            moved, m, v = method.columns(F.coalesce("g", F.lit(0.0)) - reg * F.col("w"), F.col("m"), F.col("v"), epoch * batches + n + 1)
            w = written(joined.select("i", "j", (F.col("w") + moved).alias("w"), m.alias("m"), v.alias("v")))
        return w

    best = lambda w: top_k(w.where("w <> 0"), "j", "w", "i", k).drop("pos").select("i", "j", "w")
    return best(_epochs(None, epochs, epoch_of, None if checked is None else lambda w: checked(best(w)), patience))
