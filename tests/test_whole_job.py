"""Operators do the whole job: no fixed number of draws, no cap, no rows left out."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.operators import factors, graph, sampling
from quillon.plans import models

SMALL = "/root/testdata/sf0.001"


class Drawn(Exception):
    """Ends a training at its first draw, with the number of draws."""


@pytest.fixture
def stop(monkeypatch):
    def drawn(n):
        raise Drawn(n)

    monkeypatch.setattr(sampling, "triples", lambda cells, items, n, *rest: drawn(n))
    monkeypatch.setattr(sampling, "mixed", lambda cells, users, items, n, *rest: drawn(n))


@pytest.mark.parametrize("name", ["mf", "bpr", "lightgcn", "slim_bpr"])
def test_an_epoch_draws_as_many_cells_as_are_stored(spark, stop, name):
    stored = queries._cells(spark, SMALL).count()
    with pytest.raises(Drawn) as n:
        queries.queries()[f"train_{name}"](spark, SMALL)
    assert n.value.args == (stored,)
    cells = spark.createDataFrame([(u, i, 1.0) for u in range(5) for i in range(5) if u != i] + [(0, 0, 0.0)], "u long, i long, r double")
    for given, want in ((None, 20), (7, 7)):
        with pytest.raises(Drawn) as n:
            models.fit(name, cells, samples=given)
        assert n.value.args == (want,)


def test_item_weights_do_not_grow_with_the_number_of_triples(spark):
    cells = spark.createDataFrame([(u, i, 1.0) for u in range(6) for i in range(6) if (u + i) % 3], "u long, i long, r double")
    once = sampling.triples(cells, cells.select("i").distinct(), 30, 1)
    one, many = ({(r.i, r.j): r.w for r in factors.slim_bpr(cells, lambda _: t, epochs=2).collect()} for t in (once, once.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9)))).drop("n")))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_every_vector_is_scored(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.x for r in e])
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    want = {(int(ids[a]), p + 1): int(ids[b]) for a in range(len(ids)) for p, b in enumerate(np.lexsort([ids, -s[a]])[:10])}
    got = {(r.user_id, r.pos): r.item_id for r in queries.queries()["mf_topk"](spark, SMALL).collect()}
    assert got == want and len(got) == 10 * len(ids)


def test_blocks_of_users_and_items_keep_ties_and_seen_items(spark, monkeypatch):
    monkeypatch.setattr(factors, "USERS", 2)
    monkeypatch.setattr(factors, "ITEMS", 3)
    users = spark.createDataFrame([(u, [1.0, float(u)], 0.0) for u in range(5)], "id long, factors array<double>, bias double")
    items = spark.createDataFrame([(i, [0.0, float(i % 3)], 0.5 * (i == 7)) for i in range(11)], "id long, factors array<double>, bias double")
    seen = {(0, 0), (0, 1), (2, 8), *((3, i) for i in range(9)), *((4, i) for i in range(11))}
    got = factors.recommend(factors.Factors(users, items), spark.createDataFrame(sorted(seen), "u long, i long"), 4).collect()
    score = lambda u, i: u * (i % 3) + 0.5 * (i == 7)
    want = [(u, i, p + 1, score(u, i)) for u in range(5) for p, i in enumerate(sorted((i for i in range(11) if (u, i) not in seen), key=lambda i: (-score(u, i), i))[:4])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_elastic_net_regresses_on_all_items(spark):
    dice = np.random.default_rng(4)
    x = (dice.random((40, 9)) < 0.5) * dice.choice([1.0, 2.0, -1.0], (40, 9))
    cells = spark.createDataFrame([(u, i, float(x[u, i])) for u in range(40) for i in range(9)], "u long, i long, r double")
    n, want = int((x != 0).any(1).sum()), {}
    for j in range(9):
        g, w = x.T @ x, np.zeros(9)
        for _ in range(3000):
            for m in set(range(9)) - {j}:
                w[m] = max(0.0, g[m, j] - g[m] @ w + g[m, m] * w[m] - n * 0.01 * 0.1) / (g[m, m] + n * 0.01 * 0.9)
        want |= {(m, j): w[m] for m in np.flatnonzero(w)}
    for candidates in (1, 2, 20):
        got = {(r.i, r.j): r.w for r in factors.slim_elastic_net(cells, alpha=0.01, candidates=candidates).collect()}
        small = {p for p in want.keys() ^ got.keys() if max(want.get(p, 0), got.get(p, 0)) > 1e-5}
        assert not small and all(abs(got[p] - want[p]) < 1e-5 for p in got.keys() & want.keys()), candidates


def test_users_who_have_seen_most_items_keep_their_triples(spark):
    cells = spark.createDataFrame([(0, i, 1.0) for i in range(399)] + [(1, i, 1.0) for i in range(400)] + [(2, 0, 1.0)], "u long, i long, r double")
    drawn = {u: n for u, n in sampling.positives(cells, 300, 1).groupBy("u").count().collect()}
    got = sampling.triples(cells, cells.select("i").distinct(), 300, 1).collect()
    assert sum(r.u == 0 for r in got) == drawn[0] and not any(r.u == 1 for r in got) and all(r.j == 399 for r in got if r.u == 0)


def test_walks_make_rows_where_they_are_used(spark, monkeypatch):
    """Blocks of few pairs, rows in several parts and text ids give what the sums by pair give."""
    rng = np.random.default_rng(7)
    cells = sorted({(int(u), f"p{i}") for u, i in zip(rng.integers(0, 40, 900), rng.zipf(1.4, 900) % 300, strict=True)})
    df = spark.createDataFrame([(u, i, 1.0) for u, i in cells], "u long, i string, r double")
    w = collections.defaultdict(float)
    by_user = collections.defaultdict(list)
    degree = collections.Counter(i for _, i in cells)
    for u, i in cells:
        by_user[u].append(i)
    for items in by_user.values():
        for a in items:
            for b in items:
                if a != b:
                    w[a, b] += 1 / degree[a] / len(items)
    want = {}
    for a in degree:
        for b, x in sorted(((b, x) for (c, b), x in w.items() if c == a), key=lambda t: (-round(t[1], 12), t[0]))[:5]:
            want[a, b] = round(x, 9)
    monkeypatch.setattr(graph, "WORK", 300)
    monkeypatch.setattr(graph, "HELD", 64)
    monkeypatch.setattr(graph, "_few", lambda cells: False)
    for made in (graph.p3_alpha_symmetric(df, k=5), graph.p3_alpha(df, k=5)):
        assert {(r["i"], r["j"]): round(r["w"], 9) for r in made.collect()} == want


def test_no_pair_of_many_items_is_a_row(spark, monkeypatch):
    """Where items are many, pairs are not joined."""
    df = spark.range(3000).select((F.col("id") % 100).alias("u"), F.col("id").alias("i"), F.lit(1.0).alias("r"))

    def never(*_):
        raise AssertionError("pairs are rows")

    monkeypatch.setattr(graph, "pairs", never)
    assert graph.p3_alpha_symmetric(df, k=3).count() == 9000
    assert graph.p3_alpha(df, k=3).count() == 9000
