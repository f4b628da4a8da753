"""Numbering in ranges, heavy profiles, trainers' options, datasets and bundles, tests over cutoffs and metrics."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import scratch
from quillon.functions import dists, significance
from quillon.operators import factors, graph, matrix, ranking
from quillon.plans import charts, dataset, search
from quillon.plans.evaluate import most_popular
from quillon.sources.store import Bundle, Matrix, read_any, sparse_from_arrays


def test_prefix_sums_with_outliers_and_groups(spark):
    dice = random.Random(1)
    rows = [(dice.choice("ab"), k, dice.randint(0, 9)) for k in [*range(500), 10**15, -(10**15)]]
    got = ranking.prefix_sums(spark.createDataFrame(rows, "g string, k long, v long"), ["k"], "v", ["g"]).collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.before == total
            total += r.v
    down = ranking.prefix_sums(spark.createDataFrame(rows, "g string, k long, v long"), [F.col("v").desc(), "k"], name="place").collect()
    assert [r.place for r in sorted(down, key=lambda r: (-r.v, r.k))] == list(range(502))


def test_mappers_of_any_type(spark):
    df = spark.createDataFrame([("b", ["x", "y"]), ("a", ["y"]), (None, []), ("b", ["zé", None])], "id string, items array<string>")
    assert [(r.orig_id, r.idx) for r in matrix.mapper(df, "id").orderBy("idx").collect()] == [("a", 0), ("b", 1)]
    items = matrix.mapper(df, "items")
    assert [r.orig_id for r in items.orderBy("idx").collect()] == ["x", "y", "zé"] and dict(items.dtypes)["idx"] == "bigint"
    cells = matrix.coordinates(df, "id", "items", users=matrix.mapper(df, "id"), item_ids=items)
    assert {(r.u, r.i, r.r) for r in cells.collect()} == {(0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)}
    assert matrix.mapper(df.limit(0), "id").count() == 0


def test_percentiles_are_exact(spark):
    dice = random.Random(2)
    x = [float(dice.choice([1, 2, 2, 3, 50, 51])) for _ in range(237)] + [1e9]
    got = matrix.percentiles(spark.createDataFrame([(v,) for v in x] + [(None,)], "x double"), "x").first()
    assert np.allclose(list(got), np.percentile(x, [100 * p for p in matrix.PERCENTILES]))
    assert matrix.percentiles(spark.createDataFrame([], "x double"), "x").first()[0] is None


def test_users_with_every_item_are_no_single_group(spark, monkeypatch):
    """Chunked profiles give the same weights as whole ones, and no key of the join has more than a chunk's pairs."""
    dice = random.Random(4)
    cells = [(0, i, float(1 + i % 3)) for i in range(120)] + [(u, i, 1.0) for u in range(1, 12) for i in dice.sample(range(120), 9)]
    df = spark.createDataFrame(cells, "u long, i long, r double")
    models = {"p3": lambda: graph.p3_alpha(df, k=7, alpha=1.3, beta=0.4), "sym": lambda: graph.p3_alpha_symmetric(df.withColumn("r", F.lit(1.0)), k=7), "knn": lambda: graph.item_knn(df, k=7, shrink=2.0)}
    whole = {n: {(r.i, r.j): r.w for r in m().collect()} for n, m in models.items()}
    monkeypatch.setattr(graph, "PROFILE", 16)
    for n, m in models.items():
        got = {(r.i, r.j): r.w for r in m().collect()}
        assert got.keys() == whole[n].keys() and all(abs(got[k] - whole[n][k]) < 1e-9 for k in got)
    both = graph.pairs(df.select("u", "i"), df.select("u", F.col("i").alias("j")), df)
    assert both.count() == sum(n * n for n in [120, *[9] * 11])


def test_popularity_with_a_long_tail(spark, monkeypatch):
    train = spark.createDataFrame([(u, i) for u in range(6) for i in range(u + 1)] + [(9, i) for i in range(100, 300)], "user_id long, item_id long")
    curve = charts.popularity_curve(train, "item_id").orderBy("place").collect()
    assert [r.place for r in curve] == list(range(1, len(curve) + 1)) and [r.value for r in curve[:7]] == [0, 1, 2, 3, 4, 5, 100]
    want = {(r.user_id, r.item_id, r.pos) for r in most_popular(train, train.select("user_id").distinct(), 4).collect()}
    monkeypatch.setattr("quillon.plans.evaluate.HEAD", 3)
    assert {(r.user_id, r.item_id, r.pos) for r in most_popular(train, train.select("user_id").distinct(), 4).collect()} == want
    assert (9, 0, 1) in want and (5, 100, 1) in want


def test_tails_without_cancellation():
    assert dists.studentized_range_sf(3.314, 3) == pytest.approx(0.05, abs=1e-4) and dists.studentized_range_sf(3.858, 5) == pytest.approx(0.05, abs=1e-4)
    assert dists.studentized_range_sf(2.772, 2) == pytest.approx(0.05, abs=1e-4) and dists.studentized_range_sf(0.0, 4) == 1.0
    assert dists.signed_rank_cdf(0, 50) == pytest.approx(2.0**-50) and dists.binomial_cdf(0, 60) == pytest.approx(2.0**-60)


def test_exact_signed_ranks_keep_small_tails(spark):
    d = spark.createDataFrame([(u, "x", float(u + 1)) for u in range(40)], "user_id long, other string, d double")
    up = significance.wilcoxon_test(d, "wilcox", "greater").first()
    assert up.p_value == pytest.approx(2.0**-40) and up.hypothesis == "ALTERNATIVE"
    assert significance.sign_test(d, "zsplit", "greater").first().p_value == pytest.approx(2.0**-40)


def test_comparisons_over_cutoffs_and_metrics(spark):
    dice = random.Random(6)
    rows = [(u, r, c, base + dice.random(), dice.random()) for u in range(40) for r, base in (("a", 0.0), ("b", 0.6), ("c", 0.0)) for c in (5, 10)]
    scores = spark.createDataFrame(rows, "user_id long, recommender string, cutoff int, ndcg double, mrr double")
    got = significance.compare(scores, "a", ["ndcg", "mrr"]).collect()
    assert len(got) == 2 * 2 * 2 * 4 * 3 * 2  # cutoffs, metrics, others, tests, alternatives, groupings
    one = {(r.cutoff, r.metric, r.other, r.test, r.alternative): r for r in got if r.grouping == "pairs"}
    for r in got:
        if r.grouping == "group":
            alone = one[r.cutoff, r.metric, r.other, r.test, r.alternative]
            assert r.statistic == alone.statistic and r.p_value == pytest.approx(min(1.0, 2 * alone.p_value)) and r.alpha == 0.025
    assert all(r.hypothesis == "ALTERNATIVE" for k, r in one.items() if k[1:3] == ("ndcg", "b") and k[4] != "less")
    single = significance.t_test(significance.differences(scores.where("recommender = 'a' and cutoff = 5").select("user_id", F.col("ndcg").alias("score")), scores.where("recommender = 'b' and cutoff = 5").select("user_id", F.col("recommender").alias("other"), F.col("ndcg").alias("score")))).first()
    assert one[5, "ndcg", "b", "paired_t", "two-sided"].statistic == pytest.approx(single.statistic)
    assert significance.friedman_all(scores, ["ndcg"]).count() == 2
    both = significance.intervals(scores, ["ndcg", "mrr"]).collect()
    assert len(both) == 3 * 2 * 2 * 4 * 2 and all(r.low < r.mean < r.high for r in both)
    long = scores.where("cutoff = 5").select("user_id", "recommender", F.col("ndcg").alias("score"))
    found = {(r.a, r.b): r for r in significance.nemenyi(long).collect()}
    assert found["a", "b"].hypothesis == "ALTERNATIVE" and found["a", "c"].p_value > 0.05


def test_trainers_options(spark):
    cells = spark.createDataFrame([(u, i, 1.0) for u in range(10) for i in range(10) if (u + i) % 2], "u long, i long, r double")
    ids = (cells.select(F.col("u").alias("id")).distinct(), cells.select(F.col("i").alias("id")).distinct())
    every = spark.createDataFrame([(u, i, float(u < 5)) for u in range(10) for i in range(10)], "u long, i long, r double")
    apart = spark.createDataFrame([(u, i, j) for u in range(10) for i in range(10) if (u + i) % 2 for j in ((i + 1) % 10,)], "u long, i long, j long")

    def error(m):
        e = every.join(m.users.select(F.col("id").alias("u"), F.col("factors").alias("p"), F.col("bias").alias("bu")), "u").join(m.items.select(F.col("id").alias("i"), F.col("factors").alias("q"), F.col("bias").alias("bi")), "i")
        return e.select(F.avg(F.pow(F.col("r") - m.mean - F.col("bu") - F.col("bi") - factors.dot(F.col("p"), F.col("q")), 2))).first()[0]

    start = error(factors.fit_mf(lambda e: every, ids, width=2, epochs=0))
    for kind, rate in (("sgd", 0.5), ("adagrad", 0.2), ("rmsprop", 0.1), ("adam", 0.2)):
        assert error(factors.fit_mf(lambda e: every, ids, width=2, epochs=3, rate=rate, optimizer=kind, batches=2)) < start, kind
    scores = iter([0.1, 0.9, 0.2, 0.1, 0.0])
    seen = []
    factors.fit_bpr(lambda e: apart, ids, width=2, epochs=5, patience=2, optimizer="adam", dropout=0.5, checked=lambda m: seen.append(m) or next(scores))
    assert len(seen) == 4  # two epochs without a better one
    v = factors.fit_lightgcn(cells, lambda e: apart, width=2, layers=1, epochs=2, optimizer="adam", rate=0.05, dropout=0.3, batches=2)
    assert v.count() == 20 and all(np.isfinite(r.vector).all() for r in v.collect())
    w = factors.slim_bpr(cells, lambda e: apart, epochs=2, symmetric=True, optimizer="adagrad", k=10).collect()
    of = {(r.i, r.j): r.w for r in w}
    assert of and all(abs(of[j, i] - x) < 1e-12 for (i, j), x in of.items() if (j, i) in of)
    with pytest.raises(ValueError):
        factors.fit_bpr(lambda e: apart, ids, dropout=1.0, epochs=1)


def test_dataset_is_built_once(spark, tmp_path):
    log = spark.createDataFrame([(10 * u + k, f"u{u}", f"i{(u + k) % 6}", k) for u in range(5) for k in range(4)], "record_id long, user_id string, item_id string, ts long")
    shown = spark.createDataFrame([(10 * u + k, f"u{u}", [f"i{(u + k) % 6}", "only shown"]) for u in range(5) for k in range(4)], "record_id long, user_id string, items array<string>")
    calls = []

    def reader(**more):
        config = {"name": "toy", **more}
        count = lambda df: df.groupBy("user_id").count()
        return dataset.Reader(spark, config, lambda: calls.append(1) or log, dataset.Strategy("last_k", 1, ("ts", "record_id")), impressions=lambda: shown, features={"lengths": count})

    d = reader().load(str(tmp_path)).check()
    again = reader().load(str(tmp_path))
    assert calls == [1] and again.config() == {"name": "toy"} and again.path == d.path
    assert d.names("interactions") == ["all", "test", "train", "train_validation", "validation"] and d.features() == ["lengths"]
    assert d.interactions().shape == (5, 7) == d.impressions("train").shape and d.interactions("test").cells.count() == 5
    assert d.frame("train").count() == 10 and d.frame("validation").count() == 5 and "split" in d.frame("all").columns
    assert d.impressions("test").cells.where("r = 1").count() == 10 and d.mapper("items").count() == 7
    assert {r["count"] for r in d.feature("lengths")["values"].collect()} == {2}
    d.add_feature("more", {"x": np.arange(3)})
    assert again.features() == ["lengths", "more"] and again.feature("more")["x"].tolist() == [0, 1, 2]
    reader(k=2).load(str(tmp_path))
    assert calls == [1, 1]
    for missing in (lambda: d.interactions("none"), lambda: d.frame("none"), lambda: d.feature("none"), lambda: dataset.Dataset(spark, f"{tmp_path}/none").mapper("users")):
        with pytest.raises(FileNotFoundError):
            missing()
    cut = dataset.Strategy("threshold", column="ts", values=(1, 2)).split(log, "user_id")
    assert (cut.train.count(), cut.validation.count(), cut.test.count()) == (10, 5, 5)
    with pytest.raises(ValueError):
        dataset.Strategy("threshold", column="ts", values=(1,)).split(log, "user_id")


def test_bundles_of_arrays_and_matrices(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 2.0)], "u long, i long, r double")
    values = {"m": Matrix(cells, (3, 4)), "x": np.arange(6.0).reshape(2, 3), "d": {"a": np.array([1, 2], np.int32), "b": np.array(["p", "q"])}, "t": cells, "n": {"deep": {"t": cells}}, "j": [1, "two"]}
    b = Bundle(spark, f"{tmp_path}/b")
    b.save(values)
    got = b.load()
    assert got["m"].shape == (3, 4) and got["m"].cells.collect() == cells.collect() and got["x"].tolist() == values["x"].tolist()
    assert got["d"]["a"].dtype == np.int32 and got["d"]["b"].tolist() == ["p", "q"] and got["n"]["deep"]["t"].count() == 1 and got["j"] == [1, "two"]
    b.save({"other": 1})  # replaced whole
    assert b.load() == {"other": 1} and [p.name for p in tmp_path.iterdir()] == ["b"]
    for name in (".x", "_x", "a/b"):
        with pytest.raises(ValueError):
            b.save({name: 1})
    with pytest.raises(TypeError):
        b.save({"bad": object()})
    assert b.load() == {"other": 1}  # a save that fails leaves the old one


def test_reading_arrays_and_archives(spark, tmp_path):
    np.savez(tmp_path / "m.npz", indptr=np.array([0, 2, 2, 3]), indices=np.array([1, 3, 0]), data=np.array([5.0, 6.0, 7.0]), shape=np.array([3, 4]))
    m = sparse_from_arrays(read_any(spark, f"{tmp_path}/m.npz"))
    assert m.shape == (3, 4) and {tuple(r) for r in m.cells.collect()} == {(0, 1, 5.0), (0, 3, 6.0), (2, 0, 7.0)}
    np.save(tmp_path / "x.npy", np.array(["a", "b"]))
    assert [r.text for r in read_any(spark, f"{tmp_path}/x.npy").orderBy("pos").collect()] == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "one")
        z.writestr(".hidden", "no")
    assert [(r.name, bytes(r.content)) for r in read_any(spark, f"{tmp_path}/z.zip").collect()] == [("a.txt", b"one")]
    buffer = io.BytesIO()
    np.save(buffer, np.arange(2))
    with pytest.raises(ValueError):
        read_any(spark, f"{tmp_path}/m.xyz")


def test_searches_go_on_where_they_stopped(spark, tmp_path):
    tried = []

    def objective(s):
        tried.append(s["x"])
        if len(tried) == 3:
            raise RuntimeError("stopped")
        return -abs(s["x"] - 2)

    space = {"x": [1, 2, 3]}
    with pytest.raises(RuntimeError):
        search.search(objective, search.grid(space), spark=spark, path=f"{tmp_path}/s")
    best, value, all_ = search.search(objective, search.grid(space), spark=spark, path=f"{tmp_path}/s")
    assert best == {"x": 2} and value == 0 and tried == [1, 2, 3, 3] and len(all_) == 3
    assert search.cached_by_type(lambda x: type(x))(1) is int
    for space in search.SPACES.values():
        assert next(search.draws(space, 1))


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())
    from quillon.plans import models  # noqa: F401
