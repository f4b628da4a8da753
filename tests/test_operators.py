"""Small frames with results worked out by hand, one for each rule that is easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import clean, features, graph, matrix, ranking, sampling, splits


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def log(spark, data):
    return spark.createDataFrame(data, "record_id long, user_id long, item_id long, ts long")


def test_deduplicate_and_partition_of_rows(spark):
    df = log(spark, [(1, 1, 1, 5), (2, 1, 1, 3), (3, None, 1, 1), (4, None, 1, 2), (5, 2, 2, 1)])
    for keep, want in (("first", [2, 3, 5]), ("last", [1, 4, 5]), ("none", [5])):
        cut = clean.deduplicate(df, ["user_id", "item_id"], ["ts", "record_id"], keep)
        assert [r[0] for r in rows(cut.kept, "record_id")] == want
        assert cut.kept.count() + cut.removed.count() == 5
    with pytest.raises(ValueError):
        clean.deduplicate(df, ["user_id"], ["ts"], None)


def test_least_interactions(spark):
    df = log(spark, [(1, 1, 1, 1), (2, 1, 2, 1), (3, 2, 1, 1), (4, None, 1, 1)])
    cut = clean.at_least(df, "user_id", 2)
    assert rows(cut.kept, "record_id") == [(1,), (2,)] and rows(cut.removed, "record_id") == [(3,), (4,)]
    with pytest.raises(ValueError):
        clean.at_least(df, "user_id", -1)


def test_thresholds_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, float("nan"))], "k int, x double")
    want = {"neq": [1, 3, 4], "eq": [2], "geq": [2], "ge": [], "leq": [1, 2], "le": [1]}
    for how, ids in want.items():
        assert [r[0] for r in rows(clean.threshold(df, "x", 2.0, how).kept, "k")] == ids, how
    assert rows(clean.threshold(df, "x", [1.0, None], "isin").kept, "k") == [(1,), (3,), (4,)]
    assert rows(clean.threshold(df, "x", [1.0], "not_isin").kept, "k") == [(2,), (3,), (4,)]
    assert rows(clean.not_null(df, "x").kept, "k") == [(1,), (2,)]
    with pytest.raises(ValueError):
        clean.threshold(df, "x", 1, "gt")


def test_merge_matches_nulls_and_reports_unmatched(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k int, v string")
    joined, lost = clean.merge(a, b, "inner", ["k"], ["k"])
    assert rows(joined, "v_x", "v_y") == [("a", "x"), ("n", "y")] and rows(lost, "k", "v") == [(3, "c")]
    for bad in ({"how": "outer", "left_on": ["k"], "right_on": ["k"]}, {"how": "left", "left_on": [], "right_on": []}):
        with pytest.raises(ValueError):
            clean.merge(a, b, **bad)


def test_filters_and_samples(spark):
    df = log(spark, [(i, i % 10, 1, 1) for i in range(100)] + [(100, None, 1, 1)])
    for fraction, n in ((0, 0), (0.35, 30), (1, 100)):
        cut = clean.sample_values(df, "user_id", fraction, 4)
        assert cut.kept.count() == n and cut.removed.count() == 101 - n
    assert clean.left_out(df.limit(1), "user_id", 1.0).count() == 1
    with pytest.raises(ValueError):
        clean.filter_by(df, log(spark, [(1, 99, 1, 1)]), "user_id", checked=True)
    report = clean.threshold(df, "record_id", 50, "le").report().collect()[0]
    assert (report.original, report.new, report.removed) == (101, 50, 51)
    empty = clean.threshold(df.limit(0), "record_id", 50).report().collect()
    assert all(r.new_pct is None for r in empty)


def test_splits(spark):
    df = log(spark, [(i, u, i, i // 2) for u in (1, 2) for i in range(5 * u, 5 * u + 4)])
    s = splits.last_k(df, "user_id", ["ts", "record_id"], 1, validation=True)
    assert rows(s.test, "record_id") == [(13,), (8,)] and rows(s.validation, "record_id") == [(12,), (7,)]
    assert s.train_validation.count() == 6 and all(r.violations == 0 for r in s.violations("user_id", "item_id", 1).collect())
    with pytest.raises(ValueError, match="fewer than 5"):
        splits.last_k(df, "user_id", ["ts", "record_id"], 4)
    assert splits.last_k(df, "user_id", ["ts", "record_id"], 4, strict=False).test.count() == 0
    t = splits.by_threshold(spark.createDataFrame([(1, 1), (2, None), (3, 5)], "k int, x int"), "x", 1)
    assert rows(t.train, "k") == [(1,)] and rows(t.test, "k") == [(2,), (3,)]


def test_last_seen(spark):
    df = log(spark, [(1, 1, 1, 10), (2, 1, 1, 14), (3, 1, 1, 14), (4, 2, 1, 7)])
    one = features.last_seen(df, "user_id", "item_id", "ts", "record_id")
    assert rows(one.kept, "record_id", "last_seen_euclidean") == [(3, 0)] and one.removed.count() == 2
    t0 = dt.datetime(2024, 1, 1)
    timed = spark.createDataFrame([(i, u, 1, t0 + dt.timedelta(hours=h)) for i, u, h in ((1, 1, 0), (2, 1, 36), (3, 1, 36), (4, 2, 5))], "record_id long, user_id long, item_id long, ts timestamp_ntz")
    assert rows(features.last_seen(timed, "user_id", "item_id", "ts", "record_id").kept, "record_id", "last_seen_hours") == [(3, None)]
    two = features.last_seen(timed, "user_id", "item_id", "ts", "record_id", skip_null=True)
    assert rows(two.kept, "record_id", "last_seen_hours", "last_seen_days") == [(2, 36.0, 1.5)] and two.removed.count() == 3


def test_positions(spark):
    df = spark.createDataFrame([(1, 1, [7, 8, 7], [5, 6, 9]), (2, 1, [8], [1]), (3, 2, [], [])], "record_id long, user_id long, items array<long>, places array<int>")
    assert rows(features.position(df, "user_id", "items", "record_id").kept, "items", "position") == [(7, 0), (8, 1)]
    assert rows(features.position(df, "user_id", "items", "record_id", keep="last").kept, "items", "position") == [(7, 2), (8, 0)]
    assert rows(features.position(df, "user_id", "items", "record_id", positions="places").kept, "items", "position") == [(7, 5), (8, 6)]
    assert features.frequency(df, "user_id", "items").count() == 2


def test_matrices(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (2, 6, 1.0), (2, None, 1.0)], "user_id long, item_id long, r double")
    u, i = matrix.mapper(df, "user_id"), matrix.mapper(df, "item_id")
    cells = matrix.coordinates(df, "user_id", "item_id", "r", users=u, item_ids=i)
    assert rows(cells, "u", "i", "r") == [(0, 0, 5.0), (1, 1, 1.0)]
    with pytest.raises(ValueError):
        matrix.coordinates(df, "user_id", "item_id", users=u.where("idx = 0"))
    assert {r.check: r.violations for r in matrix.consistency(cells, u, i).collect()}["implicit"] == 1
    users = spark.createDataFrame([(0,), (1,), (2,)], "u int")
    assert rows(matrix.leave_k_violations(cells, users), "u", "n") == [(2, 0)]
    assert matrix.overlap(cells, cells).count() == 2
    flat = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "id int, n long")
    assert matrix.gini(flat).first()[0] == 0.0
    assert math.isclose(matrix.gini(spark.createDataFrame([(1, 0), (2, 0), (3, 9)], "id int, n long")).first()[0], 2 / 3)


def test_ranks(spark):
    def ranked(keys):
        data = [(r, c, *[k[r][c] for k in keys]) for r in range(len(keys[0])) for c in range(len(keys[0][0]))]
        names = [f"k{n}" for n in range(len(keys))]
        df = spark.createDataFrame(data, "row int, col int, " + ", ".join(f"{n} int" for n in names))
        out = ranking.rank_rows(df, "row", "col", names).orderBy("row", "col").collect()
        return [[x.rank for x in out if x.row == r] for r in range(len(keys[0]))]

    assert ranked([[[9, 8, 7]], [[1, 7, 2]]]) == [[1, 3, 2]]
    assert ranked([[[9, 8, 7]], [[1, 1, 1]]]) == [[3, 2, 1]]
    assert ranked([[[9, 8, 7], [1, 2, 3]], [[1, 1, 1], [1, 1, 1]]]) == [[3, 2, 1], [1, 2, 3]]
    ids = spark.createDataFrame([(x,) for x in (50, 3, 999, -7, 4)], "v long")
    assert rows(ranking.dense_index(ids, "v"), "v", "idx") == sorted([(-7, 0), (3, 1), (4, 2), (50, 3), (999, 4)], key=str)


def test_walks_agree(spark):
    data = [(u, i, 1.0) for u in range(20) for i in range(15) if (u * 7 + i * 3) % 4 == 0]
    cells = spark.createDataFrame(data, "u long, i long, r double").repartition(7)
    plain, half = graph.p3_alpha(cells, k=6), graph.p3_alpha_symmetric(cells, k=6)
    a, b = ({(r.i, r.j): round(r.w, 10) for r in x.collect()} for x in (plain, half))
    assert a == b and all(i != j for i, j in a)
    normal = graph.p3_alpha(cells, k=6, normalize=True).groupBy("i").agg(F.sum("w").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in normal)


def test_samples(spark):
    data = [(u, i, 1.0) for u in range(6) for i in range(6) if (u + i) % 3]
    cells = spark.createDataFrame(data, "u long, i long, r double")
    users, items = cells.select("u").distinct(), cells.select("i").distinct()
    stored = {(u, i) for u, i, _ in data}
    p = sampling.positives(cells, 300, 5).collect()
    assert len(p) == 300 and {(r.u, r.i) for r in p} <= stored and len({(r.u, r.i) for r in p}) > 15
    n = sampling.negatives(cells, users, items, 300, 5).collect()
    assert len(n) == 300 and not {(r.u, r.i) for r in n} & stored and {r.u for r in n} == set(range(6)) and {r.i for r in n} == set(range(6))
    m = sampling.mixed(cells, users, items, 100, 0.3, 5)
    assert m.where("r = 0").count() == 30 and m.count() == m.select("draw").distinct().count() == 100
    assert rows(sampling.positives(cells.repartition(5), 50, 5), "draw", "u", "i") == rows(sampling.positives(cells, 50, 5), "draw", "u", "i")
    with pytest.raises(ValueError):
        sampling.negatives(cells, users.where("u = 1"), items.where("i = 1"), 5)
