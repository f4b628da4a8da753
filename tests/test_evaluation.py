"""Metrics and tests against worked examples and closed forms."""

import math

import pytest

from quillon.functions import dists, metrics, significance
from quillon.operators import factors
from quillon.plans.evaluate import Holdout, most_popular


def test_metrics_of_one_list(spark):
    recs = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 1, 3)], "user_id long, item_id long, pos int")
    test = spark.createDataFrame([(1, 1, 1.0)], "user_id long, item_id long, r double")
    pop = spark.createDataFrame([(i, n) for i, n in enumerate((10, 5, 2, 3, 8))], "item_id long, n long")
    r = metrics.per_user(recs, test, pop, 5, [3]).first()
    assert math.isclose(r.precision, 1 / 3) and r.recall == 1 and math.isclose(r.map, 1 / 9) and math.isclose(r.mrr, 1 / 3)
    assert math.isclose(r.ndcg, 0.5) and r.hit_rate == 1 and math.isclose(r.arhr, 1 / 3) and math.isclose(r.f1, 0.5) and r.position_first_relevant == 1
    assert math.isclose(r.novelty, -sum(math.log2(x / 28) for x in (3, 2, 5)) / 5)


@pytest.mark.parametrize("hits,want", [([1, 0, 0], 3), ([0, 1, 0], 2), ([0, 0, 1], 1), ([0, 0, 0], 0)])
def test_first_hit(spark, hits, want):
    recs = spark.createDataFrame([(1, i, i + 1) for i in range(3)], "user_id long, item_id long, pos int")
    test = spark.createDataFrame([(1, i, 1.0) for i in range(3) if hits[i]] or [(1, 9, 1.0)], "user_id long, item_id long, r double")
    pop = spark.createDataFrame([(0, 1)], "item_id long, n long")
    assert metrics.per_user(recs, test, pop, 10, [3]).first().position_first_relevant == want


def test_empty_and_short_lists(spark):
    recs = spark.createDataFrame([(1, 5, 1)], "user_id long, item_id long, pos int")
    test = spark.createDataFrame([(1, 5, 3.0), (1, 6, 1.0), (2, 5, 1.0)], "user_id long, item_id long, r double")
    train = spark.createDataFrame([(1, 1), (2, 1), (3, 5)], "user_id long, item_id long")
    h = Holdout(train, test, (2,))
    got = {r.user_id: r for r in h.scores(recs).collect()}
    assert got[1].precision == 1 and got[1].recall == 0.5 and got[2].precision == got[2].ndcg == 0 and got[2].covered == 0
    t = h.table(recs).first()
    assert math.isclose(t.coverage_user, 1 / 3) and math.isclose(t.coverage_item, 1 / 3) and t.diversity_herfindahl == 0


def test_most_popular_skips_what_was_seen(spark):
    train = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (3, 3)], "user_id long, item_id long")
    got = {(r.user_id, r.pos): r.item_id for r in most_popular(train, train.select("user_id").distinct(), 2).collect()}
    assert got == {(1, 1): 3, (2, 1): 3, (3, 1): 2}


def test_distributions():
    assert math.isclose(dists.normal_cdf(1.959963984540054), 0.975)
    assert math.isclose(dists.student_cdf(1.0, 1), 0.75) and math.isclose(dists.student_cdf(2.0, 2), 0.5 + 2 / (2 * math.sqrt(6)))
    assert math.isclose(dists.chi_square_sf(3.0, 2), math.exp(-1.5)) and math.isclose(dists.chi_square_sf(30.0, 2), math.exp(-15), rel_tol=1e-9)
    assert math.isclose(dists.binomial_cdf(3, 10), sum(math.comb(10, k) for k in range(4)) / 1024)
    assert dists.signed_rank_cdf(0, 4) == 1 / 16 and dists.signed_rank_cdf(10, 4) == 1
    assert math.isclose(dists.quantile(lambda x: dists.student_cdf(x, 1), 0.975), 12.7062047362, rel_tol=1e-9)


def scores(spark, pairs):
    return spark.createDataFrame([(i, "x", float(d)) for i, d in enumerate(pairs)], "user_id long, other string, d double")


def test_decisions_on_separated_scores(spark):
    d = scores(spark, [0.3 + i / 1000 for i in range(100)])
    for test in (significance.t_test, significance.wilcoxon_test, significance.sign_test):
        for alternative, want in (("two-sided", "ALTERNATIVE"), ("greater", "ALTERNATIVE"), ("less", "NULL")):
            assert test(d, alternative=alternative).first().hypothesis == want
    assert significance.bonferroni(significance.t_test(d)).first().hypothesis == "ALTERNATIVE"


def test_wilcoxon_zeros(spark):
    d = scores(spark, [0, 0, 1, -2, 3, 3])
    w = {z: significance.wilcoxon(d, z).first() for z in significance.ZEROS}
    assert (w["wilcox"].n, w["wilcox"].r_plus, w["wilcox"].r_minus) == (4, 1 + 3.5 + 3.5, 2)
    assert (w["zsplit"].r_plus, w["zsplit"].r_minus) == (3 + 5.5 + 5.5 + 1.5, 4 + 1.5)
    assert w["pratt"].r_plus == 14 and math.isclose(w["pratt"].mu, 6 * 7 / 4 - 2 * 3 / 4)
    none = significance.wilcoxon_test(scores(spark, [0, 0, 0])).first()
    assert math.isnan(none.p_value) and none.hypothesis == "NULL"
    for ties in significance.TIES:
        assert significance.sign_test(scores(spark, [0, 0, 0, 1]), ties).first().statistic == {"strictly_greater": 1, "greater_or_equal": 4}.get(ties, 2)


def test_friedman(spark):
    long = spark.createDataFrame([(u, f"m{m}", u / 100 + m / 10) for u in range(12) for m in range(7)], "user_id long, recommender string, score double")
    r = significance.friedman_test(long).first()
    assert r.reliable and r.hypothesis == "ALTERNATIVE" and math.isclose(r.statistic, 72.0)
    with pytest.raises(ValueError):
        significance.friedman_test(long.where("recommender < 'm2'"))


def test_optimizers_climb():
    for kind in ("sgd", "adagrad", "rmsprop", "adam"):
        o, x = factors.Optimizer(kind, rate=0.1), 5.0
        for _ in range(2000):
            x += float(o.step(-2 * x))
        assert abs(x) < 0.2, kind
    with pytest.raises(ValueError):
        factors.Optimizer("lbfgs")


def test_training_is_deterministic_and_learns(spark, tmp_path):
    cells = spark.createDataFrame([(u, i, 1.0) for u in range(10) for i in range(10) if (u < 5) == (i < 5)], "u long, i long, r double")
    ids = cells.select(cells.u.alias("id")).distinct(), cells.select(cells.i.alias("id")).distinct()
    full = spark.createDataFrame([(u, i, float((u < 5) == (i < 5))) for u in range(10) for i in range(10)], "u long, i long, r double")

    def error(m):
        u, i = ({r.id: r for r in t.collect()} for t in (m.users, m.items))
        return sum((r.r - (m.mean + u[r.u].bias + i[r.i].bias + sum(a * b for a, b in zip(u[r.u].factors, i[r.i].factors, strict=True)))) ** 2 for r in full.collect())

    short, long = (factors.fit_mf(lambda e: full, ids, width=3, epochs=n, rate=1.0) for n in (1, 12))
    assert error(long) < error(short)
    again = factors.fit_mf(lambda e: full, ids, width=3, epochs=1, rate=1.0)
    # sums run in any order, so the last digits may differ
    first, second = ({r.id: r.factors for r in m.users.collect()} for m in (short, again))
    assert first.keys() == second.keys() and all(math.isclose(x, y, abs_tol=1e-9) for i in first for x, y in zip(first[i], second[i], strict=True))
