"""More operators as queries over the test tables; `quillon.queries` imports this module last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import significance
from quillon.operators import features, matrix, splits
from quillon.plans import charts, dataset, search
from quillon.plans.evaluate import Holdout, cached, most_popular
from quillon.queries import _COUNTS, _D, _L, _LISTS, _TOP, CELLS, DED, EV, PU, SPLIT, _cells, _differences, _long, _r, _top, holdout, query
from quillon.scratch import shared_dir
from quillon.sources.logs import events, impressions, mean_in_order, purchases, table
from quillon.sources.store import Bundle, Matrix
from quillon.streaming import counts as streaming

# ids of any type


@query("mapper_text", "SELECT event_type AS orig_id, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events)")
def _mapper_text(spark, sf):
    return matrix.mapper(table(spark, sf, "events"), "event_type")


@query("urm_text_ids", "WITH e AS (SELECT user_id, event_type FROM events), m AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM e)) SELECT user_id AS u, i, CAST(count(*) AS DOUBLE) AS r FROM e JOIN m USING (event_type) GROUP BY ALL")
def _urm_text(spark, sf):
    e = table(spark, sf, "events")
    return matrix.coordinates(e, "user_id", "event_type", item_ids=matrix.mapper(e, "event_type"))


# statistics in full

_STATS = ("nobs", "min", "max", "mean", "variance", "skewness", "kurtosis", "std", "gini")


@query(
    "compare_matrices_all",
    f"""WITH {CELLS}, p AS (SELECT 'base' AS side, 'user' AS axis, u AS id, count(*) AS n FROM cells GROUP BY ALL UNION ALL SELECT 'base', 'item', i, count(*) FROM cells GROUP BY ALL UNION ALL SELECT 'other', 'user', u, count(*) FROM cells WHERE i < 60 GROUP BY ALL UNION ALL SELECT 'other', 'item', i, count(*) FROM cells WHERE i < 60 GROUP BY ALL),
    k AS (SELECT *, avg(n) OVER w AS a, row_number() OVER (PARTITION BY side, axis ORDER BY n) AS rn FROM p WINDOW w AS (PARTITION BY side, axis)),
    g AS (SELECT side, axis, CAST(count(*) AS DOUBLE) AS nobs, CAST(min(n) AS DOUBLE) AS "min", CAST(max(n) AS DOUBLE) AS "max", avg(n) AS mean, var_samp(n) AS variance, avg((n - a) ** 3) / pow(avg((n - a) ** 2), 1.5) AS skewness, avg((n - a) ** 4) / pow(avg((n - a) ** 2), 2) - 3 AS kurtosis,
        stddev_pop(n) AS std, (2.0 * sum(rn * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) AS gini FROM k GROUP BY side, axis),
    v AS ("""
    + " UNION ALL ".join(f"""SELECT side, axis, '{s}' AS statistic, "{s}" AS value FROM g""" for s in _STATS)
    + """ UNION ALL SELECT 'base', 'all', 'nnz', CAST(count(*) AS DOUBLE) FROM cells UNION ALL SELECT 'other', 'all', 'nnz', CAST(count(*) AS DOUBLE) FROM cells WHERE i < 60)
    SELECT axis, statistic, round(a.value, 6) AS base, round(b.value, 6) AS other, round(b.value - a.value, 6) AS difference, round(100 * (b.value - a.value) / nullif(a.value, 0), 4) AS difference_pct FROM (SELECT * FROM v WHERE side = 'base') a JOIN (SELECT * FROM v WHERE side = 'other') b USING (axis, statistic)""",
)
def _compare_all(spark, sf):
    c = _cells(spark, sf)
    return matrix.compare_matrices(c, c.where("i < 60")).select("axis", "statistic", *[_r(x) for x in ("base", "other", "difference")], _r("difference_pct", 4))


@query(
    "consistency_violations",
    f"""WITH {EV}, c AS (SELECT user_id AS u, item_id AS i, count(*) AS r FROM ev GROUP BY ALL) SELECT 'not_empty' AS "check", CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS violations FROM c UNION ALL SELECT 'implicit', count(*) FROM c WHERE r <> 1
    UNION ALL SELECT 'users_in_range', count(DISTINCT u) FROM c WHERE u NOT IN (SELECT user_id FROM ev WHERE user_id % 3 > 0) UNION ALL SELECT 'users_bijective', count(*) + max(user_id) + 1 - count(*) - count(*) FROM (SELECT DISTINCT user_id FROM ev WHERE user_id % 3 > 0)
    UNION ALL SELECT 'items_in_range', count(DISTINCT i) FROM c WHERE i NOT IN (SELECT item_id FROM ev WHERE item_id % 5 > 0) UNION ALL SELECT 'items_bijective', max(item_id) + 1 - count(*) FROM (SELECT DISTINCT item_id FROM ev WHERE item_id % 5 > 0)""",
)
def _consistency_violations(spark, sf):
    """Mappers that leave ids out and whose places have gaps."""
    e = events(spark, sf)
    gaps = lambda c, n: e.where(f"{c} % {n} > 0").select(F.col(c).alias("orig_id")).distinct().withColumn("idx", F.col("orig_id"))
    return matrix.consistency(matrix.coordinates(e, "user_id", "item_id"), gaps("user_id", 3), gaps("item_id", 5))


@query("schema_report_wide", "SELECT 'o_orderkey' AS \"column\", 'bigint' AS type, count(*) - count(o_orderkey) AS nulls FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 UNION ALL SELECT 'l_partkey', 'bigint', count(*) - count(l_partkey) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 UNION ALL SELECT 'l_tax', 'double', count(*) - count(l_tax) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def _schema_wide(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_tax")
    both = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return matrix.schema_report(both.select("o_orderkey", "l_partkey", "l_tax"))


@query("saved_statistics", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY ALL")
def _saved_statistics(spark, sf):
    """A table's statistics, saved and read again; the counts are one of its parts."""
    path = f"{shared_dir(spark)}/quillon-statistics"
    matrix.save_summary(matrix.summary(table(spark, sf, "events"), ["value"], ["event_type"]), path)
    return matrix.load_summary(spark, path)["counts_event_type"].select("value", "n", _r("share"))


@query("split_violations_rows", f"WITH {EV}, s AS (SELECT DISTINCT user_id, item_id, CASE WHEN item_id <= 70 THEN 'train' ELSE 'test' END AS split FROM ev), h AS (SELECT user_id, count(*) FILTER (item_id > 70) AS t FROM ev GROUP BY user_id) SELECT 'disjoint' AS \"check\", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'disjoint_test', 0 UNION ALL SELECT 'leave_2_validation', count(*) FROM h UNION ALL SELECT 'leave_2_test', count(*) FILTER (t <> 2) FROM h")
def _split_violations_rows(spark, sf):
    """A split by a threshold, which leaves no fixed number of a user's rows out."""
    return splits.by_threshold(events(spark, sf), "item_id", 70).violations("user_id", "item_id", 2)


# features


@query("feat_position_parallel", f"WITH {_LISTS} SELECT user_id, items, CAST(position * 10 AS INTEGER) AS position FROM l QUALIFY row_number() OVER (PARTITION BY user_id, items ORDER BY record_id, position) = 1")
def _position_parallel(spark, sf):
    """Places from a list beside the items."""
    shown = impressions(spark, sf).withColumn("places", F.transform("items", lambda _, i: i * 10))
    return features.position(shown, "user_id", "items", "record_id", positions="places").kept.select("user_id", "items", "position")


@query("feat_position_none", f"WITH {_LISTS} SELECT user_id, items, position FROM l QUALIFY count(*) OVER (PARTITION BY user_id, items) = 1")
def _position_none(spark, sf):
    return features.position(impressions(spark, sf), "user_id", "items", "record_id", keep="none").kept.select("user_id", "items", "position")


# evaluation in full

_PER = ("precision", "recall", "map", "ndcg", "mrr", "hit_rate", "arhr", "novelty", "position_first_relevant")
_ALL = """, st AS (SELECT item_id, coalesce(n, 0) AS c, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS p, row_number() OVER (ORDER BY coalesce(n, 0), item_id) AS j, count(*) OVER () AS n FROM its LEFT JOIN pop USING (item_id)),
    tr AS (SELECT 2 * sum((n + 1 - j) / (n + 1) * p) AS g, 1 - sum(p * p) AS h, sum(CASE WHEN c > 0 THEN -p * log2(p) ELSE 0 END) AS s FROM st), nt AS (SELECT sum(-n * log2(n / nnz)) / max(ni) / max(nu_all) AS nov FROM pop, nnz, ni, nu),
    hit AS (SELECT cutoff, count(DISTINCT item_id) AS hits FROM js, cut WHERE pos <= cutoff AND rel > 0 AND item_id IN (SELECT item_id FROM its) GROUP BY cutoff),
    dv AS (SELECT cutoff, count(*) FILTER (c > 0) / count(*) AS coverage_item, 2 * sum((n + 1 - j) / (n + 1) * p) AS diversity_gini, 1 - sum(p * p) AS diversity_herfindahl, sum(CASE WHEN c > 0 THEN -p * log2(p) ELSE 0 END) AS shannon_entropy, max(n) AS n_items FROM sh GROUP BY cutoff),
    mt AS (SELECT cutoff, """ + ", ".join(f'avg("{m}") AS "{m}"' for m in (*_PER, "f1")) + """, count(*) AS users, sum(hit_rate) AS users_hit FROM perf GROUP BY cutoff)
    SELECT cutoff, """ + ", ".join(f'round(mt."{m}", 6) AS "{m}"' for m in _PER) + """, round(mt.f1, 6) AS f1_mean, round(coalesce(2 * mt."precision" * mt.recall / nullif(mt."precision" + mt.recall, 0), 0), 6) AS f1, round(users / nu.nu, 6) AS coverage_user, round(users_hit / nu.nu, 6) AS coverage_user_hit,
    round(coverage_item, 6) AS coverage_item, round(coalesce(hits, 0) / n_items, 6) AS coverage_item_hit, round(diversity_gini, 6) AS diversity_gini, round(diversity_herfindahl, 6) AS diversity_herfindahl, round(shannon_entropy, 6) AS shannon_entropy,
    round(diversity_gini / tr.g, 6) AS ratio_diversity_gini, round(diversity_herfindahl / tr.h, 6) AS ratio_diversity_herfindahl, round(shannon_entropy / tr.s, 6) AS ratio_shannon_entropy, round(mt.novelty / nt.nov, 6) AS ratio_novelty
    FROM mt JOIN dv USING (cutoff) LEFT JOIN hit USING (cutoff), tr, nt, nu"""  # fmt: skip
_NU = "SELECT count(DISTINCT user_id) AS nu FROM (SELECT user_id FROM train UNION SELECT user_id FROM test)"


def _full(sql: str) -> str:
    return sql.replace(_NU, _NU.replace("AS nu FROM", "AS nu, count(DISTINCT user_id) AS nu_all FROM"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(f.name, digits) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


@query("evaluate_all", _full(f"WITH {SPLIT} {_TOP} {_COUNTS} {_ALL}"))
def _evaluate_all(spark, sf):
    """Every metric, the ratios to training and the coverage of hits among them."""
    h = holdout(spark, sf)
    return _rounded(h.table(_top(h)))


def _ignoring(sql: str) -> str:
    """The SQL of an evaluation without users divisible by 7 and items divisible by 11."""
    kept = "item_id % 11 <> 0"
    out = sql.replace("FROM sp WHERE rk = 1)", "FROM sp WHERE rk = 1 AND user_id % 7 <> 0), every_test AS (SELECT user_id, item_id FROM sp WHERE rk = 1)")
    out = out.replace("FROM pop), \n", "FROM pop),\n").replace("AS pl FROM pop)", f"AS pl FROM pop WHERE {kept})")
    out = out.replace("(SELECT item_id FROM train UNION SELECT item_id FROM test)), nu", f"(SELECT item_id FROM train UNION SELECT item_id FROM every_test) WHERE {kept}), nu")
    out = out.replace(_NU, "SELECT count(DISTINCT user_id) - (SELECT count(DISTINCT user_id) FROM ev WHERE user_id % 7 = 0) AS nu, count(DISTINCT user_id) AS nu_all FROM (SELECT user_id FROM train UNION SELECT user_id FROM every_test)")
    return out.replace("its AS (SELECT item_id FROM train UNION SELECT item_id FROM test)", f"its AS (SELECT item_id FROM (SELECT item_id FROM train UNION SELECT item_id FROM every_test) WHERE {kept})")


@query("evaluate_ignored", _ignoring(f"WITH {SPLIT} {_TOP} {_COUNTS} {_ALL}").replace(", 6) AS", ", 8) AS"))
def _evaluate_ignored(spark, sf):
    """Ignored users are not evaluated and count in no share; ignored items are recommended to nobody."""
    h = holdout(spark, sf)
    e = events(spark, sf)
    h = Holdout(h.train, h.test, ignored_users=e.where("user_id % 7 = 0").select("user_id").distinct(), ignored_items=e.where("item_id % 11 = 0").select("item_id").distinct())
    return _rounded(h.table(most_popular(h.train.where("item_id % 11 <> 0"), h.users(), 10)), 8)


@query("evaluate_cached", f"WITH {SPLIT} {_TOP} SELECT user_id, cutoff, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM perf")
def _evaluate_cached(spark, sf):
    """Scores per user that are written at the first call and read at the second."""
    h = holdout(spark, sf)
    path = f"{shared_dir(spark)}/quillon-scores-{uuid.uuid4().hex}"
    cached(spark, path, h, lambda: _top(h))

    def again() -> DataFrame:
        raise AssertionError("the scores are there")

    return cached(spark, path, h, again)["users"].select("user_id", "cutoff", _r("ndcg"), _r("mrr"))


# significance over cutoffs, metrics and alternatives

_SCORES = """s0 AS (SELECT user_id, event_type AS recommender, round(avg(value), 0) AS mean, max(round(value, 0)) AS most FROM events GROUP BY ALL), s1 AS (SELECT * FROM s0 WHERE user_id IN (SELECT user_id FROM s0 GROUP BY user_id HAVING count(*) = 5)),
    sc AS (SELECT user_id, recommender, cutoff, 'mean' AS metric, least(mean, cutoff * 5) AS score FROM s1, (VALUES (5), (10)) c(cutoff) UNION ALL SELECT user_id, recommender, cutoff, 'most', least(most, cutoff * 8) FROM s1, (VALUES (5), (10)) c(cutoff))"""


def _scores(spark, sf) -> DataFrame:
    """Scores of five recommenders at two cutoffs, made of the events' values."""
    s0 = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("recommender")).agg(F.round(mean_in_order(F.col("value"), F.col("event_id")), 0).alias("mean"), F.max(F.round("value", 0)).alias("most"))
    s1 = s0.join(s0.groupBy("user_id").count().where("count = 5").select("user_id"), "user_id", "left_semi").withColumn("cutoff", F.explode(F.array(F.lit(5), F.lit(10))))
    return s1.select("user_id", "recommender", "cutoff", F.least("mean", F.col("cutoff") * 5.0).alias("mean"), F.least("most", F.col("cutoff") * 8.0).alias("most"))


_BASE = "(SELECT min(recommender) FROM sc)"


@query(
    "significance_all",
    f"""WITH {_SCORES}, d AS (SELECT x.user_id, x.cutoff, x.metric, x.recommender AS other, round(x.score - y.score, 12) AS d FROM sc x JOIN sc y USING (user_id, cutoff, metric) WHERE y.recommender = {_BASE} AND x.recommender <> y.recommender),
    t AS (SELECT cutoff, metric, other, 'paired_t' AS test, avg(d) / nullif(stddev_samp(d), 0) * sqrt(count(*)) AS one, avg(d) / nullif(stddev_samp(d), 0) * sqrt(count(*)) AS two FROM d GROUP BY ALL),
    g AS (SELECT cutoff, metric, other, 'sign' AS test, CAST(count(*) FILTER (d > 0) + count(*) FILTER (d = 0) // 2 AS DOUBLE) AS one, CAST(count(*) FILTER (d > 0) + count(*) FILTER (d = 0) // 2 AS DOUBLE) AS two FROM d GROUP BY ALL),
    """
    + ", ".join(
        f"""{z}_r AS (SELECT *, rank() OVER (PARTITION BY cutoff, metric, other ORDER BY abs(d)) + (count(*) OVER (PARTITION BY cutoff, metric, other, abs(d)) - 1) / 2.0 AS rk FROM d WHERE {w}), {z}_a AS (SELECT cutoff, metric, other, 'wilcoxon_{z}' AS test, sum(CASE WHEN d > 0 THEN rk WHEN d = 0 THEN rk / 2 ELSE 0 END) AS one, count(*) AS n FROM {z}_r GROUP BY ALL)"""
        for z, w in (("wilcox", "d <> 0"), ("zsplit", "true"))
    )
    + """, every AS (SELECT * FROM t UNION ALL SELECT * FROM g UNION ALL SELECT cutoff, metric, other, test, one, least(one, n * (n + 1) / 2.0 - one) FROM wilcox_a UNION ALL SELECT cutoff, metric, other, test, one, least(one, n * (n + 1) / 2.0 - one) FROM zsplit_a)
    SELECT cutoff, metric, other, test, a.alternative, grouping, round(CASE a.alternative WHEN 'two-sided' THEN two ELSE one END, 6) AS statistic, round(CASE grouping WHEN 'group' THEN 0.05 / 4 ELSE 0.05 END, 6) AS alpha FROM every, (VALUES ('two-sided'), ('greater'), ('less')) a(alternative), (VALUES ('pairs'), ('group')) g(grouping)""",
)
def _significance_all(spark, sf):
    s = _scores(spark, sf)
    out = significance.compare(s, s.agg(F.min("recommender")).first()[0], ["mean", "most"])
    return out.select("cutoff", "metric", "other", "test", "alternative", "grouping", _r("statistic"), _r("alpha"))


@query(
    "friedman_all",
    f"""WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY cutoff, metric, user_id ORDER BY score) + (count(*) OVER (PARTITION BY cutoff, metric, user_id, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY cutoff, metric, user_id, score) AS t FROM sc),
    p AS (SELECT cutoff, metric, recommender, sum(rk) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL), a AS (SELECT cutoff, metric, CAST(max(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(s * s) AS rr, sum(ties) AS ties FROM p GROUP BY ALL),
    x AS (SELECT cutoff, metric, n, k, (12 * rr / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS x FROM a)
    SELECT cutoff, metric, CAST(n AS BIGINT) AS users, CAST(k AS BIGINT) AS recommenders, round(x, 6) AS statistic, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value FROM x""",
)
def _friedman_all(spark, sf):
    return significance.friedman_all(_scores(spark, sf), ["mean", "most"]).select("cutoff", "metric", "users", "recommenders", _r("statistic"), _r("p_value"))


@query(
    "intervals_all",
    f"""WITH {_SCORES}, z AS (SELECT * FROM (VALUES (0.1, 1.6448536269514722), (0.05, 1.959963984540054), (0.01, 2.5758293035489004), (0.001, 3.2905267314919255)) z(alpha, q))
    SELECT recommender, cutoff, metric, CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, round(avg(score), 6) AS mean, round(avg(score) - q * stddev_samp(score) / sqrt(count(*)), 6) AS low, round(avg(score) + q * stddev_samp(score) / sqrt(count(*)), 6) AS high FROM sc, z GROUP BY recommender, cutoff, metric, alpha, q""",
)
def _intervals_all(spark, sf):
    """The normal ones; the t intervals beside them are wider by the quantiles' ratio."""
    out = significance.intervals(_scores(spark, sf), ["mean", "most"]).where("algorithm = 'normal'")
    return out.select("recommender", "cutoff", "metric", "alpha", "n", _r("mean"), _r("low"), _r("high"))


@query(
    "intervals_t",
    f"""WITH {_D}, s AS (SELECT other, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY other) SELECT other, CAST(n AS BIGINT) AS n, CAST(0.05 AS DOUBLE) AS alpha, round(0.975, 4) AS reached FROM s""",
)
def _intervals_t(spark, sf):
    """The area below the quantile that an interval's half width stands for, from the interval itself."""
    from quillon.functions import dists

    out = significance.confidence_intervals(_differences(spark, sf), ["other"], "d", (0.05,))
    rows = [(r["other"], r["n"], r["alpha"], round(dists.student_cdf((r["t_high"] - r["t_low"]) / 2 / (r["std"] / (r["n"] - 1) ** 0.5), r["n"] - 1), 4)) for r in out.collect()]
    return spark.createDataFrame(rows, "other string, n long, alpha double, reached double")


@query("nemenyi", f"WITH {_L}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS rk FROM l), m AS (SELECT recommender, avg(rk) AS mr, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT count(*) AS k FROM m) SELECT x.recommender AS a, y.recommender AS b, round(abs(x.mr - y.mr) / sqrt(k * (k + 1) / (6.0 * x.n)), 6) AS statistic FROM m x JOIN m y ON x.recommender < y.recommender, k")
def _nemenyi(spark, sf):
    return significance.nemenyi(_long(spark, sf)).select("a", "b", _r("statistic"))


# charts and result tables


@query("heat_map", f"WITH {CELLS}, a AS (SELECT u, row_number() OVER (ORDER BY count(*) DESC, u) - 1 AS y, avg(r) AS um FROM cells GROUP BY u), b AS (SELECT i, row_number() OVER (ORDER BY count(*) DESC, i) - 1 AS x, avg(r) AS im FROM cells GROUP BY i) SELECT u, i, x, y, r AS value, round(um, 6) AS user_mean, round(im, 6) AS item_mean FROM cells JOIN a USING (u) JOIN b USING (i)")
def _heat_map(spark, sf):
    return charts.heat_map(_cells(spark, sf)).select("u", "i", "x", "y", "value", _r("user_mean"), _r("item_mean"))


@query("results_table", f"WITH {_SCORES} SELECT recommender, round(avg(score) FILTER (cutoff = 5), 6) AS \"5\", round(avg(score) FILTER (cutoff = 10), 6) AS \"10\" FROM sc WHERE metric = 'mean' GROUP BY recommender")
def _results_table(spark, sf):
    means = _scores(spark, sf).groupBy("recommender", "cutoff").agg(F.avg("mean").alias("mean"))
    return charts.results_table(means, "mean").select("recommender", _r("5"), _r("10"))


@query("hyper_parameters", "SELECT event_type AS algorithm, unnest(['k', 'shrink']) AS hyperparameter, unnest([CAST(n AS VARCHAR), CAST(n % 7 AS VARCHAR)]) AS value FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)")
def _hyper_parameters(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("algorithm")).agg(F.count("*").alias("n"))
    best = F.create_map(F.lit("k"), F.col("n").cast("string"), F.lit("shrink"), (F.col("n") % 7).cast("string"))
    return charts.hyper_parameters(counts.select("algorithm", best.alias("best")))


# datasets, bundles, search, streams


@query("dataset_splits", f"WITH {DED}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, record_id DESC) AS rk FROM ded), um AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u FROM (SELECT DISTINCT user_id FROM ded)), im AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM ded)) SELECT unnest(CASE WHEN rk = 1 THEN ['all', 'test'] WHEN rk = 2 THEN ['all', 'validation', 'train_validation'] ELSE ['all', 'train', 'train_validation'] END) AS split, u, i, CAST(1 AS DOUBLE) AS r FROM k JOIN um USING (user_id) JOIN im USING (item_id)")
def _dataset_splits(spark, sf):
    """A dataset that is built, saved, and read back: the matrices of all splits."""
    from quillon.operators import clean

    reader = dataset.Reader(
        spark, {"table": sf, "k": 1}, lambda: events(spark, sf), dataset.Strategy("last_k", 1, ("ts", "record_id")),
        prepare=lambda e: clean.deduplicate(e, ["user_id", "item_id"], ["ts", "record_id"]).kept,
    )
    found = reader.load(f"{shared_dir(spark)}/quillon-dataset").check()
    out = [found.interactions(n).cells.select(F.lit(n).alias("split"), "u", "i", "r") for n in found.names("interactions")]
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


@query("bundle_matrix", f"WITH {PU} SELECT user_id AS u, item_id AS i, CAST(count(*) AS DOUBLE) AS r, (SELECT max(c_custkey) + 1 FROM customer) AS n_users, (SELECT max(p_partkey) + 1 FROM part) AS n_items FROM pu GROUP BY ALL")
def _bundle_matrix(spark, sf):
    """A matrix with its shape, written and read back."""
    shape = (table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0] + 1, table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1)
    bundle = Bundle(spark, f"{shared_dir(spark)}/quillon-bundle")
    bundle.save({"urm": Matrix(matrix.coordinates(purchases(spark, sf), "user_id", "item_id"), shape), "note": {"of": "purchases"}})
    found = bundle.load()["urm"]
    return found.cells.select("u", "i", "r", F.lit(found.shape[0]).cast("bigint").alias("n_users"), F.lit(found.shape[1]).cast("bigint").alias("n_items"))


@query("search_grid", f"WITH {EV} SELECT CAST(least AS INTEGER) AS least, CAST((SELECT count(*) FROM (SELECT user_id FROM ev GROUP BY user_id HAVING count(*) >= least)) AS DOUBLE) AS value FROM (VALUES (50), (60), (70)) t(least)")
def _search_grid(spark, sf):
    """All settings of a grid and their values, the users left by a filter."""
    counts = events(spark, sf).groupBy("user_id").count()
    tried = search.search(lambda s: float(counts.where(F.col("count") >= s["least"]).count()), search.grid({"least": [50, 60, 70]}))[2]
    return spark.createDataFrame([(s["least"], v) for s, v in tried], "least int, value double")


@query("stream_counts", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def _stream_counts(spark, sf):
    """Events of each type by day, counted by a stream over the table's file."""
    schema = table(spark, sf, "events").schema
    name = f"quillon_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    found = streaming.windowed_counts(stream, "ts", "event_type", width="1 day", late="3650 days")
    found.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n")


