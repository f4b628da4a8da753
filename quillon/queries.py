"""Every operator of the library as a query over the test tables, beside the SQL that it is held against.

Doubles are rounded to 6 digits on both sides. Order-dependent operators order by (ts, record_id), which is unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import metrics, significance
from quillon.operators import clean, factors, features, graph, matrix, ranking, sampling, splits
from quillon.plans import charts
from quillon.plans.evaluate import Holdout, most_popular
from quillon.scratch import written
from quillon.sources.logs import events, impressions, mean_in_order, purchases, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Common table expressions of the SQL side.
EV = """ev AS (SELECT event_id AS record_id, user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id, ts, value AS rating FROM events)"""
DED = EV + """, ded AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, record_id) = 1)"""
CELLS = EV + """, cells AS (SELECT DISTINCT user_id AS u, item_id AS i, CAST(1 AS DOUBLE) AS r FROM ev)"""
PU = """pu AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts, l_quantity AS rating, l_orderkey AS order_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SPLIT = DED + """, sp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, record_id DESC) AS rk FROM ded), train AS (SELECT user_id, item_id FROM sp WHERE rk > 1), test AS (SELECT user_id, item_id, CAST(1 AS DOUBLE) AS r FROM sp WHERE rk = 1)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("u"), F.col("item_id").alias("i")).distinct().withColumn("r", F.lit(1.0))


# cleaning

for _keep, _sql in {
    "first": "SELECT record_id, user_id, item_id FROM ded",
    "last": "SELECT record_id, user_id, item_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, record_id DESC) = 1",
    "none": "SELECT record_id, user_id, item_id FROM ev QUALIFY count(*) OVER (PARTITION BY user_id, item_id) = 1",
}.items():

    @query(f"dedup_{_keep}", f"WITH {DED} {_sql}")
    def _dedup(spark, sf, keep=_keep):
        return clean.deduplicate(events(spark, sf), ["user_id", "item_id"], ["ts", "record_id"], keep).kept.select("record_id", "user_id", "item_id")


@query("min_interactions_kept", f"WITH {EV} SELECT record_id, user_id FROM ev QUALIFY count(*) OVER (PARTITION BY user_id) >= 65")
def _least_kept(spark, sf):
    return clean.at_least(events(spark, sf), "user_id", 65).kept.select("record_id", "user_id")


@query("min_interactions_removed", f"WITH {EV} SELECT record_id, user_id FROM ev QUALIFY count(*) OVER (PARTITION BY user_id) < 65")
def _least_removed(spark, sf):
    return clean.at_least(events(spark, sf), "user_id", 65).removed.select("record_id", "user_id")


for _how, _value, _sql in (
    ("neq", 10.0, "rating <> 10"), ("eq", 25, "item_id = 25"), ("geq", 50, "item_id >= 50"), ("ge", 50, "item_id > 50"), ("leq", 50, "item_id <= 50"), ("le", 50, "item_id < 50"),
    ("isin", [1, 2, 3], "item_id IN (1, 2, 3)"), ("not_isin", [1, 2, 3], "item_id NOT IN (1, 2, 3)"),
):

    @query(f"threshold_{_how}", f"WITH {EV} SELECT record_id FROM ev WHERE {_sql}")
    def _threshold(spark, sf, how=_how, value=_value):
        return clean.threshold(events(spark, sf), "rating" if how == "neq" else "item_id", value, how).kept.select("record_id")


@query("na_kept", "SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 WHERE l_partkey IS NOT NULL")
def _na(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey")
    both = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return clean.not_null(both, "l_partkey").kept.select("o_orderkey", "l_partkey")


@query("apply_custom", f"WITH {EV} SELECT record_id, item_id % 10 AS item_id FROM ev")
def _apply(spark, sf):
    return clean.apply(events(spark, sf), "item_id", lambda c: c % 10).kept.select("record_id", "item_id")


@query("impressions_semi", "SELECT o_orderkey AS record_id, o_custkey AS user_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48)")
def _impressions_semi(spark, sf):
    kept = table(spark, sf, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").alias("record_id"))
    return clean.filter_by(impressions(spark, sf), kept, "record_id", checked=True).kept.select("record_id", "user_id")


@query("filter_by_column", f"WITH {EV} SELECT record_id, user_id FROM ev WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _filter_by_column(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return clean.filter_by(events(spark, sf), rich, "user_id").removed.select("record_id", "user_id")


@query("sample_values", f"WITH {EV}, v AS (SELECT DISTINCT user_id FROM ev), n AS (SELECT CAST(floor(count(*) * 0.3 + 1e-9) AS BIGINT) AS k FROM v), p AS (SELECT user_id, row_number() OVER (ORDER BY md5('7:' || CAST(user_id AS VARCHAR)), user_id) AS rn FROM v) SELECT record_id, user_id FROM ev WHERE user_id IN (SELECT user_id FROM p, n WHERE rn <= k)")
def _sample_values(spark, sf):
    return clean.sample_values(events(spark, sf), "user_id", 0.3, 7).kept.select("record_id", "user_id")


@query("exclude_from_evaluation", f"WITH {EV}, v AS (SELECT DISTINCT item_id FROM ev), n AS (SELECT CAST(floor(count(*) * 0.1 + 1e-9) AS BIGINT) AS k FROM v), p AS (SELECT item_id, row_number() OVER (ORDER BY md5('3:' || CAST(item_id AS VARCHAR)), item_id) AS rn FROM v) SELECT item_id FROM p, n WHERE rn <= k")
def _exclude(spark, sf):
    return clean.left_out(events(spark, sf), "item_id", 0.1, 3)


@query("ensure_num_records", f"WITH {DED} SELECT user_id, count(*) AS n_items FROM ded GROUP BY user_id HAVING count(*) <> 50")
def _wrong_counts(spark, sf):
    kept = clean.deduplicate(events(spark, sf), ["user_id", "item_id"], ["ts", "record_id"]).kept
    return clean.wrong_counts(kept, "user_id", "item_id", 50)


@query(
    "filter_report",
    f"""WITH {EV}, m AS (SELECT *, rating >= 20 AS k FROM ev), t AS (
    SELECT 'records' AS subject, count(*) AS original, count(*) FILTER (k) AS n_new, count(*) FILTER (NOT k) AS affected FROM m
    UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(DISTINCT user_id) FILTER (k), count(DISTINCT user_id) FILTER (NOT k) FROM m
    UNION ALL SELECT 'item_id', count(DISTINCT item_id), count(DISTINCT item_id) FILTER (k), count(DISTINCT item_id) FILTER (NOT k) FROM m)
    SELECT subject, original, n_new AS "new", affected, original - n_new AS removed, round(100.0 * n_new / original, 6) AS new_pct, round(100.0 * affected / original, 6) AS affected_pct, round(100.0 * (original - n_new) / original, 6) AS removed_pct FROM t""",
)
def _filter_report(spark, sf):
    r = clean.threshold(events(spark, sf), "rating", 20.0, "geq").report()
    return r.select("subject", "original", "new", "affected", "removed", _r("new_pct"), _r("affected_pct"), _r("removed_pct"))


for _how, _sql in {
    "left": "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000",
    "inner": "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000",
    "right": "SELECT n_name, s_suppkey FROM nation RIGHT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON n_nationkey = s_nationkey",
}.items():

    @query(f"merge_{_how}", _sql)
    def _merge(spark, sf, how=_how):
        s = table(spark, sf, "supplier").where("s_acctbal > 9000")
        return clean.merge(table(spark, sf, "nation"), s, how, ["n_nationkey"], ["s_nationkey"])[0].select("n_name", "s_suppkey")


@query("merge_removed", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def _merge_removed(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 9000")
    return clean.merge(table(spark, sf, "nation"), s, "inner", ["n_nationkey"], ["s_nationkey"])[1].select("n_nationkey", "n_name")


# splits


@query("split_time", f"WITH {EV} SELECT record_id, CASE WHEN item_id <= 70 THEN 'train' ELSE 'test' END AS split FROM ev")
def _split_time(spark, sf):
    return splits.by_threshold(events(spark, sf), "item_id", 70).rows.select("record_id", "split")


@query("split_last_k", f"WITH {EV} SELECT record_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, record_id DESC) <= 2 THEN 'test' ELSE 'train' END AS split FROM ev")
def _split_last(spark, sf):
    return splits.last_k(events(spark, sf), "user_id", ["ts", "record_id"], 2).rows.select("record_id", "user_id", "split")


@query("split_three_way", f"WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, record_id DESC) AS rk FROM ev) SELECT record_id, user_id, CASE WHEN rk = 1 THEN 'test' WHEN rk = 2 THEN 'validation' ELSE 'train' END AS split FROM k")
def _split_three(spark, sf):
    return splits.last_k(events(spark, sf), "user_id", ["ts", "record_id"], 1, validation=True).rows.select("record_id", "user_id", "split")


@query(
    "split_violations",
    f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, record_id DESC) AS rk FROM ev),
    s AS (SELECT DISTINCT user_id, item_id, CASE WHEN rk = 1 THEN 'test' WHEN rk = 2 THEN 'validation' ELSE 'train' END AS split FROM k),
    c AS (SELECT user_id, item_id, count(*) AS n, count(*) FILTER (split = 'test') AS t FROM s GROUP BY ALL)
    SELECT 'disjoint' AS "check", count(*) FILTER (n > 1) AS violations FROM c UNION ALL SELECT 'disjoint_test', count(*) FILTER (n > 1 AND t > 0) FROM c
    UNION ALL SELECT 'leave_1_validation', CAST(0 AS BIGINT) UNION ALL SELECT 'leave_1_test', CAST(0 AS BIGINT)""",
)
def _split_violations(spark, sf):
    return splits.last_k(events(spark, sf), "user_id", ["ts", "record_id"], 1, validation=True).violations("user_id", "item_id", 1)


# features


@query("feat_frequency", f"WITH {EV} SELECT user_id, item_id, count(*) AS frequency FROM ev GROUP BY ALL")
def _frequency(spark, sf):
    return features.frequency(events(spark, sf), "user_id", "item_id")


@query("feat_frequency_lists", "SELECT o_custkey AS user_id, l_partkey AS items, count(*) AS frequency FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def _frequency_lists(spark, sf):
    return features.frequency(impressions(spark, sf), "user_id", "items")


_SEEN = EV + """, d AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS s, count(*) OVER (PARTITION BY user_id, item_id) AS n FROM ev WINDOW w AS (PARTITION BY user_id, item_id ORDER BY ts, record_id))"""
_UNITS = "round(nullif(s, 0), 6) AS last_seen_seconds, round(nullif(s / 60, 0), 6) AS last_seen_minutes, round(nullif(s / 3600, 0), 6) AS last_seen_hours, round(nullif(s / 86400, 0), 6) AS last_seen_days, round(nullif(s / 604800, 0), 6) AS last_seen_weeks"


@query("feat_last_seen_v1", f"WITH {_SEEN} SELECT record_id, {_UNITS} FROM d WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, record_id DESC) = 1")
def _seen_1(spark, sf):
    out = features.last_seen(events(spark, sf), "user_id", "item_id", "ts", "record_id").kept
    return out.select("record_id", *[_r(f"last_seen_{u}") for u in features.UNITS])


@query("feat_last_seen_v2", f"WITH {_SEEN}, x AS (SELECT * FROM d WHERE s <> 0) SELECT record_id, {_UNITS} FROM x QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, record_id DESC) = 1")
def _seen_2(spark, sf):
    out = features.last_seen(events(spark, sf), "user_id", "item_id", "ts", "record_id", skip_null=True).kept
    return out.select("record_id", *[_r(f"last_seen_{u}") for u in features.UNITS])


@query("feat_last_seen_numeric", f"WITH {EV}, d AS (SELECT *, record_id - lag(record_id) OVER (PARTITION BY user_id, item_id ORDER BY record_id) AS x, count(*) OVER (PARTITION BY user_id, item_id) AS n FROM ev) SELECT user_id, item_id, x AS last_seen_euclidean FROM d WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY record_id DESC) = 1")
def _seen_numeric(spark, sf):
    e = events(spark, sf).withColumn("step", F.col("record_id"))
    return features.last_seen(e, "user_id", "item_id", "step", "record_id").kept.select("user_id", "item_id", "last_seen_euclidean")


_LISTS = """l AS (SELECT o_orderkey AS record_id, o_custkey AS user_id, l_partkey AS items, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey) - 1 AS INTEGER) AS position FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
for _keep, _order in (("first", ""), ("last", " DESC")):

    @query(f"feat_position_{_keep}", f"WITH {_LISTS} SELECT user_id, items, position FROM l QUALIFY row_number() OVER (PARTITION BY user_id, items ORDER BY record_id{_order}, position{_order}) = 1")
    def _position(spark, sf, keep=_keep):
        return features.position(impressions(spark, sf), "user_id", "items", "record_id", keep=keep).kept.select("user_id", "items", "position")

    @query(f"feat_timestamp_{_keep}", f"WITH {EV} SELECT user_id, item_id, round(date_diff('microsecond', TIMESTAMP '1970-01-01', ts) / 1e6, 6) AS seconds FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts{_order}, record_id{_order}) = 1")
    def _timestamp(spark, sf, keep=_keep):
        return features.timestamp(events(spark, sf), "user_id", "item_id", "ts", "record_id", keep=keep).kept.select("user_id", "item_id", _r("seconds"))


# matrices and statistics


@query("mapper", f"WITH {PU} SELECT item_id AS orig_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM pu)")
def _mapper(spark, sf):
    return matrix.mapper(purchases(spark, sf), "item_id")


_URM = PU + """, um AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM pu)), im AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM pu))"""


@query("urm_coo", f"WITH {_URM} SELECT um.idx AS u, im.idx AS i, round(sum(rating), 6) AS r FROM pu JOIN um USING (user_id) JOIN im USING (item_id) GROUP BY ALL")
def _urm(spark, sf):
    p = purchases(spark, sf)
    return matrix.coordinates(p, "user_id", "item_id", "rating", users=matrix.mapper(p, "user_id"), item_ids=matrix.mapper(p, "item_id")).select("u", "i", _r("r"))


@query("urm_binarized", f"WITH {PU} SELECT DISTINCT user_id AS u, item_id AS i, CAST(1 AS DOUBLE) AS r FROM pu")
def _urm_binary(spark, sf):
    return matrix.coordinates(purchases(spark, sf), "user_id", "item_id", "rating", binarize=True)


@query("urm_from_lists", f"WITH {PU} SELECT user_id AS u, item_id AS i, CAST(count(*) AS DOUBLE) AS r FROM pu GROUP BY ALL")
def _urm_lists(spark, sf):
    return matrix.coordinates(impressions(spark, sf), "user_id", "items")


@query("mapper_symmetric_difference", f"WITH {EV}, a AS (SELECT item_id AS orig_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ev)), b AS (SELECT item_id AS orig_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ev WHERE item_id <> 50)) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _mappers_differ(spark, sf):
    e = events(spark, sf)
    return matrix.same_mappers(matrix.mapper(e, "item_id"), matrix.mapper(e.where("item_id <> 50"), "item_id"))


@query("item_popularity", f"WITH {PU}, n AS (SELECT item_id, count(DISTINCT user_id) AS n FROM pu GROUP BY ALL) SELECT p_partkey AS i, coalesce(n, 0) AS n FROM part LEFT JOIN n ON p_partkey = item_id")
def _popularity(spark, sf):
    cells = matrix.coordinates(purchases(spark, sf), "user_id", "item_id")
    return matrix.popularity(cells, table(spark, sf, "part").select(F.col("p_partkey").alias("i")))


@query("matrix_statistics", f"WITH {PU}, c AS (SELECT user_id, item_id, sum(rating) AS r FROM pu GROUP BY ALL) SELECT count(*) AS nnz, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(DISTINCT r) AS \"values\" FROM c")
def _matrix_statistics(spark, sf):
    return matrix.statistics(purchases(spark, sf), "user_id", "item_id", "rating")


@query("validate_implicit", f"WITH {EV} SELECT user_id AS u, item_id AS i, CAST(count(*) AS DOUBLE) AS r FROM ev GROUP BY ALL HAVING count(*) <> 1")
def _validate_implicit(spark, sf):
    return matrix.implicit_violations(matrix.coordinates(events(spark, sf), "user_id", "item_id"))


@query("validate_leave_k", f"WITH {EV}, c AS (SELECT user_id AS u, count(DISTINCT item_id) AS n FROM ev GROUP BY ALL) SELECT c_custkey AS u, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON c_custkey = u WHERE coalesce(n, 0) <> 50")
def _validate_leave(spark, sf):
    return matrix.leave_k_violations(_cells(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("u")), 50)


@query("validate_disjoint", f"WITH {EV} SELECT user_id AS u, item_id AS i, CAST(2 AS BIGINT) AS n FROM (SELECT user_id, item_id FROM ev WHERE record_id % 2 = 0 INTERSECT SELECT user_id, item_id FROM ev WHERE record_id % 2 = 1)")
def _validate_disjoint(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("u"), F.col("item_id").alias("i"), "record_id")
    return matrix.overlap(e.where("record_id % 2 = 0"), e.where("record_id % 2 = 1"))


@query(
    "validate_consistency",
    f"""WITH {EV}, c AS (SELECT user_id, item_id, count(*) AS r FROM ev GROUP BY ALL) SELECT 'not_empty' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'implicit', count(*) FROM c WHERE r <> 1
    UNION ALL SELECT * FROM (VALUES ('users_in_range', CAST(0 AS BIGINT)), ('users_bijective', 0), ('items_in_range', 0), ('items_bijective', 0))""",
)
def _validate_consistency(spark, sf):
    e = events(spark, sf)
    u, i = matrix.mapper(e, "user_id"), matrix.mapper(e, "item_id")
    return matrix.consistency(matrix.coordinates(e, "user_id", "item_id", users=u, item_ids=i), u, i)


_GINI = "(SELECT (2.0 * sum(rn * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) FROM (SELECT n, row_number() OVER (ORDER BY n) AS rn FROM {0}))"


@query(
    "matrix_stats",
    f"""WITH {PU}, c AS (SELECT DISTINCT user_id, item_id FROM pu), un AS (SELECT coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM c GROUP BY ALL) ON c_custkey = user_id),
    im AS (SELECT coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT item_id, count(*) AS n FROM c GROUP BY ALL) ON p_partkey = item_id)
    SELECT (SELECT count(*) FROM c) AS nnz, CAST(1 AS DOUBLE) AS min_value, CAST(1 AS DOUBLE) AS max_value, a.*, round({_GINI.format('un')}, 6) AS gini_user, b.*, round((SELECT count(*) FROM c) / (n_users * n_items), 6) AS density
    FROM (SELECT count(*) AS n_users, min(n) AS min_user, round(avg(n), 6) AS mean_user, round(stddev_pop(n), 6) AS std_user, max(n) AS max_user FROM un) a, (SELECT count(*) AS n_items, min(n) AS min_item, round(avg(n), 6) AS mean_item, round(stddev_pop(n), 6) AS std_item, max(n) AS max_item FROM im) b""",
)
def _matrix_stats(spark, sf):
    cells = matrix.coordinates(purchases(spark, sf), "user_id", "item_id", binarize=True)
    out = matrix.matrix_describe(cells, table(spark, sf, "customer").select(F.col("c_custkey").alias("u")), table(spark, sf, "part").select(F.col("p_partkey").alias("i")))
    return out.select(*[_r(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])


@query(
    "profile_describe",
    f"""WITH {PU}, p AS (SELECT item_id, count(DISTINCT user_id) AS n FROM pu GROUP BY ALL), m AS (SELECT avg(n) AS a, count(*) AS k FROM p)
    SELECT (SELECT k FROM m) AS nobs, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance,
    round(avg((n - a) ** 3) / pow(avg((n - a) ** 2), 1.5), 6) AS skewness, round(avg((n - a) ** 4) / pow(avg((n - a) ** 2), 2) - 3, 6) AS kurtosis, round(stddev_pop(n), 6) AS std, round({_GINI.format('p')}, 6) AS gini FROM p, m""",
)
def _profile_describe(spark, sf):
    out = matrix.profile_describe(matrix.profiles(matrix.coordinates(purchases(spark, sf), "user_id", "item_id"), "i"))
    return out.select(*[_r(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in out.schema])


@query("gini", f"WITH {EV}, p AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY n) AS rn FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) SELECT event_type, round((2.0 * sum(rn * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)), 6) AS gini FROM p GROUP BY event_type")
def _gini(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return matrix.gini(counts, "event_type").select("event_type", _r("gini"))


@query(
    "compare_frames",
    f"""WITH {EV}, b AS (SELECT * FROM ev WHERE item_id < 60), x AS (SELECT 'records' AS subject, CAST(count(*) AS DOUBLE) AS base FROM ev UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM ev UNION ALL SELECT 'item_id', count(DISTINCT item_id) FROM ev),
    y AS (SELECT 'records' AS subject, CAST(count(*) AS DOUBLE) AS other FROM b UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM b UNION ALL SELECT 'item_id', count(DISTINCT item_id) FROM b)
    SELECT subject, base, other, other - base AS difference, round(100 * (other - base) / base, 6) AS difference_pct FROM x JOIN y USING (subject)""",
)
def _compare_frames(spark, sf):
    e = events(spark, sf)
    return matrix.compare_frames(e, e.where("item_id < 60"), ["user_id", "item_id"]).select("subject", "base", "other", "difference", _r("difference_pct"))


@query(
    "compare_matrices",
    f"""WITH {CELLS}, p AS (SELECT 'base' AS side, 'user' AS axis, u AS id, count(*) AS n FROM cells GROUP BY ALL UNION ALL SELECT 'base', 'item', i, count(*) FROM cells GROUP BY ALL UNION ALL SELECT 'other', 'user', u, count(*) FROM cells WHERE i < 60 GROUP BY ALL UNION ALL SELECT 'other', 'item', i, count(*) FROM cells WHERE i < 60 GROUP BY ALL),
    g AS (SELECT side, axis, count(*) AS nobs, CAST(max(n) AS DOUBLE) AS mx, avg(n) AS mean, stddev_pop(n) AS sd FROM p GROUP BY ALL),
    v AS (SELECT side, axis, 'nobs' AS statistic, CAST(nobs AS DOUBLE) AS value FROM g UNION ALL SELECT side, axis, 'max', mx FROM g UNION ALL SELECT side, axis, 'mean', mean FROM g UNION ALL SELECT side, axis, 'std', sd FROM g)
    SELECT axis, statistic, round(a.value, 6) AS base, round(b.value, 6) AS other, round(b.value - a.value, 6) AS difference, round(100 * (b.value - a.value) / a.value, 6) AS difference_pct FROM (SELECT * FROM v WHERE side = 'base') a JOIN (SELECT * FROM v WHERE side = 'other') b USING (axis, statistic)""",
)
def _compare_matrices(spark, sf):
    c = _cells(spark, sf)
    out = matrix.compare_matrices(c, c.where("i < 60")).where(F.col("statistic").isin("nobs", "max", "mean", "std"))
    return out.select("axis", "statistic", *[_r(x) for x in ("base", "other", "difference", "difference_pct")])


@query("value_counts", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY ALL")
def _value_counts(spark, sf):
    return matrix.value_counts(table(spark, sf, "events"), "event_type").select("value", "n", _r("share"))


_PCT = ", ".join(f"('{round(100 * p)}%', {p})" for p in matrix.PERCENTILES)


@query(
    "percentiles",
    "SELECT 'l_quantity' AS \"column\", s AS statistic, round(CASE s WHEN 'count' THEN (SELECT count(l_quantity) FROM lineitem) WHEN 'mean' THEN (SELECT avg(l_quantity) FROM lineitem) WHEN 'std' THEN (SELECT stddev_samp(l_quantity) FROM lineitem) WHEN 'min' THEN (SELECT min(l_quantity) FROM lineitem) WHEN 'max' THEN (SELECT max(l_quantity) FROM lineitem) END, 6) AS value FROM (VALUES ('count'), ('mean'), ('std'), ('min'), ('max')) t(s) UNION ALL "
    + " UNION ALL ".join(f"SELECT 'l_quantity', '{round(100 * p)}%', round(quantile_cont(l_quantity, {p}), 6) FROM lineitem" for p in matrix.PERCENTILES),
)
def _percentiles(spark, sf):
    return matrix.describe(table(spark, sf, "lineitem"), ["l_quantity"]).select("column", "statistic", _r("value"))


@query("schema_report", "SELECT * FROM (VALUES ('r_regionkey', 'int', CAST(0 AS BIGINT)), ('r_name', 'string', 0)) t(\"column\", type, nulls)")
def _schema_report(spark, sf):
    return matrix.schema_report(table(spark, sf, "region"))


# chart data


@query("popularity_curve", f"WITH {PU}, c AS (SELECT item_id AS value, count(*) AS n FROM pu GROUP BY ALL) SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM c")
def _popularity_curve(spark, sf):
    return charts.popularity_curve(purchases(spark, sf), "item_id")


for _by, _sql in {
    "hour": "CAST(hour(ts) AS INTEGER)", "day_name": "dayname(ts)", "date": "strftime(ts, '%Y-%m-%d')", "minute": "CAST(minute(ts) AS INTEGER)",
    "round_hour": "strftime(date_trunc('hour', ts + INTERVAL 30 MINUTE), '%Y-%m-%d %H')", "round_minute": "strftime(date_trunc('minute', ts + INTERVAL 30 SECOND), '%Y-%m-%d %H:%M')",
}.items():

    @query(f"hist_{_by}", f"SELECT {_sql} AS part, count(*) AS n FROM events GROUP BY ALL")
    def _hist(spark, sf, by=_by):
        return charts.histogram(table(spark, sf, "events"), "ts", by)


@query("profile_curves", f"WITH {EV}, c AS (SELECT 'events' AS dataset, user_id AS id, count(*) AS n, count(*) / (SELECT count(*) FROM ev) AS share FROM ev GROUP BY ALL) SELECT dataset, id, n, round(share, 6) AS share, row_number() OVER (ORDER BY n DESC, id) AS place FROM c")
def _profile_curves(spark, sf):
    return charts.profile_curves({"events": events(spark, sf)}, "user_id").select("dataset", "id", "n", _r("share"), "place")


@query("records_by_dataset", f"WITH {EV}, {PU} SELECT 'events' AS dataset, count(*) AS records, (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM ev)) AS distinct_records FROM ev UNION ALL SELECT 'purchases', count(*), (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM pu)) FROM pu")
def _records(spark, sf):
    return charts.records({"events": events(spark, sf), "purchases": purchases(spark, sf)}, ["user_id", "item_id"])


@query("min_max_weights", "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 6) AS o_totalprice FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def _min_max(spark, sf):
    return charts.min_max(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]).select("o_orderkey", _r("o_totalprice"))


@query("blank_zeros", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN abs(l_discount) > 1e-8 THEN l_discount END AS l_discount FROM lineitem")
def _blank(spark, sf):
    return charts.blank_zeros(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount"), "l_discount")


# metrics and evaluation

_TOP = """, pop AS (SELECT item_id, count(*) AS n FROM train GROUP BY ALL), place AS (SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS pl FROM pop),
    free AS (SELECT user_id, place.item_id, pl, CAST(n AS DOUBLE) AS score FROM test, place WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = test.user_id AND t.item_id = place.item_id)),
    recs AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY pl) AS pos FROM free QUALIFY pos <= 10),
    j AS (SELECT recs.*, coalesce(t.r, 0) AS rel, CASE WHEN coalesce(t.r, 0) > 0 THEN 1 ELSE 0 END AS hit FROM recs LEFT JOIN test t USING (user_id, item_id)),
    js AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY pos) AS hits FROM j),
    nnz AS (SELECT sum(n) AS nnz FROM pop), ni AS (SELECT count(DISTINCT item_id) AS ni FROM (SELECT item_id FROM train UNION SELECT item_id FROM test)), nu AS (SELECT count(DISTINCT user_id) AS nu FROM (SELECT user_id FROM train UNION SELECT user_id FROM test)),
    cut AS (SELECT unnest([5, 10]) AS cutoff),
    per AS (SELECT user_id, cutoff, sum(hit) / count(*) AS "precision", sum(hit) / 1.0 AS recall, sum(hit * hits / pos) / count(*) AS map, sum((pow(2, rel) - 1) / log2(pos + 1)) AS ndcg, coalesce(1 / min(CASE WHEN hit = 1 THEN pos END), 0) AS mrr,
        max(hit) AS hit_rate, sum(hit / pos) AS arhr, sum(CASE WHEN pop.n > 0 THEN -log2(pop.n / nnz) ELSE 0 END) / max(ni) AS novelty, coalesce(max(cutoff) - min(CASE WHEN hit = 1 THEN pos END) + 1, 0) AS position_first_relevant
        FROM js LEFT JOIN pop USING (item_id), nnz, ni, cut WHERE pos <= cutoff GROUP BY user_id, cutoff),
    perf AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1 FROM per)"""


def holdout(spark: SparkSession, sf: str) -> Holdout:
    kept = clean.deduplicate(events(spark, sf), ["user_id", "item_id"], ["ts", "record_id"]).kept
    s = splits.last_k(kept, "user_id", ["ts", "record_id"], 1)
    return Holdout(s.train.select("user_id", "item_id"), s.test.select("user_id", "item_id", F.lit(1.0).alias("r"))).written()


def _top(h: Holdout) -> DataFrame:
    return most_popular(h.train, h.users(), 10)


@query("recommend_toppop", f"WITH {SPLIT} {_TOP} SELECT user_id, item_id, CAST(pos AS INTEGER) AS pos, score FROM recs")
def _recommend_toppop(spark, sf):
    return _top(holdout(spark, sf)).select("user_id", "item_id", F.col("pos").cast("int").alias("pos"), "score")


_PER = ("precision", "recall", "map", "ndcg", "mrr", "arhr", "f1", "novelty")


@query("metrics_per_user", f"WITH {SPLIT} {_TOP} SELECT user_id, cutoff, " + ", ".join(f'round("{m}", 6) AS "{m}"' for m in _PER) + ", CAST(hit_rate AS INTEGER) AS hit_rate, CAST(position_first_relevant AS INTEGER) AS position_first_relevant FROM perf")
def _metrics_per_user(spark, sf):
    h = holdout(spark, sf)
    return h.scores(_top(h)).select("user_id", "cutoff", *[_r(m) for m in _PER], "hit_rate", "position_first_relevant")


@query("metrics_mean", f"WITH {SPLIT} {_TOP} SELECT cutoff, " + ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in _PER if m != "f1") + ", round(avg(f1), 6) AS f1_mean FROM perf GROUP BY cutoff")
def _metrics_mean(spark, sf):
    h = holdout(spark, sf)
    return metrics.mean_metrics(h.scores(_top(h)), h.all_users().count()).select("cutoff", *[_r(m) for m in _PER if m != "f1"], _r("f1_mean"))


@query("user_coverage", f"WITH {SPLIT} {_TOP} SELECT cutoff, round(count(*) / max(nu), 6) AS coverage_user, round(sum(hit_rate) / max(nu), 6) AS coverage_user_hit FROM perf, nu GROUP BY cutoff")
def _user_coverage(spark, sf):
    h = holdout(spark, sf)
    return metrics.mean_metrics(h.scores(_top(h)), h.all_users().count()).select("cutoff", _r("coverage_user"), _r("coverage_user_hit"))


_COUNTS = """, its AS (SELECT item_id FROM train UNION SELECT item_id FROM test), cnt AS (SELECT cutoff, item_id, count(pos) AS c FROM (SELECT * FROM its, cut) LEFT JOIN recs USING (item_id) WHERE pos IS NULL OR pos <= cutoff GROUP BY ALL),
    full_c AS (SELECT cut.cutoff, its.item_id, coalesce(c, 0) AS c FROM its CROSS JOIN cut LEFT JOIN cnt ON cnt.cutoff = cut.cutoff AND cnt.item_id = its.item_id),
    sh AS (SELECT cutoff, item_id, c, c / sum(c) OVER (PARTITION BY cutoff) AS p, row_number() OVER (PARTITION BY cutoff ORDER BY c, item_id) AS j, count(*) OVER (PARTITION BY cutoff) AS n FROM full_c)"""


@query("item_coverage_diversity", f"WITH {SPLIT} {_TOP} {_COUNTS} SELECT cutoff, round(count(*) FILTER (c > 0) / count(*), 6) AS coverage_item, round(2 * sum((n + 1 - j) / (n + 1) * p), 6) AS diversity_gini, round(1 - sum(p * p), 6) AS diversity_herfindahl, round(sum(CASE WHEN c > 0 THEN -p * log2(p) ELSE 0 END), 6) AS shannon_entropy FROM sh GROUP BY cutoff")
def _item_diversity(spark, sf):
    h = holdout(spark, sf)
    out = metrics.diversity(metrics.item_counts(_top(h), h.evaluated_test(), h.items(), [5, 10]), "n_rec", "cutoff")
    return out.select("cutoff", *[_r(c) for c in out.columns if c != "cutoff"])


@query("novelty_train", f"WITH {SPLIT} {_TOP} SELECT round(sum(-n * log2(n / nnz)) / max(ni) / max(nu), 6) AS novelty_train FROM pop, nnz, ni, nu")
def _novelty_train(spark, sf):
    h = holdout(spark, sf)
    return metrics.train_novelty(h.train, h.all_users().count(), h.items().count()).select(_r("novelty_train"))


@query("evaluate_toppop", f"WITH {SPLIT} {_TOP} SELECT cutoff, round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(\"precision\"), 6) AS \"precision\", round(avg(recall), 6) AS recall, round(2 * avg(\"precision\") * avg(recall) / (avg(\"precision\") + avg(recall)), 6) AS f1 FROM perf GROUP BY cutoff")
def _evaluate_toppop(spark, sf):
    h = holdout(spark, sf)
    return h.table(_top(h)).select("cutoff", *[_r(m) for m in ("hit_rate", "mrr", "ndcg", "precision", "recall", "f1")])


# similarity models and scoring

_WALK = """, du AS (SELECT u, sum(r) AS nu FROM cells GROUP BY u), di AS (SELECT i, count(*) AS d FROM cells GROUP BY i),
    w0 AS (SELECT a.i AS i, b.i AS j, sum({0}) AS w FROM cells a JOIN cells b ON a.u = b.u AND a.i <> b.i JOIN du ON du.u = a.u JOIN di ON di.i = a.i JOIN di dj ON dj.i = b.i GROUP BY a.i, b.i),
    w AS (SELECT i, j, w FROM w0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(w, 12) DESC, j) <= 20)"""


@query("p3alpha_topk", f"WITH {CELLS} {_WALK.format('pow(1.0 / di.d, 1.5) * pow(b.r / du.nu, 1.5)')} SELECT i, j, round(w, 6) AS w FROM w")
def _p3(spark, sf):
    return graph.p3_alpha(_cells(spark, sf), k=20, alpha=1.5).select("i", "j", _r("w"))


@query("rp3beta_topk", f"WITH {CELLS} {_WALK.format('(1.0 / di.d) * (b.r / du.nu) * pow(dj.d, -0.5)')} SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM w")
def _rp3(spark, sf):
    return graph.p3_alpha(_cells(spark, sf), k=20, beta=0.5, normalize=True).select("i", "j", _r("w"))


@query("p3alpha_purchases", f"WITH {PU}, cells AS (SELECT DISTINCT user_id AS u, item_id AS i, CAST(1 AS DOUBLE) AS r FROM pu) {_WALK.format('(1.0 / di.d) * (b.r / du.nu)')} SELECT i, j, round(w, 6) AS w FROM w")
def _p3_purchases(spark, sf):
    cells = purchases(spark, sf).select(F.col("user_id").alias("u"), F.col("item_id").alias("i")).distinct().withColumn("r", F.lit(1.0))
    return graph.p3_alpha_symmetric(cells, k=20).select("i", "j", _r("w"))


@query("itemknn_topk", f"WITH {EV}, cells AS (SELECT user_id AS u, item_id AS i, CAST(count(*) AS DOUBLE) AS r FROM ev GROUP BY ALL), nm AS (SELECT i, sqrt(sum(r * r)) AS n FROM cells GROUP BY i), s AS (SELECT a.i, b.i AS j, sum(a.r * b.r) / (max(x.n) * max(y.n) + 2) AS w FROM cells a JOIN cells b ON a.u = b.u AND a.i <> b.i JOIN nm x ON x.i = a.i JOIN nm y ON y.i = b.i GROUP BY a.i, b.i) SELECT i, j, round(w, 6) AS w FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(w, 12) DESC, j) <= 3")
def _knn(spark, sf):
    return graph.item_knn(matrix.coordinates(events(spark, sf), "user_id", "item_id"), k=3, shrink=2.0).select("i", "j", _r("w"))


_SCORED = """, s AS (SELECT c.u, w.j, sum(c.r * w.w) AS score FROM cells c JOIN w ON w.i = c.i WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.u = c.u AND x.i = w.j) GROUP BY c.u, w.j),
    recs3 AS (SELECT u AS user_id, j AS item_id, CAST(row_number() OVER (PARTITION BY u ORDER BY round(score, 12) DESC, j) AS INTEGER) AS pos, score FROM s QUALIFY pos <= 10)"""


@query("recommend_p3alpha", f"WITH {CELLS} {_WALK.format('(1.0 / di.d) * (b.r / du.nu)')} {_SCORED} SELECT user_id, item_id, pos, round(score, 6) AS score FROM recs3")
def _recommend_p3(spark, sf):
    cells = _cells(spark, sf)
    return graph.recommend_from(cells, graph.p3_alpha(cells, k=20), 10).select("user_id", "item_id", F.col("pos").cast("int").alias("pos"), _r("score"))


_TRAIN_CELLS = SPLIT + ", cells AS (SELECT user_id AS u, item_id AS i, CAST(1 AS DOUBLE) AS r FROM train)"


@query("evaluate_p3alpha", f"WITH {_TRAIN_CELLS} {_WALK.format('(1.0 / di.d) * (b.r / du.nu)')} {_SCORED}, cut AS (SELECT unnest([5, 10]) AS cutoff), e AS (SELECT t.user_id, cutoff, max(CASE WHEN x.pos <= cutoff THEN 1.0 / x.pos ELSE 0 END) AS mrr FROM test t CROSS JOIN cut LEFT JOIN recs3 x ON x.user_id = t.user_id AND x.item_id = t.item_id GROUP BY ALL) SELECT cutoff, round(avg(CASE WHEN mrr > 0 THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(mrr, 0)), 6) AS mrr FROM e GROUP BY cutoff")
def _evaluate_p3(spark, sf):
    h = holdout(spark, sf)
    cells = h.train.select(F.col("user_id").alias("u"), F.col("item_id").alias("i"), F.lit(1.0).alias("r"))
    recs = graph.recommend_from(cells, graph.p3_alpha(cells, k=20), 10)
    return h.table(recs).select("cutoff", _r("hit_rate"), _r("mrr"))


@query("mf_topk", "SELECT a.vec_id AS user_id, b.vec_id AS item_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) DESC, b.vec_id) AS INTEGER) AS pos, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id QUALIFY pos <= 10")
def _mf_topk(spark, sf):
    """The ten best other vectors of each vector."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("factors"), F.lit(0.0).alias("bias"))
    seen = e.select(F.col("id").alias("u"), F.col("id").alias("i"))
    return factors.recommend(factors.Factors(e, e), seen, 10).select("user_id", "item_id", F.col("pos").cast("int").alias("pos"), _r("score"))


@query("rank_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d') AS shipped, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS rank FROM lineitem")
def _rank_rows(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("rest", F.struct("l_partkey", "l_suppkey", "l_shipdate"))
    out = ranking.rank_rows(li, "l_orderkey", "rest", ["l_extendedprice", "l_linenumber"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), F.col("rank").cast("int").alias("rank"))


@query("normalized_adjacency", f"WITH {CELLS}, a AS (SELECT u, count(*) AS du FROM cells GROUP BY u), b AS (SELECT i, count(*) AS di FROM cells GROUP BY i), e AS (SELECT 'u' || u AS src, 'i' || i AS dst, round(1 / sqrt(du * di), 6) AS norm FROM cells JOIN a USING (u) JOIN b USING (i)) SELECT * FROM e UNION ALL SELECT dst, src, norm FROM e")
def _adjacency(spark, sf):
    return graph.normalized_adjacency(_cells(spark, sf)).select("src", "dst", _r("norm"))


@query(
    "lightgcn_propagate",
    f"""WITH {CELLS}, a AS (SELECT u, count(*) AS du FROM cells GROUP BY u), b AS (SELECT i, count(*) AS di FROM cells GROUP BY i), e0 AS (SELECT 'u' || u AS src, 'i' || i AS dst, 1 / sqrt(du * di) AS norm FROM cells JOIN a USING (u) JOIN b USING (i)),
    e AS (SELECT * FROM e0 UNION ALL SELECT dst, src, norm FROM e0), v0 AS (SELECT id, unnest([0, 1]) AS k, (length(id) + CAST(substr(id, 2) AS BIGINT) % 7 + k * 3) / 10.0 AS x FROM (SELECT DISTINCT src AS id FROM e)),
    v1 AS (SELECT dst AS id, k, sum(norm * x) AS x FROM e JOIN v0 ON v0.id = src GROUP BY ALL), v2 AS (SELECT dst AS id, k, sum(norm * x) AS x FROM e JOIN v1 ON v1.id = src GROUP BY ALL)
    SELECT id, CAST(k AS INTEGER) AS k, round((v0.x + v1.x + v2.x) / 3, 6) AS x FROM v0 JOIN v1 USING (id, k) JOIN v2 USING (id, k)""",
)
def _propagate(spark, sf):
    adjacency = graph.normalized_adjacency(_cells(spark, sf))
    base = (F.length("id") + F.substring("id", 2, 20).cast("bigint") % 7).cast("double")
    vectors = adjacency.select(F.col("src").alias("id")).distinct().select("id", F.array(*[(base + k * 3) / 10.0 for k in (0, 1)]).alias("vector"))
    return graph.propagate(adjacency, vectors, 2, 2).select("id", F.posexplode("vector").alias("k", "x")).select("id", "k", _r("x"))


# significance

_D = """d AS (SELECT user_id, CASE WHEN event_type IN (SELECT min(event_type) FROM events) THEN 'a' ELSE 'b' END AS other, round(avg(value) - 50, 1) AS d FROM events GROUP BY ALL)"""


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    least = e.agg(F.min("event_type").alias("least"))
    mean = mean_in_order(F.col("value"), F.col("event_id"))
    # one digit as SQL rounds it: the product, and not the decimal that the double is written as
    return e.crossJoin(F.broadcast(least)).groupBy("user_id", F.when(F.col("event_type") == F.col("least"), "a").otherwise("b").alias("other")).agg((F.round((mean - 50) * 10, 0) / 10).alias("d"))


@query("paired_t_stat", f"WITH {_D} SELECT other, count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic FROM d GROUP BY other")
def _t_stat(spark, sf):
    return significance.paired_t(_differences(spark, sf)).select("other", "n", _r("mean"), _r("statistic"))


_RANKS = """, r AS (SELECT *, rank() OVER (PARTITION BY other ORDER BY abs(round(d, 12))) + (count(*) OVER (PARTITION BY other, abs(round(d, 12))) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY other, abs(round(d, 12))) AS t FROM {0})"""
_WILCOXON = {
    "wilcox": (_RANKS.format("(SELECT * FROM d WHERE d <> 0)"), "sum(CASE WHEN d > 0 THEN rk ELSE 0 END)", "n * (n + 1) / 4.0", "(n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0", "true"),
    "zsplit": (_RANKS.format("d"), "sum(CASE WHEN d > 0 THEN rk ELSE 0 END) + sum(CASE WHEN d = 0 THEN rk ELSE 0 END) / 2", "n * (n + 1) / 4.0", "(n * (n + 1) * (2 * n + 1) - ties / 2.0) / 24.0", "true"),
    "pratt": (_RANKS.format("d"), "sum(CASE WHEN d > 0 THEN rk ELSE 0 END)", "n * (n + 1) / 4.0 - m * (m + 1) / 4.0", "(n * (n + 1) * (2 * n + 1) - m * (m + 1) * (2 * m + 1) - ties / 2.0) / 24.0", "d <> 0"),
}
for _zeros, (_cte, _plus, _mu, _var, _counted) in _WILCOXON.items():

    @query(f"wilcoxon_{_zeros}_stat", f"WITH {_D} {_cte}, a AS (SELECT other, count(*) AS n, count(*) FILTER (d = 0) AS m, {_plus} AS r_plus, sum(CASE WHEN {_counted} THEN t * t - 1 ELSE 0 END) AS ties FROM r GROUP BY other) SELECT other, n, round(r_plus, 6) AS r_plus, round({_mu}, 6) AS mu, round(sqrt({_var}), 6) AS sigma, round((r_plus - ({_mu})) / sqrt({_var}), 6) AS z FROM a")
    def _wilcoxon(spark, sf, zeros=_zeros):
        return significance.wilcoxon(_differences(spark, sf), zeros).select("other", "n", *[_r(c) for c in ("r_plus", "mu", "sigma", "z")])


@query("sign_counts", f"WITH {_D} SELECT other, count(*) AS n, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM d GROUP BY other")
def _signs(spark, sf):
    return significance.sign_counts(_differences(spark, sf))


_L = """l0 AS (SELECT user_id, event_type AS recommender, round(avg(value), 0) AS score FROM events GROUP BY ALL), l AS (SELECT * FROM l0 WHERE user_id IN (SELECT user_id FROM l0 GROUP BY user_id HAVING count(*) = 5))"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    l0 = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("recommender")).agg(F.round(mean_in_order(F.col("value"), F.col("event_id")), 0).alias("score"))
    return l0.join(l0.groupBy("user_id").count().where("count = 5").select("user_id"), "user_id", "left_semi")


@query(
    "friedman_stat",
    f"""WITH {_L}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY user_id, score) AS t FROM l),
    p AS (SELECT recommender, sum(rk) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL), a AS (SELECT CAST(max(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(s * s) AS rr, sum(ties) AS ties FROM p)
    SELECT CAST(n AS BIGINT) AS users, CAST(k AS BIGINT) AS recommenders, round((12 * rr / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS statistic FROM a""",
)
def _friedman(spark, sf):
    return significance.friedman(_long(spark, sf)).select("users", "recommenders", _r("statistic"))


@query("cochran_q_stat", "WITH l AS (SELECT doc_id, 'quality' AS t, quality AS s FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels), c AS (SELECT t, sum(s) AS c FROM l GROUP BY t), r AS (SELECT doc_id, sum(s) AS r FROM l GROUP BY doc_id), a AS (SELECT count(*) AS k, sum(c * c) AS cc, CAST(sum(c) AS DOUBLE) AS n FROM c), b AS (SELECT count(*) AS u, sum(r * r) AS rr FROM r) SELECT u AS users, k AS treatments, round((k - 1) * (k * cc - n * n) / (k * n - rr), 6) AS statistic FROM a, b")
def _cochran(spark, sf):
    labels = table(spark, sf, "labels")
    long = labels.select(F.col("doc_id").alias("user_id"), F.lit("quality").alias("recommender"), F.col("quality").alias("score")).union(labels.select("doc_id", F.lit("toxic"), "toxic"))
    return significance.cochran_q(long).select("users", "treatments", _r("statistic"))


@query("ci_normal", f"WITH {_D} SELECT other, count(*) AS n, CAST(0.05 AS DOUBLE) AS alpha, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(var_pop(d), 6) AS var, round(avg(d) - 1.959963984540054 * stddev_samp(d) / sqrt(count(*)), 6) AS normal_low, round(avg(d) + 1.959963984540054 * stddev_samp(d) / sqrt(count(*)), 6) AS normal_high FROM d GROUP BY other")
def _ci(spark, sf):
    out = significance.confidence_intervals(_differences(spark, sf), ["other"], "d", (0.05,))
    return out.select("other", "n", "alpha", *[_r(c) for c in ("mean", "std", "var", "normal_low", "normal_high")])


def _tails(rows: str, cdf: str) -> str:
    """SQL for p-values of a row (statistic two-sided and one-sided, lower and upper tail) for the three alternatives."""
    return f"SELECT other, test, a.alternative, CASE a.alternative WHEN 'two-sided' THEN two ELSE one END AS statistic, CASE a.alternative WHEN 'two-sided' THEN least(1.0, 2 * least(lower, upper)) WHEN 'greater' THEN upper ELSE lower END AS p FROM ({rows}) {cdf}, (VALUES ('two-sided'), ('greater'), ('less')) a(alternative)"


# areas of densities by Simpson's rule, binomial sums by lgamma
_SIMPSON = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
_SIGNED = """, {0}_r AS (SELECT *, rank() OVER (PARTITION BY other ORDER BY abs(d)) + (count(*) OVER (PARTITION BY other, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY other, abs(d)) AS t FROM d WHERE {1}),
    {0}_a AS (SELECT other, count(*) AS n, sum(CASE WHEN d > 0 THEN rk WHEN d = 0 THEN rk / 2 ELSE 0 END) AS plus, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM {0}_r GROUP BY other),
    {0}_z AS (SELECT other, plus, n * (n + 1) / 2.0 - plus AS minus, (plus - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0) AS z FROM {0}_a),
    {0}_p AS (SELECT other, plus, minus, z, sum(""" + _SIMPSON + """ * exp(-pow(abs(z) * i / 2000.0, 2) / 2)) * abs(z) / 6000.0 / sqrt(2 * pi()) AS area FROM {0}_z, generate_series(0, 2000) g(i) GROUP BY other, plus, minus, z)"""
_BATTERY = (
    _L
    + """, d AS (SELECT x.user_id, x.recommender AS other, round(x.score - y.score, 12) AS d FROM l x JOIN l y USING (user_id) WHERE y.recommender = (SELECT min(recommender) FROM l) AND x.recommender <> y.recommender),
    t_s AS (SELECT other, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS s, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY other),
    t_p AS (SELECT other, s, sum("""
    + _SIMPSON
    + """ * pow(1 + pow(abs(s) * i / 2000.0, 2) / (n - 1), -n / 2)) * abs(s) / 6000.0 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) AS area FROM t_s, generate_series(0, 2000) g(i) GROUP BY other, s, n)"""
    + _SIGNED.format("wilcox", "d <> 0")
    + _SIGNED.format("zsplit", "true")
    + """, b AS (SELECT other, count(*) AS n, count(*) FILTER (d > 0) + count(*) FILTER (d = 0) // 2 AS s FROM d GROUP BY other),
    b_p AS (SELECT other, n, s, sum(CASE WHEN i <= s THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) ELSE 0 END) AS lower, sum(CASE WHEN i <= n - s THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) ELSE 0 END) AS upper FROM b, generate_series(0, 100000) g(i) WHERE i <= n GROUP BY ALL), every AS ("""
    + " UNION ALL ".join(
        [
            _tails("SELECT other, 'paired_t' AS test, s AS two, s AS one, 0.5 + sign(s) * area AS lower, 0.5 - sign(s) * area AS upper FROM t_p", "x"),
            *[_tails(f"SELECT other, 'wilcoxon_{z}' AS test, least(plus, minus) AS two, plus AS one, 0.5 + sign(z) * area AS lower, 0.5 - sign(z) * area AS upper FROM {z}_p", "x") for z in ("wilcox", "zsplit")],
            _tails("SELECT other, 'sign' AS test, CAST(s AS DOUBLE) AS two, CAST(s AS DOUBLE) AS one, lower, upper FROM b_p", "x"),
        ]
    )
    + "), m AS (SELECT *, count(*) OVER (PARTITION BY test, alternative) AS m FROM every), c AS (SELECT *, false AS corrected, p AS p_value, CAST(0.05 AS DOUBLE) AS alpha FROM m UNION ALL SELECT *, true, least(1.0, p * m), 0.05 / m FROM m)"
)


@query("significance_battery", f"WITH {_BATTERY} SELECT other, test, alternative, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, round(alpha, 6) AS alpha, CASE WHEN p_value <= alpha THEN 'ALTERNATIVE' ELSE 'NULL' END AS hypothesis, corrected FROM c")
def _battery(spark, sf):
    long = _long(spark, sf)
    first = long.agg(F.min("recommender")).first()[0]
    base = long.where(F.col("recommender") == first).select("user_id", "score")
    others = long.where(F.col("recommender") != first).withColumnRenamed("recommender", "other")
    return significance.battery(base, others).select("other", "test", "alternative", _r("statistic"), _r("p_value"), _r("alpha"), "hypothesis", "corrected")


@query(
    "friedman_test",
    f"""WITH {_L}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY user_id, score) AS t FROM l),
    p AS (SELECT recommender, sum(rk) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL), a AS (SELECT CAST(max(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(s * s) AS rr, sum(ties) AS ties FROM p),
    x AS (SELECT n, k, (12 * rr / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS x FROM a),
    y AS (SELECT n, k, x, (SELECT sum(exp(-x / 2) * pow(x / 2, i) / gamma(i + 1)) FROM generate_series(0, 20) g(i) WHERE i < (k - 1) / 2) AS p FROM x)
    SELECT 'all' AS other, 'friedman' AS test, 'two-sided' AS alternative, round(x, 6) AS statistic, round(p, 6) AS p_value, CAST(0.05 AS DOUBLE) AS alpha, CASE WHEN p <= 0.05 THEN 'ALTERNATIVE' ELSE 'NULL' END AS hypothesis, k > 6 AND n > 10 AS reliable FROM y""",
)
def _friedman_test(spark, sf):
    """Five recommenders have four degrees of freedom: the tail is a short sum."""
    return significance.friedman_test(_long(spark, sf)).withColumn("statistic", F.round("statistic", 6)).withColumn("p_value", F.round("p_value", 6))


@query("mean_rank_pairs", f"WITH {_L}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS rk FROM l), m AS (SELECT recommender, avg(rk) AS mr, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT count(*) AS k FROM m) SELECT x.recommender AS a, y.recommender AS b, round(x.mr - y.mr, 6) AS difference, round(sqrt(k * (k + 1) / (6.0 * x.n)), 6) AS se FROM m x JOIN m y ON x.recommender < y.recommender, k")
def _mean_ranks(spark, sf):
    return significance.mean_ranks(_long(spark, sf)).select("a", "b", _r("difference"), _r("se"))


_POISSON = " + ".join(f"CAST(u > {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r} AS INTEGER)" for k in range(12))


@query("bootstrap_interval", f"WITH {_D}, s AS (SELECT s, d, CAST('0x' || substr(md5('0:' || user_id || ':' || s), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM d, generate_series(1, 100) g(s) WHERE other = 'a'), w AS (SELECT s, d, {_POISSON} AS w FROM s), m AS (SELECT s, sum(w * d) / sum(w) AS m FROM w GROUP BY s) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def _bootstrap(spark, sf):
    return significance.bootstrap(_differences(spark, sf).where("other = 'a'"), "d").select(_r("low"), _r("high"))


# sampling and training


def _hex(*parts: str) -> str:
    """The sampler's 60 bits of the MD5 digest of parts joined by colons, in SQL."""
    return f"CAST('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 15) AS BIGINT)"


def _positives_sql(n: int, seed: int) -> str:
    return f"SELECT draw, u, i, CAST(1 AS DOUBLE) AS r FROM (SELECT draw, {_hex(f"'{seed}'", "'p'", 'draw')} % (SELECT count(*) FROM cells) AS k FROM generate_series(0, {n - 1}) g(draw)) JOIN (SELECT u, i, row_number() OVER (ORDER BY u, i) - 1 AS k FROM cells) USING (k)"


def _negatives_sql(n: int, seed: int, moved: int = 0) -> str:
    """One turn of tries, which fills all draws as long as a good part of the cells is free."""
    pick = lambda k, size: f"{_hex(f"'{seed}'", "'0'", f"'{k}'", 'draw', 't')} % (SELECT count(*) FROM {size})"
    return f"""SELECT draw + {moved} AS draw, u, i, CAST(0 AS DOUBLE) AS r FROM (SELECT draw, t, {pick('u', 'us')} AS a, {pick('i', 'ns')} AS b FROM generate_series(0, {n - 1}) g(draw), generate_series(1, {sampling.TRIES}) h(t)) JOIN us USING (a) JOIN ns USING (b)
        WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.u = us.u AND c.i = ns.i) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY t) = 1"""


_AXES = ", us AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS a FROM (SELECT DISTINCT u FROM cells)), ns AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS b FROM (SELECT DISTINCT i FROM cells))"


@query("sample_positives", f"WITH {CELLS} {_positives_sql(2000, 1)}")
def _sample_positives(spark, sf):
    return sampling.positives(_cells(spark, sf), 2000, 1)


@query("sample_negatives", f"WITH {CELLS} {_AXES} {_negatives_sql(2000, 1)}")
def _sample_negatives(spark, sf):
    c = _cells(spark, sf)
    return sampling.negatives(c, c.select("u").distinct(), c.select("i").distinct(), 2000, 1)


@query("sample_mixed", f"WITH {CELLS} {_AXES} SELECT * FROM ({_positives_sql(700, 1)}) UNION ALL SELECT * FROM ({_negatives_sql(300, 1, 700)})")
def _sample_mixed(spark, sf):
    c = _cells(spark, sf)
    return sampling.mixed(c, c.select("u").distinct(), c.select("i").distinct(), 1000, 0.3, 1)


def _ids(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    return c.select(F.col("u").alias("id")).distinct(), c.select(F.col("i").alias("id")).distinct()


@query("train_mf")
def _train_mf(spark, sf):
    c = written(_cells(spark, sf))
    u, i, n = c.select("u").distinct(), c.select("i").distinct(), sampling.stored(c)
    model = factors.fit_mf(lambda epoch: sampling.mixed(c, u, i, n, 0.5, epoch).select("u", "i", "r"), _ids(c), width=8, epochs=2)
    return factors.recommend(model, c.select("u", "i"), 10)


@query("train_bpr")
def _train_bpr(spark, sf):
    c = written(_cells(spark, sf))
    n = sampling.stored(c)
    model = factors.fit_bpr(lambda epoch: sampling.triples(c, c.select("i").distinct(), n, epoch), _ids(c), width=8, epochs=2)
    return factors.recommend(model, c.select("u", "i"), 10)


@query("train_lightgcn")
def _train_lightgcn(spark, sf):
    c = written(_cells(spark, sf))
    n = sampling.stored(c)
    return factors.fit_lightgcn(c, lambda epoch: sampling.triples(c, c.select("i").distinct(), n, epoch), width=4, layers=2, epochs=1)


@query("train_slim_elastic_net")
def _train_slim(spark, sf):
    return factors.slim_elastic_net(_cells(spark, sf), k=20, candidates=50)


@query("train_slim_bpr")
def _train_slim_bpr(spark, sf):
    c = written(_cells(spark, sf))
    n = sampling.stored(c)
    return factors.slim_bpr(c, lambda epoch: sampling.triples(c, c.select("i").distinct(), n, epoch), epochs=2, k=20)


from quillon import more_queries  # noqa: E402, F401
