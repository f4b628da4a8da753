"""Paired tests of recommenders on per-user scores. Statistics are aggregates; p-values are taken of the few results.

scores: user_id, other, d (other minus base), one row a user and compared recommender. Every test has a row a
recommender: other, statistic, p_value, hypothesis (ALTERNATIVE if p <= alpha).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import dists
from quillon.operators.ranking import average_rank, prefix_sums
from quillon.scratch import written

ALTERNATIVES = ("two-sided", "greater", "less")
ZEROS = ("wilcox", "zsplit", "pratt")
TIES = ("zsplit", "none", "strictly_greater", "greater_or_equal")
#: Users for whom signed ranks are counted out exactly.
EXACT = 50
RESULT = "other string, test string, alternative string, statistic double, p_value double, alpha double, hypothesis string"


def differences(base: DataFrame, others: DataFrame) -> DataFrame:
    """Paired by user. base: user_id, score; others: user_id, other, score."""
    return others.join(base.withColumnRenamed("score", "base"), "user_id").select("user_id", "other", (F.col("score") - F.col("base")).alias("d"))


def paired_t(scores: DataFrame) -> DataFrame:
    """other, n, mean, statistic (t with n - 1 degrees of freedom)."""
    a = scores.groupBy("other").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return a.select("other", "n", "mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("statistic"))


def wilcoxon(scores: DataFrame, zeros: str = "wilcox") -> DataFrame:
    """other, n (ranked differences), n_zero, r_plus, r_minus, mu, sigma, z, ties of the signed ranks."""
    if zeros not in ZEROS:
        raise ValueError(f"zeros is one of {', '.join(ZEROS)}")
    rows = scores.withColumn("d", F.round("d", 12))
    if zeros == "wilcox":
        rows = rows.where("d <> 0")
    # ranks are those of the differing sizes, whose rows are counted first
    sizes = rows.groupBy("other", F.abs("d").alias("a")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("p"), F.count_if(F.col("d") < 0).alias("q"))
    ranked = prefix_sums(sizes, ["a"], "t", ["other"]).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2.0)
    zero, t = F.col("a") == 0, F.col("t").cast("double")
    counted = F.lit(True) if zeros == "zsplit" else ~zero
    a = ranked.groupBy("other").agg(
        F.sum("t").alias("n"), F.sum(F.when(zero, F.col("t")).otherwise(0)).alias("n_zero"), F.sum(F.col("p") * F.col("rank")).alias("plus"), F.sum(F.col("q") * F.col("rank")).alias("minus"),
        F.sum(F.when(zero, t * F.col("rank")).otherwise(0.0)).alias("zero_ranks"), F.sum(F.when(counted, t * (t * t - 1.0)).otherwise(0.0)).alias("ties"),
    )
    half = F.col("zero_ranks") / 2 if zeros == "zsplit" else F.lit(0.0)
    n, m = F.col("n").cast("double"), F.col("n_zero") if zeros == "pratt" else F.lit(0)
    mu = n * (n + 1) / 4 - m * (m + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24
    out = a.select("other", "n", "n_zero", (F.col("plus") + half).alias("r_plus"), (F.col("minus") + half).alias("r_minus"), mu.alias("mu"), F.sqrt(var).alias("sigma"), "ties")
    return out.withColumn("z", F.try_divide(F.col("r_plus") - F.col("mu"), F.col("sigma")))


def sign_counts(scores: DataFrame) -> DataFrame:
    d = F.round("d", 12)
    return scores.groupBy("other").agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def friedman(long: DataFrame, by: list[str] = ()) -> DataFrame:
    """users, recommenders, statistic (tie-corrected chi-square, k - 1 degrees). long: user_id, recommender, score, all paired.

    by: columns that tell several comparisons in one table apart.
    """
    score = F.round("score", 12)
    ranked = long.select(*by, "user_id", "recommender", score.alias("s"), average_rank(score, *by, "user_id").alias("rank"))
    ranked = ranked.withColumn("t", F.count("*").over(Window.partitionBy(*by, "user_id", "s")))
    per = ranked.groupBy(*by, "recommender").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.col("t") * F.col("t") - 1.0).alias("ties"))
    a = per.groupBy(*by).agg(F.max("n").alias("users"), F.count("*").alias("recommenders"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum("ties").alias("ties"))
    n, k = F.col("users").cast("double"), F.col("recommenders").cast("double")
    return a.select(*by, "users", "recommenders", F.try_divide(12 * F.col("rr") / (n * k * (k + 1)) - 3 * n * (k + 1), 1 - F.col("ties") / (n * k * (k * k - 1))).alias("statistic"))


def cochran_q(long: DataFrame) -> DataFrame:
    """users, treatments, statistic. long: user_id, recommender, score with two values, 0 and 1."""
    columns = long.groupBy("recommender").agg(F.sum("score").alias("c"))
    rows = long.groupBy("user_id").agg(F.sum("score").alias("r"))
    a = columns.agg(F.count("*").alias("treatments"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("c").alias("total"))
    b = rows.agg(F.count("*").alias("users"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    k, n = F.col("treatments").cast("double"), F.col("total").cast("double")
    return a.crossJoin(b).select("users", "treatments", F.try_divide((k - 1) * (k * F.col("cc") - n * n), k * n - F.col("rr")).alias("statistic"))


def _decided(spark, rows: list[tuple], alpha: float) -> DataFrame:
    return spark.createDataFrame([(*r, alpha, "ALTERNATIVE" if not math.isnan(r[-1]) and r[-1] <= alpha else "NULL") for r in rows], RESULT)


def t_test(scores: DataFrame, alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    rows = []
    for r in paired_t(scores).collect():  # a row a recommender
        if r["statistic"] is None:
            rows.append((r["other"], "paired_t", alternative, float("nan"), float("nan")))
            continue
        cdf = dists.student_cdf(r["statistic"], r["n"] - 1)
        rows.append((r["other"], "paired_t", alternative, r["statistic"], dists.p_value(cdf, dists.student_cdf(-r["statistic"], r["n"] - 1), alternative)))
    return _decided(scores.sparkSession, rows, alpha)


def wilcoxon_test(scores: DataFrame, zeros: str = "wilcox", alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    """Exact without ties and zeros for up to EXACT users, otherwise by the normal approximation. All differences zero: p is NaN."""
    rows = []
    for r in wilcoxon(scores, zeros).collect():
        plus, minus, n = r["r_plus"], r["r_minus"], r["n"]
        statistic = min(plus, minus) if alternative == "two-sided" else plus
        if not r["sigma"] or n == r["n_zero"]:
            p = float("nan")
        elif n <= EXACT and not r["ties"] and not r["n_zero"]:
            # the distribution is symmetric, so the upper tail is the lower one of the negative ranks
            p = dists.p_value(dists.signed_rank_cdf(plus, n), dists.signed_rank_cdf(minus, n), alternative)
        else:
            p = dists.p_value(dists.normal_cdf(r["z"]), dists.normal_cdf(-r["z"]), alternative)
        rows.append((r["other"], f"wilcoxon_{zeros}", alternative, statistic, p))
    known = {r[0] for r in rows}
    rows += [(r["other"], f"wilcoxon_{zeros}", alternative, float("nan"), float("nan")) for r in scores.select("other").distinct().collect() if r["other"] not in known]
    return _decided(scores.sparkSession, rows, alpha)


def sign_test(scores: DataFrame, ties: str = "zsplit", alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    """Exact binomial over all users; odd ties are allowed under every policy."""
    if ties not in TIES:
        raise ValueError(f"ties is one of {', '.join(TIES)}")
    rows = []
    for r in sign_counts(scores).collect():
        s, n = r["wins"] + {"strictly_greater": 0, "greater_or_equal": r["ties"]}.get(ties, r["ties"] // 2), r["n"]
        if alternative == "two-sided":
            p = min(1.0, 2 * dists.binomial_cdf(min(s, n - s), n))
        else:
            p = dists.p_value(dists.binomial_cdf(s, n), dists.binomial_cdf(n - s, n), alternative)
        rows.append((r["other"], "sign", alternative, float(s), p))
    return _decided(scores.sparkSession, rows, alpha)


def friedman_test(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row, with reliable: more than six recommenders and more than ten users. Fewer than three raise."""
    r = friedman(long).first()
    if r["recommenders"] < 3:
        raise ValueError("at least three recommenders are needed")
    p = dists.chi_square_sf(r["statistic"], r["recommenders"] - 1)
    return _decided(long.sparkSession, [("all", "friedman", "two-sided", r["statistic"], p)], alpha).withColumn("reliable", F.lit(r["recommenders"] > 6 and r["users"] > 10))


def bonferroni(results: DataFrame, mode: str = "reference", by: list[str] = ()) -> DataFrame:
    """p times the number of tests, capped at 1. reference: compared with alpha divided likewise; standard: with alpha.

    by: columns that tell families of tests apart, besides the test and the alternative.
    """
    if mode not in ("reference", "standard"):
        raise ValueError("mode is reference or standard")
    m = F.count("*").over(Window.partitionBy(*by, "test", "alternative"))
    out = results.withColumn("_m", m).withColumn("p_value", F.least(F.lit(1.0), F.col("p_value") * F.col("_m")))
    out = out.withColumn("alpha", F.col("alpha") / F.col("_m")) if mode == "reference" else out
    return out.withColumn("hypothesis", F.when(F.isnan("p_value") | (F.col("p_value") > F.col("alpha")), "NULL").otherwise("ALTERNATIVE")).drop("_m")


def _tests(d: DataFrame, alpha: float) -> DataFrame:
    """All paired tests for the three alternatives."""
    out = None
    for alternative in ALTERNATIVES:
        for found in (t_test(d, alternative, alpha), wilcoxon_test(d, "wilcox", alternative, alpha), wilcoxon_test(d, "zsplit", alternative, alpha), sign_test(d, "zsplit", alternative, alpha)):
            out = found if out is None else out.unionByName(found)
    return out


def battery(base: DataFrame, others: DataFrame, alpha: float = 0.05) -> DataFrame:
    """All tests and their Bonferroni corrections, for the three alternatives."""
    found = _tests(written(differences(base, others)), alpha)
    return found.withColumn("corrected", F.lit(False)).unionByName(bonferroni(found).withColumn("corrected", F.lit(True)))


def compare(scores: DataFrame, base: str, metrics: list[str], alpha: float = 0.05, *, mode: str = "reference") -> DataFrame:
    """Every test of every recommender against the base, for every cutoff, metric and alternative.

    scores: user_id, recommender, cutoff and a column for each metric; users are paired by cutoff. A row a test and
    grouping: `pairs` (each recommender against the base by itself) and `group` (all of them at once, corrected by
    Bonferroni). All comparisons run in one pass over the scores.
    """
    long = scores.select("user_id", "recommender", "cutoff", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("score")) for m in metrics])))
    of_base = long.where(F.col("recommender") == base).select("user_id", "cutoff", "metric", F.col("score").alias("base"))
    key = F.to_json(F.struct("cutoff", "metric", "recommender"))
    d = long.where(F.col("recommender") != base).join(of_base, ["user_id", "cutoff", "metric"]).select("user_id", key.alias("other"), (F.col("score") - F.col("base")).alias("d"))
    found = _tests(written(d), alpha)
    told = found.withColumn("k", F.from_json("other", "cutoff int, metric string, recommender string")).select("k.cutoff", "k.metric", F.col("k.recommender").alias("other"), *[c for c in found.columns if c != "other"])
    group = bonferroni(told, mode, ["cutoff", "metric"]).withColumn("grouping", F.lit("group"))
    return told.withColumn("grouping", F.lit("pairs")).unionByName(group)


def friedman_all(scores: DataFrame, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Friedman's test of all recommenders, for every cutoff and metric: users, recommenders, statistic, p_value, hypothesis."""
    long = scores.select("user_id", "recommender", "cutoff", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("score")) for m in metrics])))
    rows = []
    for r in friedman(long, ["cutoff", "metric"]).collect():  # a row for each cutoff and metric
        p = float("nan") if r["statistic"] is None or r["recommenders"] < 3 else dists.chi_square_sf(r["statistic"], r["recommenders"] - 1)
        rows.append((*r, p, "ALTERNATIVE" if not math.isnan(p) and p <= alpha else "NULL"))
    return scores.sparkSession.createDataFrame(rows, "cutoff int, metric string, users long, recommenders long, statistic double, p_value double, hypothesis string")


def intervals(scores: DataFrame, metrics: list[str], alphas: tuple[float, ...] = (0.1, 0.05, 0.01, 0.001)) -> DataFrame:
    """Confidence intervals of every recommender's mean, for every cutoff, metric, alpha and algorithm (normal and t)."""
    long = scores.select("user_id", "recommender", "cutoff", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("score")) for m in metrics])))
    both = confidence_intervals(long, ["recommender", "cutoff", "metric"], "score", alphas)
    names = [c for c in both.columns if not c.endswith(("_low", "_high"))]
    ends = [F.struct(F.lit(a).alias("algorithm"), F.col(f"{a}_low").alias("low"), F.col(f"{a}_high").alias("high")) for a in ("normal", "t")]
    return both.select(*names, F.inline(F.array(*ends)))


def nemenyi(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Post-hoc test of all pairs after Friedman's: a, b, difference, se, statistic, p_value, hypothesis.

    p is the upper tail of the studentised range of k recommenders at the root of two times the standardised difference.
    """
    rows = mean_ranks(long).collect()  # a row a pair of recommenders
    k = len({r["a"] for r in rows} | {r["b"] for r in rows})
    out = []
    for r in rows:
        q = abs(r["difference"]) / r["se"] if r["se"] else float("nan")
        p = dists.studentized_range_sf(q * math.sqrt(2), k)
        out.append((*r, q, p, "ALTERNATIVE" if p <= alpha else "NULL"))
    return long.sparkSession.createDataFrame(out, "a string, b string, difference double, se double, statistic double, p_value double, hypothesis string")


def mean_ranks(long: DataFrame) -> DataFrame:
    """Pairs of recommenders with the difference of their mean ranks and its standard error, for a post-hoc test."""
    ranked = long.select("user_id", "recommender", average_rank(F.round("score", 12), "user_id").alias("rank"))
    m = ranked.groupBy("recommender").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))
    k = m.agg(F.count("*").alias("k"))
    a, b = m.select(F.col("recommender").alias("a"), F.col("mean_rank").alias("ra"), "n"), m.select(F.col("recommender").alias("b"), F.col("mean_rank").alias("rb"))
    return a.join(b, F.col("a") < F.col("b")).crossJoin(k).select("a", "b", (F.col("ra") - F.col("rb")).alias("difference"), F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))).alias("se"))


def confidence_intervals(scores: DataFrame, by: list[str], value: str, alphas: tuple[float, ...] = (0.1, 0.05, 0.01, 0.001)) -> DataFrame:
    """n, mean, std and var (over n), and t and normal intervals of the mean, for each alpha."""
    a = scores.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"), F.stddev_samp(value).alias("_s"))
    spark = scores.sparkSession
    sizes = [r["n"] for r in a.select("n").distinct().collect()]  # one number in general: the users
    q = [(n, p, dists.quantile(dists.normal_cdf, 1 - p / 2), dists.quantile(lambda x, n=n: dists.student_cdf(x, n - 1), 1 - p / 2) if n > 1 else float("nan")) for n in sizes for p in alphas]
    table = spark.createDataFrame(q, "n bigint, alpha double, qz double, qt double")
    half = F.col("_s") / F.sqrt("n")
    return a.join(F.broadcast(table), "n").select(*by, "n", "alpha", "mean", "std", "var", (F.col("mean") - F.col("qz") * half).alias("normal_low"), (F.col("mean") + F.col("qz") * half).alias("normal_high"), (F.col("mean") - F.col("qt") * half).alias("t_low"), (F.col("mean") + F.col("qt") * half).alias("t_high"))


def bootstrap(scores: DataFrame, value: str, *, resamples: int = 100, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling, in which every row draws its own multiplicities.

    A row's uniform number for a resample is a digest of its id, so the result does not depend on partitioning.
    scores: user_id and the value.
    """
    draws = scores.select("user_id", F.col(value).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("s"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("s").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    times, low = F.lit(0), 0.0
    for k in range(12):
        low += math.exp(-1) / math.factorial(k)
        times = times + (u > low).cast("int")
    means = draws.withColumn("w", times).groupBy("s").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"))
