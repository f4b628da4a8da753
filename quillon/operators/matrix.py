"""Sparse user-item matrices as coordinate tables (u, i, r) with dimension tables for empty rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillon.operators.ranking import dense_index, prefix_sums


def mapper(df: DataFrame, column: str) -> DataFrame:
    """orig_id, of any type that has an order, and its dense 0-based idx in that order."""
    source = df.select(F.explode(column).alias("orig_id")) if isinstance(df.schema[column].dataType, ArrayType) else df.select(F.col(column).alias("orig_id"))
    return dense_index(source.dropna().distinct(), "orig_id").select("orig_id", "idx")


def same_mappers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one mapper that the other lacks; empty if they are equal."""
    a, b = a.select("orig_id", "idx"), b.select("orig_id", "idx")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def coordinates(df: DataFrame, user: str, items: str, rating: str | None = None, *, users: DataFrame | None = None, item_ids: DataFrame | None = None, binarize: bool = False) -> DataFrame:
    """(u, i, r): lists exploded, nulls dropped, ids mapped, equal cells summed; binarize sets every cell to 1.

    With mappers, ids that they lack raise.
    """
    value = F.col(rating).cast("double") if rating else F.lit(1.0)
    flat = df.select(F.col(user).alias("u"), F.col(items).alias("i"), value.alias("r"))
    if isinstance(df.schema[items].dataType, ArrayType):
        flat = flat.withColumn("i", F.explode("i"))
    flat = flat.dropna()
    for column, ids in (("u", users), ("i", item_ids)):
        if ids is not None:
            if not flat.join(ids, flat[column] == ids["orig_id"], "left_anti").isEmpty():
                raise ValueError(f"{column} has ids that the mapper lacks")
            flat = flat.join(ids, flat[column] == ids["orig_id"]).withColumn(column, F.col("idx")).drop("orig_id", "idx")
    cells = flat.groupBy("u", "i").agg(F.sum("r").alias("r"))
    return cells.withColumn("r", F.lit(1.0)) if binarize else cells


def statistics(df: DataFrame, user: str, items: str, rating: str | None = None) -> DataFrame:
    """Non-zeros, distinct users, items and values of a log's matrix."""
    cells = coordinates(df, user, items, rating)
    return cells.agg(F.count("*").alias("nnz"), F.count_distinct("u").alias("users"), F.count_distinct("i").alias("items"), F.count_distinct("r").alias("values"))


def popularity(cells: DataFrame, item_ids: DataFrame | None = None) -> DataFrame:
    """Non-zero cells of each item; with a dimension (i), items without any count 0."""
    counts = cells.where("r <> 0").groupBy("i").agg(F.count("*").alias("n"))
    return counts if item_ids is None else item_ids.select("i").join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))


def implicit_violations(cells: DataFrame) -> DataFrame:
    return cells.where("r <> 1")


def leave_k_violations(cells: DataFrame, users: DataFrame, k: int = 1) -> DataFrame:
    """Users of the dimension (u) that do not have exactly k cells, empty rows included."""
    counts = cells.groupBy("u").agg(F.count("*").alias("n"))
    return users.select("u").join(counts, "u", "left").select("u", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") != k)


def overlap(*matrices: DataFrame) -> DataFrame:
    """Cells that more than one of the matrices has."""
    tagged = [m.select("u", "i").distinct().withColumn("m", F.lit(n)) for n, m in enumerate(matrices)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.groupBy("u", "i").agg(F.count("*").alias("n")).where("n > 1")


def consistency(cells: DataFrame, users: DataFrame, item_ids: DataFrame, *, implicit: bool = True) -> DataFrame:
    """check, violations: empty matrix, values other than 1, indices outside the mappers, mappers that are no bijection."""
    checks = [cells.limit(1).agg((F.lit(1) - F.count("*")).alias("violations")).select(F.lit("not_empty").alias("check"), "violations")]
    if implicit:
        checks.append(implicit_violations(cells).agg(F.count("*").alias("violations")).select(F.lit("implicit").alias("check"), "violations"))
    for name, column, ids in (("users", "u", users), ("items", "i", item_ids)):
        lost = cells.select(column).distinct().join(ids, F.col(column) == ids["idx"], "left_anti")
        checks.append(lost.agg(F.count("*").alias("violations")).select(F.lit(f"{name}_in_range").alias("check"), "violations"))
        sizes = ids.agg((F.count("*") - F.count_distinct("orig_id")).alias("a"), (F.count("*") - F.count_distinct("idx")).alias("b"), (F.max("idx") + 1 - F.count("*")).alias("c"))
        checks.append(sizes.select(F.lit(f"{name}_bijective").alias("check"), (F.col("a") + F.col("b") + F.abs(F.coalesce("c", F.lit(0)))).alias("violations")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def profiles(cells: DataFrame, axis: str, dimension: DataFrame | None = None) -> DataFrame:
    """Cells of each row (axis u) or column (axis i): id, n; with a dimension, empty ones count 0."""
    counts = cells.groupBy(F.col(axis).alias("id")).agg(F.count("*").alias("n"))
    return counts if dimension is None else dimension.select(F.col(axis).alias("id")).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def gini(profile: DataFrame, *by: str) -> DataFrame:
    """The Gini index of counts n: 0 if all are equal. Computed on the histogram of counts, which is small."""
    per = profile.groupBy(*by, "n").agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by).orderBy("n")
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum("m").alias("k"), F.sum(F.col("m") * F.col("n")).alias("s"), F.sum(F.col("ranks") * F.col("n")).alias("w"))
    return sums.select(*by, F.try_divide(2.0 * F.col("w") - (F.col("k") + 1.0) * F.col("s"), F.col("k") * F.col("s")).alias("gini"))


def profile_describe(profile: DataFrame) -> DataFrame:
    """nobs, min, max, mean, variance (n - 1), skewness and excess kurtosis (biased), gini of profile lengths."""
    x = F.col("n").cast("double")
    d = profile.agg(F.count("*").alias("nobs"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.stddev_pop(x).alias("std"))
    return d.crossJoin(gini(profile))


def matrix_describe(cells: DataFrame, users: DataFrame, item_ids: DataFrame) -> DataFrame:
    """One row: size, density, value range, profile lengths of both axes with empty rows, Gini of user profiles."""
    base = cells.agg(F.count("*").alias("nnz"), F.min("r").alias("min_value"), F.max("r").alias("max_value"))
    for axis, dimension in (("u", users), ("i", item_ids)):
        p = profiles(cells, axis, dimension)
        name = "user" if axis == "u" else "item"
        x = F.col("n").cast("double")
        d = p.agg(F.count("*").alias(f"n_{name}s"), F.min("n").alias(f"min_{name}"), F.avg(x).alias(f"mean_{name}"), F.stddev_pop(x).alias(f"std_{name}"), F.max("n").alias(f"max_{name}"))
        base = base.crossJoin(d)
        if axis == "u":
            base = base.crossJoin(gini(p).withColumnRenamed("gini", "gini_user"))
    return base.withColumn("density", F.try_divide(F.col("nnz").cast("double"), F.col("n_users") * F.col("n_items")))


def _against(base, other):
    return (other - base).alias("difference"), F.try_divide(100.0 * (other - base), base).alias("difference_pct")


def compare_frames(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """subject, base, other, difference and its percentage: records, and distinct values of each column."""
    sides = [d.agg(F.count("*").cast("double").alias("records"), *[F.count_distinct(c).cast("double").alias(c) for c in columns]) for d in (a, b)]
    rows = [s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("value")) for c in ("records", *columns)]))) for s in sides]
    return rows[0].withColumnRenamed("value", "base").join(rows[1].withColumnRenamed("value", "other"), "subject").select("subject", "base", "other", *_against(F.col("base"), F.col("other")))


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """axis, statistic, base, other, difference and its percentage, for profile lengths and non-zeros."""
    names = ("nobs", "min", "max", "mean", "variance", "skewness", "kurtosis", "std", "gini")
    sides = []
    for cells in (a, b):
        out = cells.agg(F.count("*").cast("double").alias("value")).select(F.lit("all").alias("axis"), F.lit("nnz").alias("statistic"), "value")
        for axis, label in (("u", "user"), ("i", "item")):
            d = profile_describe(profiles(cells, axis))
            out = out.unionByName(d.select(F.inline(F.array(*[F.struct(F.lit(label).alias("axis"), F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names]))))
        sides.append(out)
    joined = sides[0].withColumnRenamed("value", "base").join(sides[1].withColumnRenamed("value", "other"), ["axis", "statistic"])
    return joined.select("axis", "statistic", "base", "other", *_against(F.col("base"), F.col("other")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n and share; null is a value."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(total).select("value", "n", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share"))


PERCENTILES = (0.01, 0.05, 0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.99)


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """One row with an exact percentile, linearly interpolated, for each share: p0, p1, …

    Values are counted and ranked in ranges; of the ranked table only the values at the wanted places are read.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("m"))
    ranked = prefix_sums(counts, ["x"], "m")
    ends = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("m").alias("n"))))
    place = [(F.col("n") - 1) * p for p in shares]
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("m")), F.col("x")))
    found = ends.agg(F.max("n").alias("n"), *[at(F.floor(k)).alias(f"_lo{i}") for i, k in enumerate(place)], *[at(F.ceil(k)).alias(f"_hi{i}") for i, k in enumerate(place)])
    return found.select(*[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (k - F.floor(k))).alias(f"p{i}") for i, k in enumerate(place)])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, statistic, value: count, mean, std, min, max, and 15 exact percentiles with linear interpolation."""
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        a = df.agg(F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        a = a.crossJoin(percentiles(df, c))
        fields = [(n, F.col(n)) for n in ("count", "mean", "std", "min", "max")] + [(f"{round(100 * p)}%", F.col(f"p{i}")) for i, p in enumerate(PERCENTILES)]
        rows.append(a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("statistic"), v.alias("value")) for n, v in fields]))))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def summary(df: DataFrame, columns: list[str], counted: list[str] = ()) -> dict[str, DataFrame]:
    """A table's statistics: schema, description of the columns, value counts and their Gini indices of the counted ones."""
    out = {"schema": schema_report(df), "describe": describe(df, columns)}
    for c in counted:
        out[f"counts_{c}"] = value_counts(df, c)
        out[f"gini_{c}"] = gini(out[f"counts_{c}"].select("n"))
    return out


def save_summary(found: dict[str, DataFrame], path: str) -> None:
    from quillon.sources.store import Bundle

    Bundle(next(iter(found.values())).sparkSession, path).save(dict(found))


def load_summary(spark, path: str) -> dict[str, DataFrame]:
    from quillon.sources.store import Bundle

    return Bundle(spark, path).load()


def schema_report(df: DataFrame) -> DataFrame:
    """column, type, nulls of a table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).alias("nulls")) for f in df.schema])))
