"""Cleaning: every operator marks rows as kept or removed, so one scan serves both sides and the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

MARK = "_kept"


@dataclass(frozen=True)
class Cut:
    """Rows with a mark; kept and removed together are the input."""

    marked: DataFrame

    @property
    def kept(self) -> DataFrame:
        return self.marked.where(F.col(MARK)).drop(MARK)

    @property
    def removed(self) -> DataFrame:
        return self.marked.where(~F.col(MARK)).drop(MARK)

    def report(self, columns: list[str] = ("user_id", "item_id")) -> DataFrame:
        """A row per subject (records and each column): original, new, affected, removed, and percentages.

        For columns these are distinct values: affected ones have a removed row, removed ones have no other. Percentages
        of an empty input are null.
        """
        present = [c for c in columns if c in self.marked.columns]
        aggs = [F.count("*").alias("records_o"), F.count_if(MARK).alias("records_n")]
        for c in present:
            aggs += [F.count_distinct(c).alias(f"{c}_o"), F.count_distinct(F.when(F.col(MARK), F.col(c))).alias(f"{c}_n"), F.count_distinct(F.when(~F.col(MARK), F.col(c))).alias(f"{c}_a")]
        one = self.marked.agg(*aggs)
        rows = [F.struct(F.lit("records").alias("subject"), F.col("records_o").alias("original"), F.col("records_n").alias("new"), (F.col("records_o") - F.col("records_n")).alias("affected"))]
        rows += [F.struct(F.lit(c).alias("subject"), F.col(f"{c}_o").alias("original"), F.col(f"{c}_n").alias("new"), F.col(f"{c}_a").alias("affected")) for c in present]
        flat = one.select(F.inline(F.array(*rows))).withColumn("removed", F.col("original") - F.col("new"))
        share = lambda c: F.try_divide(100.0 * F.col(c), F.col("original")).alias(f"{c}_pct")
        return flat.select("*", share("new"), share("affected"), share("removed"))


def mark(df: DataFrame, condition: Column) -> Cut:
    return Cut(df.withColumn(MARK, F.coalesce(condition, F.lit(False))))


def deduplicate(df: DataFrame, columns: list[str], order_by: list[Column | str], keep: str = "first") -> Cut:
    """Keep the first, the last, or (none) no row of those equal in columns; null keys equal each other.

    order_by must be a total order.
    """
    if keep not in ("first", "last", "none"):
        raise ValueError("keep is first, last or none")
    by = Window.partitionBy(*columns)
    if keep == "none":
        return mark(df, F.count("*").over(by) == 1)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return mark(df, F.row_number().over(by.orderBy(*order if keep == "first" else [c.desc() for c in order])) == 1)


def at_least(df: DataFrame, user: str, least: int) -> Cut:
    """Users with so many rows at least; rows without user are removed."""
    if least < 0:
        raise ValueError("least must not be negative")
    counts = df.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("_user")).agg(F.count("*").alias("_n"))
    # counts are joined rather than windowed: the log is not sorted, and a heavy user is split among tasks
    joined = df.join(counts, df[user] == counts["_user"], "left")
    return Cut(joined.withColumn(MARK, F.coalesce(F.col("_n") >= least, F.lit(False))).drop("_user", "_n"))


def filter_by(df: DataFrame, other: DataFrame, column: str, *, checked: bool = False) -> Cut:
    """Rows whose value occurs in other. checked: raise if other has values that df lacks."""
    keys = other.select(F.col(column).alias("_key")).where("_key is not null").distinct()
    if checked and not keys.join(df, keys["_key"] == df[column], "left_anti").isEmpty():
        raise ValueError(f"{column} has values that the filtered table lacks")
    joined = df.join(keys.withColumn("_hit", F.lit(True)), df[column] == keys["_key"], "left")
    return Cut(joined.withColumn(MARK, F.coalesce("_hit", F.lit(False))).drop("_key", "_hit"))


#: Names as users of such filters know them; `ge` and `le` are strict.
COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "neq": lambda c, t: c != t,
    "eq": lambda c, t: c == t,
    "geq": lambda c, t: c >= t,
    "ge": lambda c, t: c > t,
    "leq": lambda c, t: c <= t,
    "le": lambda c, t: c < t,
    "isin": lambda c, t: _among(c, t),
    "not_isin": lambda c, t: ~_among(c, t),
}


def _among(c: Column, values: list) -> Column:
    """Membership in which a null in the list matches null."""
    found = F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False))
    return found | c.isNull() if any(v is None for v in values) else found


def threshold(df: DataFrame, column: str, value, how: str = "geq") -> Cut:
    """Compare with a value or list. Null rows go, except that they are unequal to everything. NaN counts as null."""
    if how not in COMPARISONS:
        raise ValueError(f"how is one of {', '.join(COMPARISONS)}")
    c = F.col(column)
    if isinstance(df.schema[column].dataType, DoubleType | FloatType):
        c = F.when(~F.isnan(c), c)
    return Cut(df.withColumn(MARK, F.coalesce(COMPARISONS[how](c, value), F.lit(how in ("neq", "not_isin")))))


def not_null(df: DataFrame, column: str) -> Cut:
    c = F.col(column)
    floating = isinstance(df.schema[column].dataType, DoubleType | FloatType)
    return mark(df, c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull())


def apply(df: DataFrame, column: str, function: Callable[[Column], Column]) -> Cut:
    """A column replaced by a function of it, an expression or a pandas UDF; nothing is removed."""
    return mark(df.withColumn(column, function(F.col(column))), F.lit(True))


def merge(left: DataFrame, right: DataFrame, how: str, left_on: list[str], right_on: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """Equi-join in which nulls match nulls, and the left rows without a match. Shared names get suffixes."""
    if how not in ("left", "inner", "right"):
        raise ValueError("how is left, inner or right")
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("keys are needed on both sides")
    both = {c for c in left.columns if c in right.columns}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    name = lambda c, s: c + s if c in both else c
    on = [F.col(f"`{name(x, suffixes[0])}`").eqNullSafe(F.col(f"`{name(y, suffixes[1])}`")) for x, y in zip(left_on, right_on, strict=True)]
    return a.join(b, on, how), a.join(b, on, "left_anti").withColumnsRenamed({c + suffixes[0]: c for c in both})


def sample_values(df: DataFrame, column: str, fraction: float, seed: int = 0) -> Cut:
    """All rows of floor(n * fraction) of the n distinct values, those with the smallest seeded hash."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    values = df.select(F.col(column).alias("_value")).where("_value is not null").distinct()
    size = int(values.count() * fraction + 1e-9)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_value").cast("string")))
    chosen = values.orderBy(order, "_value").limit(size).withColumn("_hit", F.lit(True))
    joined = df.join(chosen, df[column] == chosen["_value"], "left")
    return Cut(joined.withColumn(MARK, F.coalesce("_hit", F.lit(False))).drop("_value", "_hit"))


def wrong_counts(df: DataFrame, user: str, items: str, n: int) -> DataFrame:
    """Users that do not have exactly n items (list items are exploded): user, n_items. Empty if all have."""
    listed = df.schema[items].dataType.typeName() == "array"
    flat = df.select(user, F.explode(items).alias(items)) if listed else df.select(user, items)
    return flat.groupBy(user).agg(F.count("*").alias("n_items")).where(F.col("n_items") != n)


def left_out(ids: DataFrame, column: str, fraction: float, seed: int = 0) -> DataFrame:
    """Users or items to leave out of an evaluation: floor(n * fraction) distinct ids, by seeded hash."""
    return sample_values(ids.select(column).distinct(), column, fraction, seed).kept
