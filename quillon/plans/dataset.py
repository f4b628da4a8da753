"""Datasets: named logs, splits, matrices and features of one configuration, read through a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import matrix, splits
from quillon.sources.store import Bundle, Matrix, digest, exists

SPLITS = ("train", "validation", "train_validation", "test")


def _matrix(df: DataFrame, user: str, items: str, users: DataFrame, item_ids: DataFrame, shape: tuple[int, int], binarize: bool) -> Matrix:
    return Matrix(matrix.coordinates(df, user, items, users=users, item_ids=item_ids, binarize=binarize), shape)


@dataclass
class Dataset:
    """What a folder holds of a dataset. Every part is read when it is asked for; a part that isn't there raises."""

    spark: SparkSession
    path: str

    def _part(self, kind: str) -> Bundle:
        return Bundle(self.spark, f"{self.path.rstrip('/')}/{kind}")

    def _get(self, kind: str, name: str) -> object:
        return self._part(kind).get(name)

    def names(self, kind: str) -> list[str]:
        """What there is of a kind: interactions, impressions, frames, mappers, features, config."""
        return sorted(self._part(kind).manifest())

    def interactions(self, split: str = "all") -> Matrix:
        """The user-item matrix of a split: all, train, validation, train_validation, test."""
        return self._get("interactions", split)

    def impressions(self, split: str = "all") -> Matrix:
        return self._get("impressions", split)

    def frame(self, name: str) -> DataFrame:
        """The rows of a split (train, validation, train_validation, test), or all of them with their split."""
        rows = self._get("frames", "all")
        if name == "all":
            return rows
        if name not in SPLITS:
            raise FileNotFoundError(f"{self.path}/frames/{name}")
        return getattr(splits.Splits(rows), name)

    def mapper(self, name: str) -> DataFrame:
        return self._get("mappers", name)

    def feature(self, name: str) -> object:
        """One feature; each is a bundle of its own, so that features can be added and read one by one."""
        return Bundle(self.spark, f"{self.path.rstrip('/')}/features/{name}").load()

    def features(self) -> list[str]:
        """The names of the features that are there."""
        fs, at = self.spark._jvm.org.apache.hadoop.fs.FileSystem, self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/features")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in found.listStatus(at)] if found.exists(at) else []
        return sorted(n for n in names if exists(self.spark, f"{self.path.rstrip('/')}/features/{n}/_manifest"))

    def add_feature(self, name: str, values: dict[str, object]) -> None:
        Bundle(self.spark, f"{self.path.rstrip('/')}/features/{name}").save(values)

    def config(self) -> dict:
        return self._get("config", "config")

    def check(self) -> Dataset:
        """Raise where splits overlap, mappers are no bijections, or indices lie outside them."""
        users, items = self.mapper("users"), self.mapper("items")
        found = matrix.consistency(self.interactions().cells, users, items, implicit=False).where("violations > 0").collect()
        names = [n for n in ("train", "validation", "test") if n in self.names("interactions")]
        shared = matrix.overlap(*[self.interactions(n).cells for n in names])
        if found or not shared.isEmpty():
            raise ValueError(f"{self.path} is not consistent: {[r['check'] for r in found] or 'splits share cells'}")
        return self


@dataclass(frozen=True)
class Strategy:
    """How rows are split: the last k of each user, or by a column's values; validation is cut from the training rows."""

    kind: str = "last_k"  # or threshold
    k: int = 1
    order_by: tuple[str, ...] = ()
    column: str | None = None
    values: tuple = ()  # one value (test), or two (validation, test)
    validation: bool = True

    def split(self, df: DataFrame, user: str) -> splits.Splits:
        if self.kind == "last_k":
            return splits.last_k(df, user, list(self.order_by), self.k, validation=self.validation)
        if self.kind != "threshold" or self.column is None or len(self.values) != 1 + self.validation:
            raise ValueError("a split is last_k, or threshold with a column and a value for each cut")
        if not self.validation:
            return splits.by_threshold(df, self.column, self.values[0])
        low, high = (F.lit(v) for v in self.values)
        c = F.col(self.column)
        part = F.when(F.coalesce(c <= low, F.lit(False)), "train").when(F.coalesce(c <= high, F.lit(False)), "validation").otherwise("test")
        return splits.Splits(df.withColumn("split", part))


@dataclass
class Reader:
    """Builds a dataset from its logs where the folder lacks it, and reads it from there.

    interactions and impressions give tables with the user and item columns (items may be lists). prepare cleans the
    interactions; impressions keep the records (`record`) whose interactions are kept, where both have that column.
    """

    spark: SparkSession
    config: dict
    interactions: Callable[[], DataFrame]
    strategy: Strategy
    impressions: Callable[[], DataFrame] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    user: str = "user_id"
    item: str = "item_id"
    listed: str = "items"
    record: str = "record_id"
    features: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    binarize: bool = True

    def load(self, folder: str) -> Dataset:
        """The dataset of this configuration: folder/<digest of the configuration>."""
        path = f"{folder.rstrip('/')}/{digest(self.config)}"
        if not exists(self.spark, f"{path}/config/_manifest"):
            self._build(path)
        return Dataset(self.spark, path)

    def _build(self, path: str) -> None:
        save = lambda kind, values: Bundle(self.spark, f"{path}/{kind}").save(values)
        rows = self.interactions()
        rows = self.prepare(rows) if self.prepare else rows
        cut = self.strategy.split(rows, self.user)
        save("frames", {"all": cut.rows})
        saved = splits.Splits(Bundle(self.spark, f"{path}/frames").get("all"))
        shown = None
        if self.impressions is not None:
            shown = self.impressions()
            if self.record in shown.columns and self.record in saved.rows.columns:
                shown = shown.join(saved.rows.groupBy(self.record).agg(F.min("split").alias("split")), self.record)
            else:
                shown = shown.withColumn("split", F.lit("train"))
        ids = {"users": (self.user, self.user), "items": (self.item, self.listed)}
        mappers = {}
        for name, (own, other) in ids.items():
            all_ids = saved.rows.select(F.col(own).alias("id"))
            if shown is not None:
                listed = F.explode(other) if shown.schema[other].dataType.typeName() == "array" else F.col(other)
                all_ids = all_ids.union(shown.select(listed.alias("id")))
            mappers[name] = matrix.mapper(all_ids, "id")
        save("mappers", mappers)
        known = Bundle(self.spark, f"{path}/mappers").load()
        shape = (known["users"].count(), known["items"].count())
        parts = {s: getattr(saved, s) for s in SPLITS if s != "validation" or self.strategy.validation}
        save("interactions", {n: _matrix(df, self.user, self.item, known["users"], known["items"], shape, self.binarize) for n, df in {"all": saved.rows, **parts}.items()})
        if shown is not None:
            of = splits.Splits(shown)
            save("impressions", {n: _matrix(df, self.user, self.listed, known["users"], known["items"], shape, False) for n, df in {"all": shown, **{s: getattr(of, s) for s in parts}}.items()})
        for name, make in self.features.items():
            Dataset(self.spark, path).add_feature(name, {"values": make(saved.train)})
        save("config", {"config": self.config, "sha256": digest(self.config)})  # last: a folder without it isn't whole
