"""Recommenders behind one contract: fit on cells, recommend, save and load."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import factors, graph, sampling
from quillon.plans.search import or_none
from quillon.sources.store import Bundle


@dataclass(frozen=True)
class Model:
    """A trained recommender. cells: u, i, r of training; tables: what was learned; settings: how."""

    name: str
    cells: DataFrame
    tables: dict[str, DataFrame]
    settings: dict = field(default_factory=dict)

    def recommend(self, k: int, *, users: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
        """user_id, item_id, pos, score of the k best unseen items; users: user_id to recommend for."""
        cells = self.cells if users is None else self.cells.join(users.select(F.col("user_id").alias("u")), "u", "left_semi")
        if "similarity" in self.tables:
            return graph.recommend(graph.score(cells, self.tables["similarity"]), cells, k, ignored=ignored)
        items = self.tables["items"]
        if ignored is not None:
            items = items.join(ignored.select(F.col("item_id").alias("id")), "id", "left_anti")
        people = self.tables["users"].join(cells.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
        return factors.recommend(factors.Factors(people, items), cells.select("u", "i"), k)

    def check(self) -> Model:
        """Raise if what was learned is missing or empty."""
        names = ("similarity",) if "similarity" in self.tables else ("users", "items")
        for n in names:
            if n not in self.tables or self.tables[n].isEmpty():
                raise ValueError(f"{self.name} has no {n}")
        return self

    def save(self, path: str) -> None:
        Bundle(self.cells.sparkSession, path).save({"name": self.name, "settings": self.settings, "cells": self.cells, "tables": self.tables})


def load(spark: SparkSession, path: str) -> Model:
    b = Bundle(spark, path).load()
    return Model(b["name"], b["cells"], b["tables"], b["settings"]).check()


#: The model at a path, or None if it cannot be loaded for any reason (which is logged).
load_or_none = or_none(load)


def _factor_tables(m: factors.Factors) -> dict[str, DataFrame]:
    return {"users": m.users, "items": m.items}


#: Models that learn from draws of cells.
DRAWING = ("slim_bpr", "mf", "bpr", "lightgcn")


def _ids(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cells.select(F.col("u").alias("id")).distinct(), cells.select(F.col("i").alias("id")).distinct()


def fit(name: str, cells: DataFrame, *, samples: int | None = None, negative: float = 0.5, seed: int = 0, **settings) -> Model:
    """Train p3_alpha, rp3_beta, item_knn, slim_elastic_net, slim_bpr, mf, bpr or lightgcn with its settings.

    samples: draws per epoch of the models that learn from draws, by default as many as there are stored cells.
    """
    users, items = cells.select("u").distinct(), cells.select("i").distinct()
    if samples is None and name in DRAWING:
        samples = sampling.stored(cells)
    pairs = lambda epoch: sampling.triples(cells, items, samples, seed + epoch)
    if name in ("p3_alpha", "rp3_beta"):
        tables = {"similarity": graph.p3_alpha(cells, **({"beta": 0.6} if name == "rp3_beta" else {}) | settings)}
    elif name == "item_knn":
        tables = {"similarity": graph.item_knn(cells, **settings)}
    elif name == "slim_elastic_net":
        tables = {"similarity": factors.slim_elastic_net(cells, **settings)}
    elif name == "slim_bpr":
        tables = {"similarity": factors.slim_bpr(cells, pairs, **settings)}
    elif name == "mf":
        tables = _factor_tables(factors.fit_mf(lambda epoch: sampling.mixed(cells, users, items, samples, negative, seed + epoch).select("u", "i", "r"), _ids(cells), seed=seed, **settings))
    elif name == "bpr":
        tables = _factor_tables(factors.fit_bpr(pairs, _ids(cells), seed=seed, **settings))
    elif name == "lightgcn":
        v = factors.fit_lightgcn(cells, pairs, seed=seed, **settings)
        side = lambda kind, of: v.where(F.col("id").startswith(kind)).select(F.expr("substring(id, 2)").cast(of).alias("id"), F.col("vector").alias("factors"), F.lit(0.0).alias("bias"))
        tables = {"users": side("u", cells.schema["u"].dataType), "items": side("i", cells.schema["i"].dataType)}
    else:
        raise ValueError(f"no model named {name}")
    return Model(name, cells, tables, settings)
