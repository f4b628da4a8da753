"""Hyper-parameter search, experiment pools, and timing."""

from __future__ import annotations

import functools
import itertools
import logging
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession

from quillon.sources.store import Bundle, digest, exists

log = logging.getLogger("quillon")


@dataclass(frozen=True)
class Integer:
    low: int
    high: int

    def draw(self, dice: random.Random) -> int:
        return dice.randint(self.low, self.high)


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def draw(self, dice: random.Random) -> float:
        if self.log:
            return self.low * (self.high / self.low) ** dice.random()
        return dice.uniform(self.low, self.high)


@dataclass(frozen=True)
class Categorical:
    values: tuple

    def draw(self, dice: random.Random):
        return dice.choice(self.values)


#: Search spaces of the models.
SPACES = {
    "p3_alpha": {"k": Integer(5, 1000), "alpha": Real(0.0, 2.0), "normalize": Categorical((True, False))},
    "rp3_beta": {"k": Integer(5, 1000), "alpha": Real(0.0, 2.0), "beta": Real(0.0, 2.0), "normalize": Categorical((True, False))},
    "mf": {"width": Integer(1, 200), "epochs": Integer(1, 500), "rate": Real(1e-4, 1e-1, log=True), "reg": Real(1e-5, 1e-2, log=True)},
    "bpr": {"width": Integer(1, 200), "epochs": Integer(1, 500), "rate": Real(1e-4, 1e-1, log=True), "reg": Real(1e-5, 1e-2, log=True)},
    "item_knn": {"k": Integer(5, 1000), "shrink": Real(0.0, 1000.0), "normalize": Categorical((True, False))},
    "slim_bpr": {"k": Integer(5, 1000), "epochs": Integer(1, 500), "rate": Real(1e-4, 1e-1, log=True), "reg": Real(1e-5, 1e-2, log=True), "symmetric": Categorical((True, False)), "optimizer": Categorical(("sgd", "adagrad", "adam"))},
    "slim_elastic_net": {"k": Integer(5, 1000), "l1_ratio": Real(1e-5, 1.0, log=True), "alpha": Real(1e-3, 1.0)},
    "lightgcn": {"width": Integer(2, 350), "layers": Integer(1, 6), "epochs": Integer(1, 500), "rate": Real(1e-4, 1e-1, log=True), "reg": Real(1e-5, 1e-2, log=True)},
}


def grid(space: dict[str, list]) -> Iterator[dict]:
    for values in itertools.product(*space.values()):
        yield dict(zip(space, values, strict=True))


def draws(space: dict, n: int, seed: int = 0) -> Iterator[dict]:
    dice = random.Random(seed)
    for _ in range(n):
        yield {name: s.draw(dice) for name, s in space.items()}


def search(objective: Callable[[dict], float], settings: Iterator[dict], *, spark: SparkSession | None = None, path: str | None = None) -> tuple[dict, float, list[tuple[dict, float]]]:
    """The setting of the highest value (the first among equals), the value, and all that were tried.

    path: a folder (of the session's file system) where each result is kept as it comes; a search that is started again
    takes the results that are there.
    """
    tried = []
    for s in settings:
        known = _kept(spark, path, s) if path else None
        if known is None:
            known = objective(s)
            if path:
                Bundle(spark, f"{path.rstrip('/')}/{digest(s)}").save({"setting": s, "value": known})
        tried.append((s, known))
    best = max(tried, key=lambda t: t[1])
    return *best, tried


def _kept(spark: SparkSession, path: str, setting: dict) -> float | None:
    at = f"{path.rstrip('/')}/{digest(setting)}"
    return Bundle(spark, at).get("value") if exists(spark, f"{at}/_manifest") else None


def pool(jobs: list[Callable[[], object]], workers: int = 4, retries: int = 2) -> list[object]:
    """Run independent jobs of one session side by side; a job that keeps failing is logged and gives None."""

    def attempt(job):
        for turn in range(retries + 1):
            try:
                return job()
            except Exception:
                log.exception("job failed, attempt %d of %d", turn + 1, retries + 1)
        return None

    with ThreadPoolExecutor(workers) as executor:
        return list(executor.map(attempt, jobs))


def timed(function):
    """Log each call's arguments, shortened, and how long it takes."""

    @functools.wraps(function)
    def call(*args, **kwargs):
        given = ", ".join([*(repr(a)[:40] for a in args), *(f"{k}={v!r}"[:60] for k, v in kwargs.items())])
        began = time.monotonic()
        try:
            return function(*args, **kwargs)
        finally:
            log.info("%s(%s) took %.3f s", function.__qualname__, given, time.monotonic() - began)

    return call


def cached_by_type(function):
    """Results remembered by arguments; equal arguments of different types (1, 1.0, True) are different calls."""
    return functools.lru_cache(maxsize=128, typed=True)(function)


def or_none(function):
    """None, and a log entry, where the call raises."""

    @functools.wraps(function)
    def call(*args, **kwargs):
        try:
            return function(*args, **kwargs)
        except Exception:
            log.exception("%s failed", function.__qualname__)
            return None

    return call
