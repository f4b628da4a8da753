"""Draws take their first free candidate, and make candidates only as long as they need them."""

import hashlib

from pyspark.sql import functions as F

from quillon.operators import sampling


def _number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_triples_make_few_candidates(spark, monkeypatch):
    cells = spark.range(600).selectExpr("id div 20 AS u", "id % 20 AS i", "1.0d AS r").where((F.col("u") * 7 + F.col("i") * 3) % 5 < 3)
    items = cells.select("i").distinct()
    tables, keep = [], sampling.written
    monkeypatch.setattr(sampling, "written", lambda df: tables.append(keep(df)) or tables[-1])
    got = sorted(map(tuple, sampling.triples(cells, items, 800, 2).collect()))
    stored = sorted((r["u"], r["i"]) for r in cells.collect())
    names, want, tried = sorted({i for _, i in stored}), [], 0
    for draw in range(800):
        u, i = stored[_number(2, "p", draw) % len(stored)]
        for t in range(1, sampling.TRIES + 1):
            j = names[_number(2, "n", draw, t) % len(names)]
            tried += 1
            if (u, j) not in stored:
                want.append((u, i, j))
                break
    assert got == sorted(want) and tried < 4 * 800
    rounds = [t.count() for t in tables if "_x" in t.columns]
    assert rounds[0] == 800 and rounds == sorted(rounds, reverse=True) and sum(rounds) < 2 * 800
