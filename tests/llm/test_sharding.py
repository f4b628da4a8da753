"""Shards against the law, the slots' law, and equal texts."""

import random
import zlib
from collections import defaultdict

import numpy as np

from quillon.llm.sharding import place, shard

SCHEMA = "doc_id long, text string, shard string, same int"


def laid_out(spark, rows, shards):
    got = shard(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), shards=shards).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for s, found in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in found) == list(range(len(found)))
    return got, by


def test_balance_and_groups(spark):
    dice = random.Random(2)
    rows = [(i, " ".join(["wörd"] * dice.randint(0, 60))) for i in range(3000)]
    rows = [(i, f"{t} {i % 1200}") for i, t in rows] + [(9000, None), (9001, ""), (9002, None)]
    got, by = laid_out(spark, rows, 8)
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        where[text[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for measure in (lambda r: r.size, lambda r: r.tokens, lambda r: 1):
        loads = [sum(map(measure, found)) for found in by.values()]
        assert len(loads) == 8 and max(loads) < 1.03 * min(loads)


def test_groups_stay_whole_where_a_shard_holds_them(spark):
    """Groups of three quarters of a shard are whole; one that no shard can hold is cut, and the law holds."""
    rows = [(i, f"group {i % 4} text " * 20) for i in range(3000)] + [(i, f"other {i} " * 20) for i in range(3000, 8000)]
    got, by = laid_out(spark, rows, 8)
    text, where = dict(rows), defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    rows = [(i, "the same long text " * 20) for i in range(2000)] + [(i, f"other {i} " * 20) for i in range(2000, 5000)]
    _, by = laid_out(spark, rows, 8)
    loads = [sum(r.size for r in found) for found in by.values()]
    assert max(loads) < 1.05 * min(loads)


def test_place_cuts_only_what_does_not_fit():
    rng = np.random.default_rng(4)
    for _ in range(40):
        shards, n = int(rng.integers(2, 12)), int(rng.integers(1, 40))
        rows = rng.integers(1, 3000, n).astype(float)
        loads = np.column_stack([rows * rng.integers(1, 500, n), rows * rng.integers(0, 90, n), rows])
        placed = place(loads, shards)
        for i in range(n):
            parts = sorted(p[1:3] for p in placed if p[0] == i)
            assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False)) and sum(k for _, k in parts) == rows[i]
            assert len(parts) <= 256 * shards
    assert len(place(np.array([[10.0, 5.0, 10.0]] * 8), 8)) == 8 and place(np.zeros((0, 3)), 4) == []


def test_hot_group_without_ids_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.sharding.CHUNK", 50)
    rows = [(None, "none " * 9)] * 500 + [(7, "seven " * 9)] * 400 + [(i, "x" * 300_000) for i in range(8, 11)]
    got = shard(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), shards=3).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_edges(spark):
    assert laid_out(spark, [(1, "a"), (1, "a"), (2, None)], 8)[0]
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
