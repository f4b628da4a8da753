"""Removal against brute force over all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from quillon.llm import repeats
from quillon.llm.repeats import removal_digests, without_repeats

SCHEMA = "doc_id long, text string, block int, spans string"


def brute(rows, least=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            if w in seen:
                gone[i : i + least] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def corpus(seed):
    dice, rows = random.Random(seed), []
    word = lambda: "".join(dice.choice("abcdefghéß") for _ in range(dice.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(dice.randint(15, 60)) for _ in range(6)]
    hot = text(30)
    for _ in range(90):
        parts = [text(dice.randint(0, 60)) for _ in range(dice.randint(1, 4))]
        for _ in range(dice.randint(0, 2)):
            p = dice.choice(passages)
            a = dice.randint(0, 20)
            parts.insert(dice.randint(0, len(parts)), p[a:])
        if dice.random() < 0.5:
            parts.insert(dice.randint(0, len(parts)), hot)
        rows.append("".join(parts))
    rows += [rows[3], rows[3], rows[5][:150], "a" * 1000, "ab" * 300, "a" * 99, "a" * 100, "a" * 101, "", None, rows[7] + rows[7], "Oneaea " * 200, "Oneaea " * 150, "x" * 120 + rows[9]]
    dice.shuffle(rows)
    return [(5 * i + 2, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True, "crowded"])
def test_as_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in {"BLOCK": 6000, "PIECE": 700, "BUCKET": 40, "ARRAY": 50}.items():
            monkeypatch.setattr(repeats, name, value)
    if small == "crowded":
        monkeypatch.setattr(repeats, "MANY", 3)
        monkeypatch.setattr(repeats, "MANY_HERE", 2)
    rows = corpus(11)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    if small:
        # the workers import the module anew, so the small sizes are given to them in closures' place
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(repeats)
    try:
        got = {r.doc_id: r for r in removal_digests(docs).collect()}
    finally:
        if small:
            cloudpickle.unregister_pickle_by_value(repeats)
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[:4], i


def test_text_left_and_edges(spark):
    rows = corpus(12)[:40]
    docs = spark.createDataFrame([(i, t, None if i % 3 else f"s{i}", i) for i, t in rows], "doc_id long, text string, data string, n int")
    found = without_repeats(docs, carry=["data", "n"]).collect()
    assert all(r.n == r.doc_id and r.data == (None if r.n % 3 else f"s{r.n}") for r in found)
    got = {r.doc_id: r.text for r in found}
    assert got == {i: w[4].decode("utf-8", "ignore") for i, w in brute(rows).items()}
    assert removal_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(None, "q" * 40 + "z" * 200), (1, "q" * 40 + "z" * 200), (1, "q" * 40 + "z" * 200)], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in removal_digests(twice.coalesce(1)).collect()]
    assert sorted(got, key=str) == [(1, 199), (1, 240), (None, 240)]


def test_a_passage_in_every_block(spark, monkeypatch):
    """A line that every block holds many times, each time in other words, and a passage that all share."""
    from pyspark import cloudpickle

    for name, value in {"BLOCK": 8000, "BLOCK_ROWS": 40, "MANY_HERE": 4, "MANY": 60}.items():
        monkeypatch.setattr(repeats, name, value)
    dice = random.Random(3)
    noise = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    line, passage = "the line that is in every document, each time in other words, " * 2, noise(260)
    rows = [(i, noise(dice.randint(0, 90)) + line + noise(dice.randint(0, 90)) + (passage if i % 3 else "")) for i in range(400)] + [(900 + i, "") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cloudpickle.register_pickle_by_value(repeats)
    try:
        got = {r.doc_id: r for r in removal_digests(docs).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)
    for i, w in brute(rows).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[:4], i
