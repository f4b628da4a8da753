"""Groups against brute force on full sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm.components import components
from quillon.llm.minhash import keep_one, minimums, near_duplicates, sketches
from quillon.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, a string, linked int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets(text, size):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, share):
    s = {i: sets(t, size) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            if s[x] and s[y] and 100 * len(s[x] & s[y]) >= share * len(s[x] | s[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed, families=25, most=14):
    dice, rows = random.Random(seed), []
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(dice.randint(1, 5)))
    for _ in range(families):
        base = [word() for _ in range(dice.randint(5, 160))]
        for _ in range(dice.randint(1, most)):
            copy = list(base)
            for _ in range(dice.choice([0, 0, 1, 2, 3, 5])):
                copy[dice.randrange(len(copy))] = word()
            base = copy if dice.random() < 0.4 else base  # chains, so that groups have long diameters
            rows.append(" ".join(copy))
    rows += ["", None, " \n", "One two", "one TWO", "ÀB c d e", "àB c d e", "one\x1ctwo", "word " * 5000, "word " * 4000]
    dice.shuffle(rows)
    return [(3 * i + 7, t) for i, t in enumerate(rows)]


def test_sets_are_those_of_the_words():
    texts = [t for _, t in corpus(1)] + ["x" * 70000 + " y", "\t\ta\x0bb\x0cc\rd\ne f"]
    for size in (1, 4, 5):
        got = list(shingle_sets(pa.array(texts), size, most=3000))
        want = [sets(t, size) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        assert len({h for g in got for h in g.tolist()}) == len(set().union(*want))


def test_groups_as_by_brute_force(spark):
    for seed, size in ((2, 4), (3, 5)):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), size=size).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f", "x", 1), (None, "a b c d e f", "x", 1), (4, "a b c d e f", "x", 1), (4, "a b c d e f", "x", 1), (5, "A b c d e f", "x", 1)], SCHEMA)
    got = near_duplicates(docs).collect()
    assert len(got) == 5 and [r.component_id for r in got if r.doc_id] == [4, 4, 4]
    left = keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 4, 4]


def with_ids(rows, size):
    """Groups where an id may stand at several texts: the texts of an id are linked."""
    s = [(i, sets(t, size)) for i, t in rows]
    root = {i: i for i, x in s if x}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(s):
        for j, y in s[n + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(x), find(i) if x else i) for i, x in s)


def test_ids_at_several_texts(spark):
    four = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v w"), (3, "a b c d e f g h")]
    for turn in range(2):
        rows = four[turn:] + four[:turn]
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + turn), size=2)
        assert {r.component_id for r in got.collect()} == {1}
    dice, rows = random.Random(31), corpus(30, families=12)
    many = [(dice.choice([i, i, 500 + i % 9, 900]) if dice.random() < 0.3 else i, t) for i, t in rows] + rows[:20]
    want = with_ids(many, 4)
    for parts in (3,):
        got = near_duplicates(spark.createDataFrame(many, "doc_id long, text string").repartition(parts), size=4)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_smaller_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), share=60)


def test_sketch_distance_follows_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    far = []
    for _ in range(60):
        other = base.copy()
        other[:55] = rng.integers(0, 1 << 63, 55, dtype=np.uint64)  # similarity 0.80
        s = sketches(np.array([minimums(base), minimums(other)]))
        far.append(int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum()))
        base = other
    assert 55 < np.mean(far) < 85 and max(far) < 115


def test_components_of_a_long_chain(spark):
    dice = random.Random(8)
    ids = list(range(300))
    dice.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(149)] + [(ids[200], ids[201]), (5000, 5000)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in ids[:150]} == {min(ids[:150])} and got[ids[200]] == min(ids[200:202]) and len(got) == 152


def test_large_groups_in_small_chunks(spark, monkeypatch):
    """A family dealt in many blocks, some of them empty, gives the same groups."""
    from pyspark import cloudpickle

    from quillon.llm import minhash

    dice = random.Random(12)
    base = [f"w{dice.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(dice.choice([0, 1, 2, 4, 6, 9])):
            copy[dice.randrange(120)] = f"x{dice.randint(0, 5000)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(minhash, "CHUNK", 9)
    monkeypatch.setattr(minhash, "MANY", 30)
    cloudpickle.register_pickle_by_value(minhash)
    try:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(minhash)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)


def test_a_link_in_one_band_is_found_in_buckets_of_any_size(spark, monkeypatch):
    """Linked members that share the band of a large bucket and no other; their component doesn't depend on its size."""
    from quillon.llm import minhash

    texts = [f"{c} text with words of its own {c} {c}" for c in "abcdef"] + ["the same words in one more text", "the same words in one more Text"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    named = minhash._texts(docs).select("doc_id", "same").collect()
    chosen = spark.createDataFrame([(r.doc_id, r.doc_id, r.same, [1, 100 + r.doc_id], [0] * minhash.SKETCH_WORDS) for r in named], "doc long, doc_id long, same long, bands array<long>, sketch array<long>")
    members = spark.createDataFrame([(1, r.doc_id) for r in named], "key long, doc long")
    parts = spark.createDataFrame([(0, 0), (1, 0)], "id long, comp long")
    found = {}
    for many in (100, 3):
        monkeypatch.setattr(minhash, "MANY", many)
        found[many] = [tuple(r) for r in minhash._across(members, parts, chosen, docs, 4, 80).collect()]
    assert found[100] == found[3] == [(6, 7)]


def test_a_worker_keeps_small_tables():
    """Texts of all sizes leave one table of powers behind, no larger than one piece or the last longer text needs."""
    import pyarrow as pa

    from quillon.llm import shingles

    for n in (10, 1000, 70_000, 150_000, 300_000, 10):
        text = "some words " * (n // 11 + 1)
        assert len(next(shingles.shingle_sets(pa.array([text]), 5))) == len(sets(text, 5))
    list(shingles.shingle_sets(pa.array(["some words " * 50] * 3000), 5))
    assert shingles._table.cache_info().currsize == 1 and sum(x.nbytes for x in shingles._powers(16)) <= 1 << 24
