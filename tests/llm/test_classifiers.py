"""Held-out accuracy of language identification and toxicity, and their edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_rows(spark, docs):
    got = language.identify(docs, language.learn(docs), "lang").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_language_kernel_is_the_definition():
    texts = [b"the cat sat", b"der Hund lag", b"the dog sat", b"die Katze"]
    m = language.fit(texts, ["en", "de", "en", "de"], landmarks=1)

    def kernel(x, y):
        total = 0.0
        for n in (1, 2, 3):
            a, b = ({t.lower()[i : i + n] for i in range(len(t) - n + 1)} for t in (x, y))
            total += len(a & b) / np.sqrt(len(a) * len(b))
        return total

    k = m.rows([np.frombuffer(t, np.uint8) for t in texts]) @ m.landmarks.T
    assert np.allclose(k, [[kernel(t, texts[1]), kernel(t, texts[0])] for t in texts], atol=1e-5)


def test_language_edges(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !? _", "en", "s"), (None, "the text", "en", "s"), (5, "the text of it", None, "s"), (6, "the other text", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred == "en" == got[None].lang_pred
    assert language.learn(docs.limit(0)) is None and language.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language.keep_known(docs, least=0.0).columns == docs.columns


def test_language_sends_each_text_once_and_starts_no_other_workers(spark, docs, monkeypatch):
    """Rows that createDataFrame takes pass through Python workers of their own, beside those of mapInArrow."""

    def refused(*a, **k):
        raise AssertionError("createDataFrame")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    kept = language.keep_known(docs)
    plan = kept._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert plan.children().head().schema().simpleString().count("text:") == 1
    both = kept.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert both.count() == kept.count() > 0 and both.where(~F.col("text").eqNullSafe(F.col("was"))).isEmpty()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    auc = np.mean([(s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()])
    assert auc > 0.94 and all(r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "you scum", 9), (4, "nice words", 9), (None, "scum", 9)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, none)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.0}
    names = "abcdefghijklmnopqrst"  # a word counts once more than a few words have stood before it
    model = toxicity.fit(pa.array([t for a in names for t in (f"{a} scum", f"{a} nice", f"more {a} scum here", f"a {a} nice day")]), np.array([1, 0, 1, 0] * len(names)), 0.5)
    s = model.score(pa.array(["scum", "nice", "", None, "scum " * 20000]))
    assert s[0] > s[1] and s[2] == s[3] and s[4] > s[1] and np.isfinite(s).all()
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert docs.select(F.count("*")).first()[0] == 5


def test_repeated_ids_long_texts_and_ties(spark):
    docs = spark.createDataFrame([(1, "you scum", "en")] * 3 + [(1, "you nice", "en"), (3, "nice words " * 200_000, "en"), (None, None, None), (5, "mots", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id == 1}) <= 2 and all(0 <= r.score <= 1 for r in got)
    found = language.identify(docs, language.learn(docs)).collect()
    assert len(found) == 7 and {r.lang_pred for r in found if r.doc_id == 3} == {"en"} and len({(r.lang_pred, r.score) for r in found if r.doc_id == 1}) <= 2
    tied = language.fit([b"abc", b"abc"], ["b", "a"], landmarks=1)
    assert tied.predict([np.frombuffer(b"abc", np.uint8)])[0] == ["a"]


def test_kneser_ney_by_its_formulas():
    """Word and pair ratios against a plain version with dictionaries."""
    from collections import Counter

    toxic, ordinary = ["a b c a b", "b a b c", "c c a"], ["a c b", "b b a c a", "c a c b a", "a b"]
    texts = toxic + ordinary
    model = toxicity.fit(pa.array(texts), np.array([1] * 3 + [0] * 4), 0.5)  # few rows: all of them are counted
    d, e = toxicity.DISCOUNT, toxicity.CLASS_DISCOUNT
    words = sorted({w for t in texts for w in t.split()})
    counts = [Counter(p for t in of for p in zip(t.split(), t.split()[1:], strict=False)) for of in (ordinary, toxic)]
    types = {p for c in counts for p in c}
    shared = Counter(w for _, w in types)
    lost = len(types) - sum(max(shared[w] - d, 0) for w in words) + 1
    base = {w: (max(shared[w] - d, 0) + lost / (len(words) + 1)) / (len(types) + 1) for w in words}

    def single(c, w):
        kinds = Counter(x for _, x in counts[c])
        total = sum(kinds.values())
        left = {x: max(kinds[x] - e, 0) for x in words}
        return left[w] / total + (1 - sum(left.values()) / total) * base[w]

    def pair(c, v, w):
        seen = sum(n for (x, _), n in counts[c].items() if x == v)
        follow = sum(1 for x, _ in counts[c] if x == v)
        weight = d * follow / seen if seen else 1.0
        return max(counts[c][v, w] - d, 0) / max(seen, 1) + weight * single(c, w)

    got = model.ratios(pa.array([f"{w}" for w in words] + [f"{v} {w}" for v, w in sorted(types)]))
    for w, r in zip(words, got, strict=False):
        assert np.isclose(r[0], np.log(single(1, w) / single(0, w)), atol=1e-5)
    for (v, w), r in zip(sorted(types), got[len(words) :], strict=True):
        want = (np.log(single(1, v) / single(0, v)) + np.log(pair(1, v, w) / pair(0, v, w))) / 2
        assert np.isclose(r[0], want, atol=1e-5)


def test_nystroem_ridge_by_its_formulas():
    """Scores against a kernel ridge regression written out on the landmarks' kernel matrix."""
    texts = [b"the cat sat on the mat", b"der Hund lag auf dem Bett", b"the dog sat by the door", b"die Katze lag im Bett", b"a bird in the hand"]
    langs = ["en", "de", "en", "de", "en"]
    model = language.fit(texts, langs, landmarks=2)

    def kernel(x, y):
        total = 0.0
        for n in (1, 2, 3):
            a, b = ({t.lower()[i : i + n] for i in range(len(t) - n + 1)} for t in (x, y))
            total += len(a & b) / np.sqrt(len(a) * len(b))
        return total

    marks = [texts[1], texts[3], texts[0], texts[2]]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    k_nm = np.array([[kernel(a, b) for b in marks] for a in texts])
    y = np.array([[1.0 if lang == x else -1.0 for x in ("de", "en")] for lang in langs])
    w = np.diag([1 / langs.count(lang) for lang in langs])
    # ridge on the map K_nm K_mm^(-1/2) is this system in the landmarks' weights
    alpha = np.linalg.solve(k_nm.T @ w @ k_nm + language.RIDGE * k_mm, k_nm.T @ w @ y)
    arrays = [np.frombuffer(t, np.uint8) for t in [*texts, b"the bed", b"das Bett"]]
    want = np.array([[kernel(t, m) for m in marks] for t in [*texts, b"the bed", b"das Bett"]]) @ alpha
    assert np.allclose((model.rows(arrays) @ model.landmarks.T) @ model.weights, want, atol=1e-3)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Scores as by one process that counts all rows, in chunks and buckets of any size; the last rows have words of their own."""
    for name, value in {"CHUNK": 300, "PIECE": 900, "BUCKET": 500}.items():
        monkeypatch.setattr(toxicity, name, value)
    n = 13_000
    rows = [(i, f"w{i % 61} w{i % 7} {'late' if i > n - 400 else 'early'} {'scum' if i % 2 else 'nice'} w{i % 13}", i % 2) for i in range(n)]
    given = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3).cache()
    docs, labels = given.select("doc_id", "text"), given.select("doc_id", "toxic")
    learned = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, learned).collect()}
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    y = np.array([r[2] for r in used])
    model = toxicity.fit(pa.array([r[1] for r in used]), y, y.mean())
    want = model.score(pa.array([r[1] for r in rows]))
    assert len(learned.words.value[0].vocabulary) == len(model.vocabulary) and len(got) == n
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-6)
    assert len({got[i] for i in range(0, 61 * 7 * 13 * 2 * 2, 61 * 7 * 13 * 2) if i < n - 400}) == 1
