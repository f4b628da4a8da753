"""Native measures against a plain Python version; the cascade's order and verdict."""

import random
import re

from pyspark.sql import functions as F

from quillon.llm.quality import MEASURES, Rule, _measured, costs, keep_good, measure, ordered, passes, rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 10 or 100 * len(covered) > 20 * n)


TEXTS = ["", None, " ", "\n\n", "one", "a b c d e a b c d e", "x " * 30, "l1 w\nl1 w\n l1 w\n\n\nl2", "\x1c\x1d\x85\xa0 é ß", "#*$%&|<> a", "a\tb\x0bc\x0cd\re", "日本 語 🙂 " * 9]


def test_measures(spark):
    dice = random.Random(4)
    texts = TEXTS + [" ".join(dice.choice("abcdefgh") for _ in range(dice.randint(1, 120))) for _ in range(150)] + ["\n".join(dice.choice(["q r s", "", " ", "t"]) for _ in range(20)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = {r.doc_id: r for r in measure(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), repr(t)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in keep_good(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and keep_good(docs).columns == docs.columns
    assert measure(docs.limit(0)).count() == 0 and keep_good(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "alpha beta gamma delta epsilon zeta " * 40_000
    r = measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_words == r.n_repeat_words == 240_000 and r.base_failed and not r.kept


def test_order_follows_rejections_per_cost_and_not_the_verdict(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(200)], "doc_id long, text string")
    often, never = Rule("often", ("_n_words",), F.col("_n_words") > 5), Rule("never", ("_n_words",), F.col("_n_words") < 0)
    assert [r.name for r in ordered(docs, [never, often])] == ["often", "never"]
    found = rules()
    rows = _measured(docs, *MEASURES)
    assert rows.select(passes(found).alias("k")).exceptAll(rows.select(passes(found[::-1]).alias("k"))).count() == 0


def test_a_dear_rule_of_few_rejections_comes_last(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 100) + "end") for i in range(300)], "doc_id long, text string")
    dear = F.aggregate(F.sequence(F.lit(0), F.size("_words") * 30), F.lit(0).cast("bigint"), lambda a, x: a + F.xxhash64(x) % 7) > 10**12
    found = [Rule("dear", ("_n_words",), dear | (F.col("_n_words") > 395)), Rule("cheap", ("_n_words",), F.col("_n_words") > 380)]
    known = costs(docs, found)
    assert known["dear"][0] > known["cheap"][0] and known["dear"][1] < known["cheap"][1]
    assert [r.name for r in ordered(docs, found)] == ["cheap", "dear"]


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, TEXTS[6]), (None, TEXTS[6]), (3, None), (3, "l1 w one two three four five six seven eight"), (3, "l1 w one two three four five six seven eight")], "doc_id long, text string")
    got = measure(docs).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2 and sum(r.kept for r in got) == 2
    assert keep_good(docs).count() == 2
