"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Words are `[^\\x20\\x09-\\x0D]+`. Every rule is an expression over measures of the text. On a sample, the cascade finds
what each rule costs a row and how many rows it rejects, and orders all rules, the base rules among them, by rejections
per second. A rule's cost is the time it adds to a job that evaluates it many times over on cached rows, the measures
that it alone needs included: the same job without it is subtracted, so that scheduling and compiling do not count.

The verdict is one cascade in that order: later rules, and the measures they need, run only on what earlier ones let
through. The order changes the cost and never the verdict: a text is kept if no rule rejects it.

Null text has no words and is rejected by the word count. Ties, repeated rows, null ids and extra columns change
nothing: every row is judged alone, without shuffle. An empty table keeps the order the rules are listed in.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _once(value: Column) -> Column:
    """value, marked so that the optimiser does not copy it into filters and later expressions."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _text (null as empty), _words, _n_words."""
    return docs.withColumn("_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_words", _words(F.col("_text"))).withColumn("_n_words", _once(F.size("_words").cast("bigint")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in windows of five that the text holds more than once, all copies counted.

    Windows are compared by 64-bit hashes within one text. Only texts that hold a repeated window are sorted.
    """
    step = docs.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    step = step.withColumn("_windows", F.when(F.size("_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(placed)).otherwise(none))
    at = lambda j: F.get("_sorted", j)["h"]
    twice = F.filter("_sorted", lambda x, j: F.coalesce(x["h"] == at(j + 1), F.lit(False)) | ((j > 0) & F.coalesce(x["h"] == at(F.greatest(j - 1, F.lit(0))), F.lit(False))))
    step = step.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_starts", lambda x, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("_starts", F.greatest(j - 1, F.lit(0))))))
    return step.withColumn("n_repeat_words", _once(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x))).drop("_hashes", "_windows", "_repeats", "_sorted", "_starts")


def lines(text: str = "_text") -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.col(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def word_chars() -> Column:
    return F.char_length(F.translate("_text", SPACES, "")).cast("bigint")


def n_symbols() -> Column:
    some = f"[{SYMBOLS}]"
    return F.when(F.col("_text").rlike(some), F.char_length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", ""))).otherwise(0).cast("bigint")


def with_lines(docs: DataFrame) -> DataFrame:
    """Adds _n_lines, the lines with a word, and n_dup_lines, those that equal an earlier one."""
    step = docs.withColumn("_lines", _once(lines()))
    return step.withColumn("_n_lines", F.size("_lines")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")).drop("_lines")


def with_chars(docs: DataFrame) -> DataFrame:
    """Adds word_chars and n_symbols."""
    return docs.withColumn("word_chars", _once(word_chars())).withColumn("n_symbols", _once(n_symbols()))


#: Measures, by the column that shows that a table has them, and what adds them.
MEASURES: dict[str, Callable[[DataFrame], DataFrame]] = {"_n_words": with_words, "n_repeat_words": with_repeats, "n_dup_lines": with_lines, "word_chars": with_chars}


@dataclass(frozen=True)
class Rule:
    """A name, the measures it needs (of MEASURES), and the condition over them under which a text is rejected."""

    name: str
    needs: tuple[str, ...]
    rejects: Column

    def rejected(self) -> Column:
        """A null condition rejects nothing."""
        return F.coalesce(self.rejects, F.lit(False))


def base_rules() -> list[Rule]:
    return [Rule("few_words", ("_n_words",), F.col("_n_words") < 10), Rule("repeats", ("_n_words", "n_repeat_words"), 100 * F.col("n_repeat_words") > 20 * F.col("_n_words"))]


def rules() -> list[Rule]:
    """The base rules, and rules with thresholds far from those of running text in any language."""
    n, chars = F.col("_n_words"), F.col("word_chars")
    upper = F.char_length("_text") - F.char_length(F.regexp_replace("_text", "\\p{Lu}", ""))
    letters = F.char_length(F.regexp_replace("_text", "[^\\p{L}]", ""))
    return [
        *base_rules(),
        Rule("symbols", ("_n_words", "word_chars"), 10 * F.col("n_symbols") > chars),
        Rule("word_length", ("_n_words", "word_chars"), (chars > 25 * n) | (chars < 2 * n)),
        Rule("dup_lines", ("_n_words", "n_dup_lines"), 100 * F.col("n_dup_lines") > 50 * F.col("_n_lines")),
        Rule("capitals", ("_n_words",), 10 * upper > 6 * letters),
        Rule("few_letters", ("_n_words", "word_chars"), 2 * letters < chars),
    ]


def base_failed() -> Column:
    failed = [r.rejected() for r in base_rules()]
    return failed[0] | failed[1]


def _measured(docs: DataFrame, *needs: str) -> DataFrame:
    for m in needs:
        if m not in docs.columns:
            docs = MEASURES[m](docs)
    return docs


def _seconds(rows: DataFrame, wanted: Column) -> tuple[float, int]:
    """The least time of some runs of a job over cached rows, and how many rows are as wanted."""
    best, found = float("inf"), 0
    for _ in range(2):
        began = time.monotonic()
        found = rows.select(F.count_if(wanted)).first()[0]
        best = min(best, time.monotonic() - began)
    return best, found


def costs(docs: DataFrame, found: list[Rule], *, sample: int = 400, times: int = 3) -> dict[str, tuple[float, float]]:
    """What each rule costs (seconds a row) and the share of rows that it rejects, on about `sample` rows.

    Rows are taken by the hash of their number in the scan, so that equal texts do not crowd the sample.
    """
    rows = docs.count()
    if not rows:
        return {}
    numbered = docs.select("text", F.monotonically_increasing_id().alias("_number"))
    some = numbered.where(F.pmod(F.xxhash64("_number"), F.lit(max(1, rows // sample))) == 0).limit(4 * sample)
    # every row several times over, each time to be judged anew
    some = with_words(some).select("_text", "_words", "_n_words", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_turn")).persist()
    n = some.count()
    if not n:
        some.unpersist()
        return {}
    floor, _ = _seconds(some, F.col("_n_words") >= 0)
    out = {}
    for r in found:
        took, rejected = _seconds(_measured(some, *r.needs), r.rejected())
        out[r.name] = (max(took - floor, 0.0) / n, rejected / n)
    some.unpersist()
    return out


#: Seconds a row that every rule costs at least; less can't be told from nothing.
LEAST_COST = 1e-7


def ordered(docs: DataFrame, found: list[Rule], **sampled) -> list[Rule]:
    """Rules by rejections per cost on a sample, ties by name. Empty input keeps the given order."""
    known = costs(docs, found, **sampled)
    return sorted(found, key=lambda r: (-known[r.name][1] / max(known[r.name][0], LEAST_COST), r.name)) if known else found


def passes(cascade: list[Rule]) -> Column:
    """True if nothing rejects; the CASE stops at the first rule that does."""
    case = F.when(cascade[0].rejected(), False)
    for r in cascade[1:]:
        case = case.when(r.rejected(), False)
    return case.otherwise(True)


def measure(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document."""
    cascade = ordered(docs, rules())
    return _measured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), *MEASURES).select(
        "doc_id", F.col("_n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), passes(cascade).alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with.

    Each rule filters what the earlier ones left, and measures are made just before the first rule that needs them.
    """
    # the row travels as one struct, so none of its columns can clash with a measure
    left = docs.select("text", F.struct("*").alias("_row"))
    for r in ordered(docs, rules()):
        left = _measured(left, *r.needs).where(~r.rejected())
    return left.select("_row.*")
