"""Toxicity by class-conditional Kneser-Ney models.

A bigram model is counted for toxic and one for ordinary documents, on all labelled rows that are not held out. Class
bigrams back off to class continuation counts, and these to continuation counts shared by both classes, so an expression
that neither class has often enough weighs the same on both sides. A document is scored by length-normalised
log-likelihood ratios: over the whole text, over its best short window, and over its best single word in the backed-off
models. A logistic curve over the three, fitted on the third of the labelled rows that was not counted, gives the
probability.

Words are numbered, and what is known of each word goes to all tasks; the driver holds that too, and the three ratios of
each row that fits the curve. Pairs of words stay in buckets of a table: chunks of documents send their pairs there and
get back what these add to each document. Ratios are added up as integers, so sums do not depend on their order.

Null and empty texts, and texts without words, get the ratios 0. Where one of the classes has no usable row, every
score is the share of toxic rows among the usable ones (0 if there are none). Every row is scored alone and whole, so
repeated rows get the same score; an empty table gives an empty one; other columns are ignored. A doc_id with several
labels is toxic if one of them says so; of its texts, if it has several, the greatest one is learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, held_out, materialize, partitions, runs, short, utf8
from quillon.llm.shingles import words

#: Words are runs of letters, digits, apostrophes and non-ASCII bytes.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
#: Words that a chunk holds, bytes of text that are worked on at once, and bytes of all texts for each bucket of pairs.
CHUNK, PIECE, BUCKET = 1 << 19, 1 << 20, 16 << 20
#: Units of a ratio's integers, rows of a class that are too few to fit a curve apart, and ids that are counted off together.
UNIT, FEW, IDS = 1 << 24, 6, 1 << 20
#: Taken from counts of class bigrams and of shared contexts, and from the counts of contexts within a class.
DISCOUNT, CLASS_DISCOUNT, WINDOW = 0.75, 3.0, 8


def word_ids(column) -> tuple[np.ndarray, np.ndarray]:
    return words(*utf8(column), BETWEEN)


def _pairs(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of words that have a word before them in their text."""
    after = np.ones(len(hashes), bool)
    starts = bounds[:-1]
    after[starts[starts < len(hashes)]] = False
    return np.flatnonzero(after)


def _look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted table; len(table) where it doesn't."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, len(table))


def _units(ratio: np.ndarray) -> np.ndarray:
    return np.rint(ratio * float(UNIT)).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _mean(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    return sums / np.maximum(size, 1) / UNIT


def _best(single: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's best window, by its mean, and best word; 0 without words."""
    out = np.zeros((len(bounds) - 1, 2))
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    if len(some):
        # a window that starts in a text ends with it at the latest
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(single)])
        ends = np.minimum(np.arange(len(single)) + WINDOW, np.repeat(bounds[1:], size))
        out[some, 0] = np.maximum.reduceat(total[ends] - total[:-1], bounds[:-1][some]) / WINDOW / UNIT
        out[some, 1] = np.maximum.reduceat(single, bounds[:-1][some]) / UNIT
    return out


@dataclass
class Model:
    vocabulary: np.ndarray
    word_ratio: np.ndarray  # log ratio of the backed-off models; the last entry is for unknown words
    backoff_ratio: np.ndarray  # log ratio of the backoff weights after a word
    pairs: np.ndarray
    pair_ratio: np.ndarray
    curve: np.ndarray  # weights of the three ratios and the intercept
    prior: float

    def ratios(self, column) -> np.ndarray:
        """The three length-normalised ratios of each text."""
        hashes, bounds = word_ids(column)
        n = len(self.vocabulary)
        ids = _look_up(self.vocabulary, hashes)
        single = _units(self.word_ratio)[ids]
        full = single.copy()
        at = _pairs(hashes, bounds)
        where = _look_up(self.pairs, ids[at - 1] * (n + 1) + ids[at])
        known = where < len(self.pairs)
        full[at] += _units(self.backoff_ratio)[ids[at - 1]]
        full[at[known]] = _units(self.pair_ratio)[where[known]]
        return np.hstack([_mean(_sums(full, bounds), np.diff(bounds))[:, None], _best(single, bounds)])

    def score(self, column) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(column), self.prior)
        return _logistic(self.ratios(column) @ self.curve[:3] + self.curve[3])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """Of each word, by its number (the last one is for unknown words), what the formulas need; by class, if of a class."""

    seen: list[np.ndarray]
    single: list[np.ndarray]
    weight: list[np.ndarray]
    word_ratio: np.ndarray
    backoff_ratio: np.ndarray

    def pair_ratio(self, v: np.ndarray, w: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
        """Of pairs that occur of[0] and of[1] times in the classes."""
        full = [np.maximum(of[c] - DISCOUNT, 0) / np.maximum(self.seen[c][v], 1) + self.weight[c][v] * self.single[c][w] for c in (0, 1)]
        return _log_ratio(full)


def _log_ratio(x: list[np.ndarray]) -> np.ndarray:
    return (np.log(x[1]) - np.log(x[0])).astype(np.float32)


def _by_word(pairs: int, shared: np.ndarray, kinds: list[np.ndarray], seen: list[np.ndarray], follow: list[np.ndarray]) -> Words:
    """pairs: kinds of pairs; by word: kinds of pairs that end with it (of both classes, of each), pairs and kinds that begin with it."""
    kept = np.maximum(shared - DISCOUNT, 0)
    base = (kept + (pairs - kept.sum() + 1) / len(shared)) / (pairs + 1)
    single, weight = [], []
    for c in (0, 1):
        left = np.maximum(kinds[c] - CLASS_DISCOUNT, 0)
        total = max(kinds[c].sum(), 1)
        single.append(left / total + (1 - left.sum() / total) * base)
        weight.append(np.where(seen[c] > 0, DISCOUNT * follow[c] / np.maximum(seen[c], 1), 1.0))
    # a word that only one class knows says nothing about what neither has seen after it
    known = (follow[0] > 0) & (follow[1] > 0)
    return Words(seen, single, weight, _log_ratio(single), np.where(known, _log_ratio(weight), np.float32(0)))


def fit(texts: pa.Array, toxic: np.ndarray, prior: float) -> Model:
    """Models of the two classes, in one process; prior is the share of toxic rows among all usable labels."""
    none = np.zeros(0)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(none.astype(np.uint64), none, none, none.astype(np.int64), none, np.zeros(4), prior)
    # every third row of a class fits the curve, the others are counted; too few rows do both
    turn = np.zeros(len(toxic), np.int64)
    for c in (0, 1):
        turn[toxic == c] = np.arange((toxic == c).sum())
    few = min(toxic.sum(), (1 - toxic).sum()) < FEW
    for_curve = np.ones(len(toxic), bool) if few else turn % 3 == 2
    counted = np.ones(len(toxic), bool) if few else ~for_curve
    tables, hashes = {}, {}
    for c in (0, 1):
        hashes[c] = word_ids(texts.filter(pa.array(counted & (toxic == c))))
    vocabulary = np.unique(np.concatenate([h for h, _ in hashes.values()]))
    n = len(vocabulary)
    for c, (h, bounds) in hashes.items():
        ids, at = _look_up(vocabulary, h), _pairs(h, bounds)
        tables[c] = np.unique(ids[at - 1] * (n + 1) + ids[at], return_counts=True)
    pairs = np.unique(np.concatenate([k for k, _ in tables.values()]))
    of = []
    for keys, count in tables.values():
        of.append(np.zeros(len(pairs)))
        of[-1][np.searchsorted(pairs, keys)] = count
    v, w = pairs // (n + 1), pairs % (n + 1)
    by_word = lambda at, weights=None: np.bincount(at, weights, n + 1)
    words_of = _by_word(len(pairs), by_word(w), [by_word(w[x > 0]) for x in of], [by_word(v, x) for x in of], [by_word(v[x > 0]) for x in of])
    model = Model(vocabulary, words_of.word_ratio, words_of.backoff_ratio, pairs, words_of.pair_ratio(v, w, of), np.zeros(4), prior)
    model.curve = _fitted(model.ratios(texts.filter(pa.array(for_curve))), toxic[for_curve].astype(float), prior)
    return model


def _fitted(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """The curve through ratios of labelled rows, in an order of their own, so that sums come out the same."""
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    share = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    return _curve(x, y, share)


def _curve(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; weights for the columns as they are, then the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    ridge = np.diag([0.5, 0.5, 0.5, 1e-6])
    beta = np.zeros(4)
    for _ in range(40):
        p = _logistic(z @ beta)
        h = (z * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (share * (y - p)) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(beta[:3] / scale, beta[3] - (beta[:3] * mean / scale).sum())


@dataclass
class Learned:
    """Models of the two classes whose pairs stay in a table: bucket, n, data (numbers of pairs and what each adds)."""

    words: Broadcast  # Numbers, word_ratio and backoff_ratio, for all tasks
    pairs: DataFrame
    curve: np.ndarray


def _pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys, by their steps, and columns of integers: byte by byte, compressed."""
    parts = [np.diff(keys, prepend=0), *columns]
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in parts), 3)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, 8, n)
    keys, *columns = [np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw]
    return [np.cumsum(keys), *columns]


def _dealt(keys: np.ndarray, buckets: int, *columns: np.ndarray):
    """(bucket, n, data) of the buckets that have keys: the remainder is the bucket, and in it the quotient is the key."""
    keys, to = np.divmod(keys, buckets)
    order = np.lexsort([keys, to])
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
        yield int(to[part[0]]), len(part), _pack(keys[part], *(c[part] for c in columns))


def _pieces(batches):
    """Batches in slices of about PIECE bytes of text (or one longer text); the text is column 0."""
    for b in short(batches):
        for a, z in runs(np.diff(utf8(b.column(0))[1]), PIECE):
            yield b.slice(a, z - a)


def _seen_words(batches):
    held, size = [], 0

    def out():
        words_here, number = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words_here.view(np.int64)), pa.array(number)], names=["word", "n"])

    for b in _pieces(batches):
        held.append(word_ids(b.column(0))[0])
        size += len(held[-1])
        if size >= CHUNK:
            yield out()
            held, size = [], 0
    if held:
        yield out()


@dataclass
class Numbers:
    """Numbers of the words, frequent ones first: so numbers of pairs lie close and pack well."""

    vocabulary: np.ndarray
    number: np.ndarray
    buckets: int

    @staticmethod
    def of(hashes: np.ndarray, count: np.ndarray, buckets: int) -> Numbers:
        order = np.argsort(hashes)
        number = np.empty(len(hashes) + 1, np.int32)
        number[np.lexsort([hashes, -count])] = np.arange(len(hashes))
        number[:-1] = number[:-1][order]
        number[-1] = len(hashes)
        return Numbers(hashes[order], number, buckets)

    @property
    def step(self) -> int:
        """How many numbers of pairs each first word has; without a common factor with the buckets, so that a second word is in all of them."""
        step = len(self.number)
        while np.gcd(step, self.buckets) > 1:
            step += 1
        return step

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.number[_look_up(self.vocabulary, hashes)].astype(np.int64)

    def pairs(self, bucket: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second words of a bucket's keys."""
        return np.divmod(keys * self.buckets + bucket, self.step)


COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _rows_of(dealt) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(COUNTS.names, x, strict=True)) for x in dealt], COUNTS)


def _count(batches, numbers: Numbers):
    """Pairs of the counted rows, and how often each class has them, a chunk at a time."""
    held, size = [], 0

    def out():
        keys, number = np.unique(np.concatenate(held), return_counts=True)
        pairs, at = np.unique(keys >> 1, return_inverse=True)
        return _rows_of(_dealt(pairs, numbers.buckets, *(np.bincount(at[keys & 1 == c], number[keys & 1 == c], len(pairs)) for c in (0, 1))))

    for b in _pieces(batches):
        hashes, bounds = word_ids(b.column(0))
        ids, at = numbers(hashes), _pairs(hashes, bounds)
        toxic = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
        held.append((ids[at - 1] * numbers.step + ids[at]) * 2 + toxic[at])
        size += len(at)
        if size >= CHUNK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _added(group: pa.Table) -> pa.Table:
    """A bucket's keys, with the sums of all their columns."""
    keys, *columns = (np.concatenate(x) for x in zip(*(_unpack(d.as_py(), n.as_py()) for d, n in zip(group["data"], group["n"], strict=True)), strict=True))
    kept, at = np.unique(keys, return_inverse=True)
    data = _pack(kept, *(np.bincount(at, x, len(kept)) for x in columns))
    return pa.table({"bucket": group["bucket"].slice(0, 1), "n": pa.array([len(kept)], pa.int64()), "data": pa.array([data], pa.binary())})


#: What is counted of each word.
STATISTICS = ["shared", "kinds0", "kinds1", "seen0", "seen1", "follow0", "follow1"]


def _statistics(batches, numbers: Numbers):
    """Of each word, what a bucket's pairs tell."""
    for b in batches:
        for bucket, size, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            keys, *of = _unpack(data, size)
            ids, at = np.unique(np.concatenate(numbers.pairs(bucket, keys)), return_inverse=True)
            v, w = at[:size], at[size:]
            by = lambda x, weights=None, k=len(ids): np.bincount(x, weights, k)
            yield _rows_of(_dealt(ids, numbers.buckets, by(w), *(by(w[x > 0]) for x in of), *(by(v, x) for x in of), *(by(v[x > 0]) for x in of)))


def learn(docs: DataFrame, labels: DataFrame) -> Learned | Model:
    """Learns from all labelled documents that are not held out. A Model, of the prior alone, if a class has none."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    # a number and a class of each labelled document go to all tasks, so that only the texts that are learned from move
    turn = F.row_number().over(Window.partitionBy("toxic", F.floor(F.col("doc_id") / IDS)).orderBy("doc_id"))
    turned = known.withColumn("for_curve", turn % 3 == 0)
    texts = whole.where(~held_out("doc_id")).join(F.broadcast(turned), "doc_id").groupBy("doc_id", "toxic", "for_curve").agg(F.max("text").alias("text"))
    given, given_at = materialize(spark, texts.select("text", "toxic", "for_curve"), "labelled")
    parts = {(r["toxic"], r["for_curve"]): r["n"] for r in given.groupBy("toxic", "for_curve").agg(F.count("*").alias("n")).collect()}
    if {c for c, _ in parts} != {0, 1}:
        discard(spark, given_at)
        return fit(pa.array([], pa.string()), np.zeros(0, np.int64), prior)
    # every third row of a class fits the curve, the others are counted; too few rows do both
    few = len(parts) < 4 or min(parts[c, True] + parts[c, False] for c in (0, 1)) < FEW
    counted, for_curve = (given, given) if few else (given.where(~F.col("for_curve")), given.where("for_curve"))
    counted = counted.select("text", "toxic")
    buckets = max(partitions(spark), (whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET + 1)
    seen = counted.select("text").mapInArrow(_seen_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    numbers = Numbers.of(seen["word"].to_numpy().view(np.uint64), seen["n"].to_numpy(), buckets)
    del seen
    n = len(numbers.vocabulary)
    shared = spark.sparkContext.broadcast(numbers)
    schema = "bucket bigint, n bigint, data binary"
    found = counted.mapInArrow(lambda b: _count(b, shared.value), schema).groupBy("bucket").applyInArrow(_added, schema)
    pairs, pairs_at = materialize(spark, found, "pairs")
    at = {s: np.zeros(n + 1, np.int64) for s in STATISTICS}
    for r in pairs.mapInArrow(lambda b: _statistics(b, shared.value), schema).groupBy("bucket").applyInArrow(_added, schema).toLocalIterator():
        ids, *columns = _unpack(r["data"], r["n"])
        ids = ids * buckets + r["bucket"]
        for s, x in zip(STATISTICS, columns, strict=True):
            at[s][ids] = x
    words_of = _by_word(int(at["shared"].sum()), at["shared"], *([at[f"{s}{c}"] for c in (0, 1)] for s in ("kinds", "seen", "follow")))
    formulas = spark.sparkContext.broadcast(words_of)

    def valued(batches):
        f = formulas.value
        word, backoff = _units(f.word_ratio), _units(f.backoff_ratio)
        for b in batches:
            for bucket, size, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, *of = _unpack(data, size)
                v, w = shared.value.pairs(bucket, keys)
                yield _rows_of([(bucket, size, _pack(keys, _units(f.pair_ratio(v, w, of)) - backoff[v] - word[w]))])

    table, _ = materialize(spark, pairs.mapInArrow(valued, schema), "pair-ratios")
    # what has been sent lies on disks too, until it is destroyed
    formulas.destroy(blocking=True)
    shared.destroy(blocking=True)
    model = Learned(spark.sparkContext.broadcast((numbers, words_of.word_ratio, words_of.backoff_ratio)), table, np.zeros(4))
    x = ratios(for_curve.select("text", "toxic"), model).toArrow()
    model.curve = _fitted(np.array([x[f"x{i}"].to_numpy() for i in range(3)]).T, x["toxic"].to_numpy().astype(float), prior)
    discard(spark, given_at, pairs_at)
    del found, texts
    # shuffles stay on disk until the driver's garbage is collected; those of the learning are read no more
    spark.sparkContext._jvm.System.gc()
    return model


ASKED = "bucket bigint, chunk bigint, n bigint, data binary, rows binary"


def _ask(batches, numbers: Numbers, word: np.ndarray, backoff: np.ndarray):
    """Chunks of documents: their pairs to the buckets, and one row with what is known of them without pairs."""
    from pyspark import TaskContext

    kinds = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("rows", pa.binary())])
    n, buckets, chunk = len(numbers.vocabulary), numbers.buckets, TaskContext.get().partitionId() << 32
    word, backoff = _units(word), _units(backoff)
    docs, keys, places, number, size = [], [], [], 0, 0

    def out():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs[0].schema) as stream:
            stream.write_table(pa.Table.from_batches(docs))
        rows = [(chunk % buckets, chunk, number, None, zstandard.compress(sink.getvalue().to_pybytes(), 1))]
        rows += [(bucket, chunk, m, data, None) for bucket, m, data in _dealt(np.concatenate(keys), buckets, np.concatenate(places))]
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

    for b in _pieces(batches):
        hashes, bounds = word_ids(b.column(0))
        ids, at = numbers(hashes), _pairs(hashes, bounds)
        single = word[ids]
        full = single.copy()
        full[at] += backoff[ids[at - 1]]
        at = at[(ids[at - 1] < n) & (ids[at] < n)]
        keys.append(ids[at - 1] * numbers.step + ids[at])
        places.append(np.searchsorted(bounds, at, side="right") - 1 + number)
        best = _best(single, bounds)
        columns = [*b.columns[1:], *(pa.array(c) for c in (_sums(full, bounds), np.diff(bounds), best[:, 0], best[:, 1]))]
        docs.append(pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[1:], "sum", "size", "x1", "x2"]))
        number += b.num_rows
        size += len(hashes) + 16 * b.num_rows
        if size >= CHUNK:
            yield out()
            chunk += 1
            docs, keys, places, number, size = [], [], [], 0, 0
    if docs:
        yield out()


def _tell(asked: pa.Table, table: pa.Table) -> pa.Table:
    """What a bucket's pairs add to the documents of each chunk; the chunks' own rows as they are."""
    own = asked.filter(pa.compute.is_valid(asked["rows"])).select(["chunk", "n", "data", "rows"])
    out = {"chunk": [], "n": [], "data": []}
    if table.num_rows:
        pairs, adds = _unpack(table["data"][0].as_py(), table["n"][0].as_py())
        for chunk, n, data in zip(*(asked[c].to_pylist() for c in ("chunk", "n", "data")), strict=True):
            if data is not None:
                keys, rows = _unpack(data, n)
                where = _look_up(pairs, keys)
                known = where < len(pairs)
                docs, at = np.unique(rows[known], return_inverse=True)
                if len(docs):
                    total = np.zeros(len(docs), np.int64)
                    np.add.at(total, at, adds[where[known]])
                    for c, v in zip(out.values(), (chunk, len(docs), _pack(docs, total)), strict=True):
                        c.append(v)
    told = pa.table({**out, "rows": [None] * len(out["n"])}, own.schema)
    return pa.concat_tables([own, told])


def _gathered(group: pa.Table) -> pa.Table:
    """The documents of a chunk with their ratios."""
    docs, added = None, []
    for n, data, rows in zip(*(group[c].to_pylist() for c in ("n", "data", "rows")), strict=True):
        if rows is None:
            added.append(_unpack(data, n))
        else:
            docs = pa.ipc.open_stream(zstandard.decompress(rows)).read_all()
    total = docs["sum"].to_numpy().copy()
    for at, x in added:
        total[at] += x
    means = pa.array(_mean(total, docs["size"].to_numpy()))
    return pa.table([*docs.columns[:-4], means, docs["x1"], docs["x2"]], names=[*docs.column_names[:-4], "x0", "x1", "x2"])


def ratios(docs: DataFrame, model: Learned) -> DataFrame:
    """The columns of docs but the first, which is the text, and x0, x1, x2: the three length-normalised ratios."""
    shared = model.words
    asked = docs.mapInArrow(lambda b: _ask(b, *shared.value), ASKED)
    told = asked.groupBy("bucket").cogroup(model.pairs.groupBy("bucket")).applyInArrow(_tell, "chunk bigint, n bigint, data binary, rows binary")
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:]]
    return told.groupBy("chunk").applyInArrow(_gathered, ", ".join([*others, "x0 double", "x1 double", "x2 double"]))


def score(docs: DataFrame, model: Learned | Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held_out is null where doc_id is."""
    given = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held_out"))
    learned = isinstance(model, Learned)
    curve = model.curve
    shared = None if learned else docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in short(batches):
            s = _logistic(np.array([b.column(i).to_numpy() for i in (2, 3, 4)]).T @ curve[:3] + curve[3]) if learned else shared.value.score(b.column(0))
            ids = b.columns[:2] if learned else b.columns[1:]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return (ratios(given, model) if learned else given).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
