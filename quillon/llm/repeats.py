"""Repeated-passage removal with suffix arrays over anchored contexts.

A passage that starts earlier (smaller doc_id, or same document and earlier start) and is at least `least` bytes long
is removed from every later place. Suffixes that share so long a prefix have to meet in one task, so they are dealt
by content: in every window of `least` bytes the smallest hash of its 32-byte grams is an *anchor*, and equal windows
have equal anchors. An anchor's context is the text around it that windows through it can reach.

1. Documents are put into blocks, written to the shared folder. Each block finds its anchors and keeps the first of
   equal contexts; later ones are repeats outright. (anchor, context digest, place) goes to a bucket by anchor.
2. Buckets find contexts that other blocks hold too, and anchors with more than one context.
3. Blocks send the bytes of those differing contexts to buckets by anchor. Each bucket builds an enhanced suffix array
   of the suffixes at its anchors; a stack scan of the common-prefix interval tree, with the test for diverse bytes to
   the left, gives the maximal repeat groups with all their occurrences, and all but the first one are covered.
4. Blocks cut what is covered.

An anchor with very many contexts (a line that millions of documents hold, each in other words) isn't gathered. A block
that has many of its contexts sends their number only. Where the numbers add up to too many, each block reduces its
contexts to distinct windows, and the first place of each window is found by an aggregate that combines before the
shuffle. Equal contexts and windows are reduced in each block before anything is shuffled. So one anchor puts at most
MANY_HERE rows of 41 bytes a block into one task.

Contexts of different blocks count as equal by 128-bit digests, contexts and windows of one block by 64 bits.
Null text is empty. Rows without doc_id come last in the order; rows that repeat a doc_id are ordered by block and
place, which are fixed once the blocks are written. Repeated rows are documents of their own, so all but the first
lose their passages. Texts of any length are worked on whole, a piece at a time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, mix64, partitions, short, utf8
from quillon.llm.suffix import merge, repeated

GRAM = 32
#: Bytes of a block (compressed, it stays under what the JVM holds apart as huge), of a piece of it that is worked on at
#: once, and anchors of a bucket on average.
BLOCK, PIECE, BUCKET = 1 << 20, 1 << 17, 250_000
#: Rows of a block, and bytes of their other columns.
BLOCK_ROWS, BLOCK_CARRIED = 8192, 1 << 23
#: Contexts of one anchor that a block sends, and contexts of it that are compared, before they are dealt as windows.
MANY_HERE, MANY = 64, 16_384
#: Contexts in one suffix array, if they do not share an anchor.
ARRAY = 6_000

_T = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
#: Letters and bases of two independent digests.
_LETTERS = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=4)
def _powers(bits: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, np.uint64(_BASES[which])), np.full(1 << bits, np.uint64(pow(_BASES[which], -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Digests:
    """64-bit digests of any substrings of a buffer, of one of two kinds."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers(max(16, len(data).bit_length()), which)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[which][data] * up[: len(data)], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def _window_digests(data: np.ndarray, start: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Digests of windows at ascending starts, a piece of the buffer at a time."""
    out = np.zeros(len(start), np.uint64)
    for low in range(0, len(data) if len(start) else 0, PIECE):
        a, b = np.searchsorted(start, [low, low + PIECE])
        if a < b:
            at = start[a:b] - low
            out[a:b] = Digests(data[low : low + PIECE + size], which).of(at, at + size)
    return out


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + n] for each i with n values."""
    size = 1
    while 2 * size <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _pieces(offsets: np.ndarray, least: int):
    """(first row, last row + 1, from, to, core from, core to) in bytes: runs of documents, or parts of a long one."""
    sizes, begin, rows = np.diff(offsets).tolist(), offsets.tolist(), len(offsets) - 1
    i = 0
    while i < rows:
        if sizes[i] > PIECE:
            for core in range(begin[i], begin[i + 1], PIECE):
                stop = min(core + PIECE, begin[i + 1])
                yield i, i + 1, max(begin[i], core - 2 * least), min(begin[i + 1], stop + 2 * least), core, stop
            i += 1
            continue
        j = i + 1
        while j < rows and sizes[j] <= PIECE and begin[j + 1] - begin[i] <= PIECE:
            j += 1
        yield i, j, begin[i], begin[j], begin[i], begin[j]
        i = j


class Anchors:
    """All anchors of a block: gram and context digests, row, and the context's bounds in the block's bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        reach = least - GRAM
        parts: list[tuple[np.ndarray, ...]] = []
        for first, last, low, high, core, stop in _pieces(offsets, least):
            if high - low < least:
                continue
            piece = data[low:high]
            bounds = np.clip(offsets[first : last + 1], low, high) - low
            gram = _T[piece]
            for k in (1, 2, 4, 8, 16):
                gram = gram[:-k] * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + gram[k:]
            gram = mix64(gram)
            row_end = np.repeat(bounds[1:], np.diff(bounds))
            place = np.arange(len(piece))
            short = (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # equal ones are both anchors
            window = _sliding(short, reach + 1, np.minimum)
            window[place[: len(window)] + least > row_end[: len(window)]] = 0
            padded = np.zeros(len(window) + 2 * reach, np.uint32)
            padded[reach : reach + len(window)] = window
            at = np.flatnonzero(_sliding(padded, reach + 1, np.maximum) == short)
            at = at[(at >= core - low) & (at < stop - low)]
            row = np.searchsorted(bounds, at, side="right") - 1
            begin, end = np.maximum(at - reach, bounds[row]), np.minimum(at + least, bounds[row + 1])
            places = (at - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            contexts = [mix64(Digests(piece, which).of(begin, end) + places) for which in (0, 1)]
            parts.append((gram[at], *contexts, row + first, begin + low, end + low, at - begin))
        empty = (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 4
        self.gram, self.context, self.check, self.row, self.begin, self.end, self.left = (np.concatenate(x) for x in zip(*(parts or [empty]), strict=True))
        # the first of equal contexts in this block; the others repeat it
        self.first = _firsts(self.context)
        kept = np.flatnonzero(self.first)
        _, inverse, count = np.unique(self.gram[kept], return_inverse=True, return_counts=True)
        many = count[inverse] > MANY_HERE
        # of anchors with many contexts, which are held back, one row goes with their number
        self.held = kept[many]
        new = _firsts(self.gram[self.held])
        self.sent = np.concatenate([kept[~many], self.held[new]])
        self.number = np.concatenate([np.zeros(int((~many).sum()), np.int32), count[inverse][many][new].astype(np.int32)])


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether each value occurs for the first time."""
    order = np.argsort(keys, kind="stable")
    out = np.ones(len(keys), bool)
    out[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, column after column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unsqueeze(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw[at : at + size], k))
        at += size
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of consecutive ranges."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def blocks(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """block, ids (doc_id of each row, null last), sizes, n_bytes, data (all texts, compressed), carried (other columns)."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.struct(F.lit(0).alias("_always"), *[F.col(f"`{c}`") for c in carry]).alias("carried"))
    schema = f"block bigint, ids array<bigint>, sizes array<bigint>, n_bytes bigint, data binary, carried array<{given.schema['carried'].dataType.simpleString()}>"

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        carried: list[pa.Array] = []
        held, beside = 0, 0.0

        def out():
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            sorted_texts = [texts[i] for i in order]
            others = pa.concat_arrays(carried).take(pa.array(order))
            columns = [
                pa.array([(task << 32) + number]), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([list(map(len, sorted_texts))], pa.list_(pa.int64())),
                pa.array([sum(map(len, texts))], pa.int64()), pa.array([zstandard.compress(b"".join(sorted_texts), 3)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(others)], pa.int32()), others),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "n_bytes", "data", "carried"])

        for b in short(batches):
            data, offsets = utf8(b.column(1))
            raw, docs_here, since = data.tobytes(), b.column(0).to_pylist(), 0
            each = b.column(2).nbytes / max(1, b.num_rows)
            for i, doc in enumerate(docs_here):
                ids.append(doc)
                texts.append(raw[offsets[i] : offsets[i + 1]])
                held += len(texts[-1])
                beside += each
                if held >= BLOCK or len(ids) >= BLOCK_ROWS or beside >= BLOCK_CARRIED:
                    carried.append(b.column(2).slice(since, i + 1 - since))
                    yield out()
                    number, since = number + 1, i + 1
                    ids, texts, carried, held, beside = [], [], [], 0, 0.0
            if since < len(docs_here):
                carried.append(b.column(2).slice(since))
        if ids:
            yield out()

    return given.mapInArrow(run, schema)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(row["data"]) if row["n_bytes"] else b"", np.uint8)
    offsets = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
    return data, offsets, ids


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _send(batches, least: int, buckets: int):
    """Each block's anchors to their buckets."""
    for row in _rows(batches):
        data, offsets, ids = _open(row)
        a = Anchors(data, offsets, least)
        to = _bucket(a.gram[a.sent], buckets)
        order = np.argsort(to, kind="stable")
        out = {"bucket": [], "block": [], "n": [], "data": []}
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
            s = a.sent[part]
            for k, v in (("bucket", int(to[part[0]])), ("block", row["block"]), ("n", len(s)), ("data", _squeeze(a.gram[s], a.context[s], a.check[s], ids[a.row[s]], a.row[s].astype("<i4"), a.begin[s].astype("<i4"), a.number[part]))):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))


#: What a bucket says of an anchor: no other context, a repeat outright, contexts differ, dealt as windows.
ALONE, REPEAT, DIFFERS, CROWDED = 0, 1, 2, 3


def _judge(group: pa.Table) -> pa.Table:
    """A bucket's verdicts, for each block in the order it sent its anchors."""
    blocks, sizes = group["block"].to_numpy(), group["n"].to_numpy()
    kinds = ("<u8", "<u8", "<u8", "<i8", "<i4", "<i4", "<i4")
    gram, context, check, doc, row, begin, number = (np.concatenate(x) for x in zip(*(_unsqueeze(d.as_py(), n, *kinds) for d, n in zip(group["data"], sizes, strict=True)), strict=True))
    block = np.repeat(blocks, sizes)
    verdict = np.full(len(gram), REPEAT, np.uint8)
    plain = np.flatnonzero(number == 0)  # a row with a number is no context
    order = plain[np.lexsort([begin[plain], row[plain], block[plain], doc[plain], check[plain], context[plain]])]
    new = np.ones(len(order), bool)
    new[1:] = (context[order[1:]] != context[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    firsts = order[new]
    _, inverse = np.unique(gram, return_inverse=True)
    size = int(inverse.max(initial=0)) + 1
    count = np.bincount(inverse[firsts], minlength=size) + np.bincount(inverse, number, size).astype(np.int64)
    # contexts that a block has held back are compared with all others, or dealt as windows with them
    said = np.where(count > MANY, CROWDED, np.where(count > 1, DIFFERS, ALONE)).astype(np.uint8)
    verdict[firsts] = said[inverse[firsts]]
    verdict[number > 0] = said[inverse[number > 0]]
    cuts = np.split(verdict, np.cumsum(sizes)[:-1])
    return pa.table({"block": pa.array(blocks), "bucket": group["bucket"], "data": pa.array([_squeeze(v) for v in cuts], pa.binary())})


ANSWER = "kind int, key bigint, block bigint, n bigint, data binary, a bigint, b bigint, doc bigint, row int, begin int"


def _answer(batches, least: int, buckets: int, spread: int):
    """Each block, with its verdicts: what is covered already (kind 0), contexts to compare (1), and windows (2)."""
    head = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    tail = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("row", pa.int32()), ("begin", pa.int32())])
    schema = pa.schema([*head, *tail])
    for r in _rows(batches):
        data, offsets, ids = _open(r)
        a = Anchors(data, offsets, least)
        to = _bucket(a.gram[a.sent], buckets)
        by_bucket = np.argsort(to, kind="stable")
        said = np.zeros(len(a.sent), np.uint8)
        for v in r["said"] or []:
            low, high = np.searchsorted(to[by_bucket], [v["bucket"], v["bucket"] + 1])
            said[by_bucket[low:high]] = _unsqueeze(v["data"], high - low, "u1")[0]
        covered = [np.flatnonzero(~a.first), a.sent[said == REPEAT]]
        own = a.number == 0
        dealt = np.isin(a.gram[a.held], a.gram[a.sent[(said == CROWDED) & ~own]])  # the others held back are compared
        differing = np.concatenate([a.sent[(said == DIFFERS) & own], a.held[~dealt]])
        crowded = np.concatenate([a.held[dealt], a.sent[(said == CROWDED) & own]])
        spans = [(a.row[c], a.begin[c], a.end[c]) for c in covered]
        size = a.end[crowded] - a.begin[crowded] - least + 1
        start, row = _ranges(a.begin[crowded], size), np.repeat(a.row[crowded], size)
        order = np.argsort(start, kind="stable")
        start, row = start[order], row[order]
        new = _firsts(start)
        start, row = start[new], row[new]
        digest = _window_digests(data, start, least)
        new = _firsts(digest)
        spans.append((row[~new], start[~new], start[~new] + least))
        out = {"kind": [], "key": [], "block": [], "n": [], "data": []}

        def add(kind, k, n, blob, out=out, block=r["block"]):
            for c, v in zip(out.values(), (kind, k, block, n, blob), strict=True):
                c.append(v)

        if len(differing):
            key, row_of, begin = a.gram[differing], a.row[differing], a.begin[differing]
            length, left = a.end[differing] - begin, a.left[differing]
            to = _bucket(key, spread)
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                text = data[_ranges(begin[part], length[part])]
                add(1, int(to[part[0]]), len(part), _squeeze(key[part], ids[row_of[part]], row_of[part].astype("<i4"), begin[part].astype("<i4"), left[part].astype("<i4"), length[part].astype("<i4"), text))
        merged = merge(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        if len(merged[0]):
            add(0, 0, len(merged[0]), _squeeze(*(x.astype("<i4") for x in merged)))
        n = len(out["kind"])
        yield pa.RecordBatch.from_arrays([*(pa.array(out[f.name], f.type) for f in head), *(pa.nulls(n, f.type) for f in tail)], schema=schema)
        start, row = start[new], row[new]
        other = _window_digests(data, start, least, 1)
        for low in range(0, len(start), 1 << 14):
            s = slice(low, low + (1 << 14))
            n = len(start[s])
            places = [pa.array(digest[new][s].view(np.int64)), pa.array(other[s].view(np.int64)), pa.array(ids[row[s]]), pa.array(row[s].astype(np.int32)), pa.array(start[s].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.full(n, r["block"], np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *places], schema=schema)


def _compare(group: pa.Table, least: int) -> pa.Table:
    """A bucket's contexts: what maximal repeats cover, by block."""
    blocks, sizes = group["block"].to_numpy(), group["n"].to_numpy()
    parts, strings = [], []
    for blob, n in zip(group["data"], sizes.tolist(), strict=True):
        raw = zstandard.decompress(blob.as_py())
        heads = [np.frombuffer(raw, k, n, at) for k, at in (("<u8", 0), ("<i8", 8 * n), ("<i4", 16 * n), ("<i4", 20 * n), ("<i4", 24 * n), ("<i4", 28 * n))]
        ends = 32 * n + np.cumsum(heads[5], dtype=np.int64)
        strings += [raw[e - s : e] for e, s in zip(ends.tolist(), heads[5].tolist(), strict=True)]
        parts.append(heads)
    key, doc, row, begin, left, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
    block = np.repeat(blocks, sizes)
    place = np.empty(len(key), np.int64)
    place[np.lexsort([begin + left, row, block, doc])] = np.arange(len(key))
    by_key = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], key[by_key][1:] != key[by_key][:-1]]))
    stops, at = np.concatenate([edges[1:], [len(key)]]).tolist(), 0
    found = []
    for i, stop in enumerate(stops):
        if i + 1 < len(stops) and stops[i + 1] - at <= ARRAY:
            continue  # whole anchors go into one array while they fit
        members = by_key[at:stop]
        at = stop
        if len(members) > 1:
            s, b, e = repeated([strings[m] for m in members], left[members].astype(np.int64), place[members], least)
            m = members[s]
            found.append((block[m], row[m], begin[m] + b, begin[m] + e))
    out = {"block": [], "n": [], "data": []}
    if found:
        block, row, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(block, kind="stable")
        for p in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
            for k, v in (("block", int(block[p[0]])), ("n", len(p)), ("data", _squeeze(row[p].astype("<i4"), begin[p].astype("<i4"), end[p].astype("<i4")))):
                out[k].append(v)
    return pa.table(out, pa.schema([("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))


def _later(windows: DataFrame) -> DataFrame:
    """block, starts: the windows that start earlier elsewhere. Only sums and the windows of a block are gathered."""
    place = F.struct("doc", "block", "row", "begin")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(first, ["a", "b"]).where(place > F.col("first")).groupBy("block").agg(F.collect_list("begin").alias("starts"))


def covered(docs: DataFrame, *, least: int = 100, carry: list[str] = ()) -> DataFrame:
    """Blocks of all documents with what is covered: the columns of `blocks`, spans array<struct<n,data>>, starts."""
    if least < 2 * GRAM:
        raise ValueError(f"passages of at least {2 * GRAM} bytes only")
    spark = docs.sparkSession
    put, _ = materialize(spark, blocks(docs, carry), "blocks")
    total = put.agg(F.sum("n_bytes")).first()[0] or 0
    # anchors are about 2 / (windows' grams + 1) of all bytes
    buckets = max(partitions(spark), int(total * 2 / (least - GRAM + 2) / BUCKET) + 1)
    spread = 4 * buckets
    sent = put.select("block", "ids", "sizes", "n_bytes", "data").mapInArrow(lambda b: _send(b, least, buckets), "bucket bigint, block bigint, n bigint, data binary")
    verdicts, verdicts_at = materialize(spark, sent.groupBy("bucket").applyInArrow(_judge, "block bigint, bucket bigint, data binary"), "verdicts")
    said = verdicts.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("said"))
    answers = put.join(said, "block", "left").select("block", "ids", "sizes", "n_bytes", "data", "said")
    answered, answered_at = materialize(spark, answers.mapInArrow(lambda b: _answer(b, least, buckets, spread), ANSWER), "contexts")
    compared = answered.where("kind = 1").select("key", "block", "n", "data").groupBy("key").applyInArrow(lambda g: _compare(g, least), "block bigint, n bigint, data binary")
    spans = answered.where("kind = 0").select("block", "n", "data").union(compared)
    found = spans.groupBy("block").agg(F.collect_list(F.struct("n", "data")).alias("spans"))
    later = _later(answered.where("kind = 2").select("block", "a", "b", "doc", "row", "begin"))
    by_block, _ = materialize(spark, found.join(later, "block", "full"), "spans")
    discard(spark, verdicts_at, answered_at)
    return put.join(by_block, "block", "left").select(*put.columns, F.lit(least).alias("least"), "spans", "starts")


def _cut(batches):
    """Each document's id, carried columns, bytes, covered bytes and runs, and what is left."""
    for r in _rows(batches):
        data, offsets, _ = _open(r)
        spans = [_unsqueeze(s["data"], s["n"], "<i4", "<i4", "<i4") for s in r["spans"] or []]
        change = np.zeros(len(data) + 1, np.int64)
        if r["starts"]:
            starts = np.array(r["starts"], np.int64)
            spans.append((starts, starts, starts + r["least"]))
        if spans:
            _, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
            change += np.bincount(begin, minlength=len(change)) - np.bincount(end, minlength=len(change))
        gone = np.cumsum(change[:-1]) > 0
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        bounds = offsets[:-1][np.diff(offsets) > 0]
        rises[bounds] = gone[bounds]
        for i, (doc, others) in enumerate(zip(r["ids"], r["carried"], strict=True)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            yield doc, others, b - a, int(gone[a:b].sum()), int(rises[a:b].sum()), data[a:b][~gone[a:b]].tobytes()


def _batched(rows, make, size: int = 256):
    held = []
    for row in rows:
        held.append(make(*row))
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def removal_digests(docs: DataFrame, *, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        make = lambda doc, _, n, gone, spans, left: dict(zip(kinds.names, (doc, n, gone, spans, hashlib.sha256(left).hexdigest()), strict=True))
        for rows in _batched(_cut(batches), make):
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return covered(docs, least=least).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, *, least: int = 100, carry: list[str] = ()) -> DataFrame:
    """doc_id, text and the columns to carry of every document, less its repeated passages.

    Characters cut in half go whole.
    """
    tables = covered(docs, least=least, carry=carry)
    struct = tables.schema["carried"].dataType.elementType.simpleString()

    def run(batches):
        kinds = None

        def watched():
            nonlocal kinds
            for b in batches:
                kinds = b.schema.field("carried").type.value_type
                yield b

        for rows in _batched(_cut(watched()), lambda doc, others, n, gone, spans, left: (doc, left.decode("utf-8", "ignore"), others)):
            ids, texts, others = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(others, kinds)], names=["doc_id", "text", "carried"])

    out = tables.mapInArrow(run, f"doc_id bigint, text string, carried {struct}")
    return out.select("doc_id", "text", *[F.col(f"carried.`{c}`").alias(c) for c in carry])
