"""Best-fit packing of tokenised documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the plan is made on their histogram (at most `capacity` entries,
whatever the number of documents) and applied to the rows in place:

* pieces above a third of the capacity pair at most twice per sequence: the largest open one takes the largest that
  still fits beside it (greedy matching);
* smaller pieces, longest first, go where the gap left is smallest.

Rows get their rank among pieces of their length from per-chunk counts and prefix sums, so no length is gathered in
one task; rows get numbers as they are written, and chunks are dealt by these, so no id can crowd one. Null text counts
as empty: a document of the end id alone. Rows that repeat a doc_id, or have none, are documents of their own. Pieces of
equal length are interchangeable: which of them goes where follows the rows' numbers. Texts of any length are encoded
whole, those with very long white space by the tokenizers library itself. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, short

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files, by rule: printable Latin-1 stays, the rest move past 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=2)
def tokeniser(path: str, added: bool = False):
    """A byte-level BPE tokeniser over the vocabulary of a tokenizers file.

    added: strings of the file's added tokens become their ids, as in the tokenizers library as it is loaded; otherwise
    they are ordinary text, as with its encode_special_tokens. The file's ids are its merge ranks, which is what the
    faster of the two installed libraries takes. `pattern` is the pre-tokenisation rule of byte-level BPE.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, extra = file["model"]["vocab"], file.get("added_tokens", []) if added else []
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in extra):
        raise ValueError("added tokens that take in spaces or stand only as whole words are not known here")
    letters = _byte_alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
    # added tokens such as the end of text are no merges
    special = {t: i for t, i in ranks.items() if t.startswith(b"<|") and t.endswith(b"|>")}
    for t in special:
        del ranks[t]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in extra})


#: White space of so many characters goes to the tokenizers library: the faster one's patterns recur on it.
LONG_SPACE = 50_000


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(path: str, text: str | None, end_id: int) -> np.ndarray:
    """The ids of a text, as the tokenizers library gives them without special tokens, and the end id."""
    text = text or ""
    if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in re.finditer(r"\s+", text)):
        ids = _library(path).encode(text, add_special_tokens=False).ids
    else:
        ids = tokeniser(path, added=True).encode(text, allowed_special="all", disallowed_special=())
    return np.array([*ids, end_id], "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: whole sequences, but for a shorter first piece where n leaves a rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, *, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; with_ids adds the token ids themselves."""

    def run(batches):
        for b in short(batches):
            columns: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = token_ids(tokenizer_path, text, end_id)
                for i, (at, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    for c, v in zip(columns, (doc, i, at, n, zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            keep = slice(0, 6 if with_ids else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[keep], kinds[keep], strict=True)], names=list(names[keep]))

    schema = PIECE + (", ids array<bigint>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for all pieces of a histogram of lengths, as rows

    (length, first rank, pieces, pieces per sequence, first sequence, offset): the pieces of that length with ranks
    from `first rank` on fill consecutive sequences, so many in each, from that offset on.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, number) with that gap
    order: list[int] = []

    def put(n: int, pieces: int, each: int, first: int, offset: int) -> None:
        rows.append((n, used[n], pieces, each, first, offset))
        used[n] += pieces
        left[n] -= pieces

    def leave(gap: int, first: int, number: int) -> None:
        if number and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    ascending = large[::-1]
    for n in large:
        while left[n]:
            at = bisect_left(ascending, capacity - n + 1) - 1
            while at >= 0 and (ascending[at] > n or not left[ascending[at]] or ascending[at] == n and left[n] < 2):
                at -= 1
            if at < 0:
                number = left[n]
                put(n, number, 1, sequences, 0)
                leave(capacity - n, sequences, number)
            elif ascending[at] == n:
                number = left[n] // 2
                put(n, 2 * number, 2, sequences, 0)
                leave(capacity - 2 * n, sequences, number)
            else:
                other = ascending[at]
                number = min(left[n], left[other])
                put(n, number, 1, sequences, 0)
                put(other, number, 1, sequences, n)
                leave(capacity - n - other, sequences, number)
            sequences += number
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first = capacity, sequences
                number = -(-left[n] // (capacity // n))
                sequences += number
            each = gap // n
            whole = min(number, left[n] // each)
            if whole:
                put(n, whole * each, each, first, capacity - gap)
                leave(gap - each * n, first, whole)
            if whole < number and 0 < (rest := left[n]):
                put(n, rest, rest, first + whole, capacity - gap)
                leave(gap - rest * n, first + whole, 1)
                whole += 1
            leave(gap, first + whole, number - whole)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def place(made: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    span = int(made[:, 1].max(initial=0) + ranks.max(initial=0)) + 1
    at = np.searchsorted(made[:, 0] * span + made[:, 1], lengths * span + ranks, side="right") - 1
    n, first_rank, _, each, first, offset = made[at].T
    return first + (ranks - first_rank) // each, offset + (ranks - first_rank) % each * n


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """All pieces with the sequence and offset they are placed at: PIECE columns, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    cut_up, _ = materialize(spark, pieces(docs, tokenizer_path, capacity, end_id, with_ids=with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    made = plan(by_length, capacity)
    chunks = max(256, sum(by_length.values()) // 20_000)
    chunked = cut_up.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    counts = chunked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "chunk").orderBy("row")
    ranked = chunked.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("own"))
    names = [c for c in cut_up.columns if c != "row"]
    schema = PIECE + (", ids array<bigint>" if with_ids else "") + ", sequence_id bigint, offset bigint"

    def run(batches):
        for b in batches:
            b = pa.Table.from_batches([b])
            if not b.num_rows:
                continue
            sequence, offset = place(made, b["length"].to_numpy(), b["rank"].to_numpy())
            out = b.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    return ranked.select(*names, "rank").mapInArrow(run, schema)
