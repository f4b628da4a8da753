"""Sets of word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from quillon.llm.common import mix64, runs, utf8

_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: A-Z count as a-z.
_LETTERS[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Bytes of text that are worked on at once, but for a longer text.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _BASE), np.full(1 << bits, _BACK)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for texts of fewer than 2^bits bytes. A worker keeps one table, which does for all usual pieces."""
    return _table(max(bits, PIECE.bit_length()))


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z lowered, and n + 1 positions where each text's words begin.

    between: for each byte, whether it stands between words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(max(16, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[:n], out=total[1:])
    length = (last - first).astype(np.uint64)
    return mix64((total[last] - total[first]) * down[first] + length), np.searchsorted(first, offsets)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    word, bounds = words(data, offsets)
    n = len(word)
    chain = np.full(n, np.uint64(size))
    for k in range(size):
        if n > k:
            chain[: n - k] = mix64(chain[: n - k] * np.uint64(0x2545F4914F6CDD1D) + word[k:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            got = np.sort(chain[a : b - size + 1])
            out.append(got[np.concatenate([[True], got[1:] != got[:-1]])])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix64(whole * np.uint64(0x2545F4914F6CDD1D) + word[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column, size: int, most: int = PIECE):
    """The set of each text of an Arrow column: sorted hashes of its distinct shingles of `size` words.

    A shorter text is one shingle; a text without words, or null, has none.
    """
    data, offsets = utf8(column)
    for a, b in runs(np.diff(offsets), most):
        yield from _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
