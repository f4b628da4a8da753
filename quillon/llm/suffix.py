"""Sparse enhanced suffix arrays and the maximal repeats they hold.

Every string has one suffix in the array: the one that starts at its anchor. The suffixes are sorted, and the common
prefixes of neighbours give, in one scan with a stack, the tree of common-prefix intervals. In each interval the texts
to the left of the anchors are ordered likewise, read backwards, which tests them for left extension: where the bytes
before two members differ, the interval parts. What remains are maximal repeats, each with all its occurrences.
"""

from __future__ import annotations

import numpy as np


def _grid(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, filled up with zeros to a multiple of eight, and their lengths."""
    sizes = np.array([len(s) for s in strings], np.int64)
    width = max(8, -(-int(sizes.max(initial=0)) // 8) * 8)
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), sizes


def ordered(grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lexicographic order of the rows."""
    words = np.ascontiguousarray(grid).view(">u8").astype(np.uint64)
    # zero bytes may equal the filling; the shorter row then goes first
    return np.lexsort([sizes, *words.T[::-1]])


def common(grid: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of rows a and rows b."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        differs = grid[x] != grid[y]
        first = differs.argmax(axis=1)
        first[~differs[np.arange(len(x)), first]] = grid.shape[1]
        out[at : at + (1 << 14)] = np.minimum(first, np.minimum(sizes[x], sizes[y]))
    return out


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of all common-prefix intervals of at least `least`: one scan with a stack.

    lcp[i] is the common prefix of i - 1 and i. Every maximal run of positions that share exactly `length` comes once.
    """
    out: list[tuple[int, int, int]] = []
    high = np.flatnonzero(lcp >= least)
    stack: list[tuple[int, int]] = []  # length, first
    previous = -2
    for i, n in zip(high.tolist(), lcp[high].tolist(), strict=True):
        if i != previous + 1:
            out += [(first, previous, length) for length, first in stack]
            stack = [(n, i - 1)]
        elif n != stack[-1][0]:
            first = i - 1
            while stack and stack[-1][0] > n:
                length, first = stack.pop()
                out.append((first, i - 1, length))
            if not stack or stack[-1][0] < n:
                stack.append((n, first))
        previous = i
    out += [(first, previous, length) for length, first in stack]
    return out


class Repeats:
    """Maximal repeats of at least `least` bytes through the anchors of strings.

    anchor: the place of each string's anchor in it. Every repeat has members[first : last + 1], strings that agree in
    `left` bytes before and `right` bytes from their anchors, and in no more on either side.
    """

    def __init__(self, strings: list[bytes], anchor: np.ndarray, least: int):
        places = anchor.tolist()
        right, n_right = _grid([s[p:] for s, p in zip(strings, places, strict=True)])
        left, n_left = _grid([s[:p][::-1] for s, p in zip(strings, places, strict=True)])
        order = ordered(right, n_right)
        lcp = np.concatenate([[0], common(right, n_right, order[:-1], order[1:])])
        nodes = intervals(lcp, max(1, least - int(n_left.max(initial=0))))
        size = np.array([last - first + 1 for first, last, _ in nodes], np.int64)
        node = np.repeat(np.arange(len(nodes)), size)
        begin = np.array([first for first, _, _ in nodes], np.int64)
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        depth = np.array([length for _, _, length in nodes], np.int64)[node]
        # within a node, a child begins where neighbours share no more than the node does
        child = np.cumsum((lcp[at] == depth) | (at == begin[node]))
        member = order[at]
        back = np.empty(len(strings), np.int64)
        back[ordered(left, n_left)] = np.arange(len(strings))
        turn = np.lexsort([back[member], node])
        self.members, node, depth, child = member[turn], node[turn], depth[turn], child[turn]
        together = np.flatnonzero(node[1:] == node[:-1])
        total = np.zeros(len(node), np.int64)
        total[together + 1] = common(left, n_left, self.members[together], self.members[together + 1]) + depth[together + 1]
        # members of a node agree in its depth to the right, so totals compare what they share to the left
        found = np.array(intervals(total, least), np.int64).reshape(-1, 3)
        if len(found):
            # members of one child agree in more to the right, so they are a repeat of that child
            ends = np.stack([found[:, 0], found[:, 1] + 1], axis=1).ravel()
            padded = np.append(child, child[-1])
            found = found[np.minimum.reduceat(padded, ends)[::2] != np.maximum.reduceat(padded, ends)[::2]]
        #: first and last member, bytes to the left, bytes to the right
        self.found = np.column_stack([found[:, :2], found[:, 2] - depth[found[:, 0]], depth[found[:, 0]]])


def repeated(strings: list[bytes], anchor: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What all but the first occurrence of each maximal repeat cover: string, begin and end in it, sorted and merged.

    place: the order of the strings' anchors in the corpus, all different.
    """
    r = Repeats(strings, anchor, least)
    width = int(r.found[:, 2].max(initial=0)) + 1
    reach = np.zeros(len(strings) * width, np.int32)  # for each string and bytes to the left, the most to the right
    size = r.found[:, 1] - r.found[:, 0] + 1
    upto = np.cumsum(size)
    begin = 0
    while begin < len(size):  # so many at once that memory stays small
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + (1 << 20))))
        first, _, left, right = r.found[begin:end].T
        n = size[begin:end]
        starts = np.cumsum(n) - n
        member = r.members[np.repeat(first - starts, n) + np.arange(int(n.sum()))]
        when = place[member]
        later = when != np.repeat(np.minimum.reduceat(when, starts), n)
        np.maximum.at(reach, (member * width + np.repeat(left, n))[later], np.repeat(right, n)[later].astype(np.int32))
        begin = end
    at = np.flatnonzero(reach)
    member, left = at // width, at % width
    return merge(member, anchor[member] - left, anchor[member] + reach[at])


def merge(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted intervals, overlapping or touching ones of a row joined."""
    if not len(row):
        return row.astype(np.int64), begin.astype(np.int64), end.astype(np.int64)
    order = np.lexsort([begin, row])
    row, begin, end = row[order].astype(np.int64), begin[order].astype(np.int64), end[order].astype(np.int64)
    base = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], base[1:] + begin[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return row[first], begin[first], reach[last] - base[first]
