"""Intervals, maximal repeats and coverage against brute force."""

import random

import numpy as np

from quillon.llm.suffix import Repeats, _grid, common, intervals, merge, ordered, repeated


def some(seed, n=9, letters=b"ab\0", most=14):
    """Strings around a common anchor, and its place in each."""
    dice = random.Random(seed)
    side = lambda: bytes(dice.choice(letters) for _ in range(dice.randint(0, most)))
    pool = [side() for _ in range(3)]
    pick = lambda: dice.choice(pool) if dice.random() < 0.6 else side()
    lefts = [pick() for _ in range(n)]
    return [x + b"#" + pick() for x in lefts], np.array([len(x) for x in lefts])


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_order_and_common_prefixes():
    for seed in range(30):
        strings, _ = some(seed, 20)
        grid, sizes = _grid(strings)
        order = ordered(grid, sizes)
        rows = [strings[i] for i in order]
        assert rows == sorted(rows)
        assert common(grid, sizes, order[:-1], order[1:]).tolist() == [shared(a, b) for a, b in zip(rows, rows[1:], strict=False)]


def test_intervals():
    for seed in range(60):
        dice = random.Random(seed)
        lcp = np.array([0] + [dice.randint(0, 5) for _ in range(dice.randint(0, 25))])
        got = intervals(lcp, 2)
        want = set()
        for a in range(len(lcp)):
            for b in range(a + 1, len(lcp)):
                n = lcp[a + 1 : b + 1].min()
                if n >= 2 and (lcp[a] < n) and (b + 1 == len(lcp) or lcp[b + 1] < n):
                    want.add((a, b, int(n)))
        assert len(got) == len(set(got)) and set(got) == want


def test_maximal_repeats_have_all_occurrences():
    for seed in range(150):
        least = 5
        strings, anchor = some(seed)
        r = Repeats(strings, anchor, least)
        got = {(frozenset(r.members[f : l + 1].tolist()), a, b) for f, l, a, b in r.found.tolist()}
        assert len(got) == len(r.found)
        want = set()
        lefts, rights = [s[:p][::-1] for s, p in zip(strings, anchor, strict=True)], [s[p:] for s, p in zip(strings, anchor, strict=True)]
        for a in range(15):
            for b in range(1, 16):
                by = {}
                for i, (x, y) in enumerate(zip(lefts, rights, strict=True)):
                    if len(x) >= a and len(y) >= b:
                        by.setdefault((x[:a], y[:b]), set()).add(i)
                for group in by.values():
                    if len(group) > 1 and a + b >= least:
                        ends = [{z[i][n] if len(z[i]) > n else ("end", i) for i in group} for z, n in ((lefts, a), (rights, b))]
                        if len(ends[0]) > 1 and len(ends[1]) > 1:
                            want.add((frozenset(group), a, b))
        assert got == want, seed


def test_coverage():
    for seed in range(150):
        least = 6
        strings, anchor = some(seed)
        place = np.array(random.Random(seed).sample(range(50), len(strings)))
        row, begin, end = repeated(strings, anchor, place, least)
        got = {(r, i) for r, b, e in zip(row, begin, end, strict=True) for i in range(b, e)}
        want = set()
        for y, (s, p) in enumerate(zip(strings, anchor, strict=True)):
            for x, (t, q) in enumerate(zip(strings, anchor, strict=True)):
                if place[x] < place[y]:
                    a, b = shared(s[:p][::-1], t[:q][::-1]), shared(s[p:], t[q:])
                    if a + b >= least:
                        want |= {(y, i) for i in range(p - a, p + b)}
        assert got == want


def test_merge():
    r, b, e = merge(np.array([1, 0, 0, 0]), np.array([0, 5, 0, 9]), np.array([4, 9, 3, 12]))
    assert (r.tolist(), b.tolist(), e.tolist()) == ([0, 0, 1], [0, 5, 0], [3, 12, 4])
    assert len(repeated([], np.zeros(0, np.int64), np.zeros(0, np.int64), 3)[0]) == 0
