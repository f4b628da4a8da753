"""Token ids against the tokenizers library; packing against its law and a plain best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm.packing import LONG_SPACE, cut, pack, place, plan, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def theirs():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library():
    lib, dice = theirs(), random.Random(3)
    letters = ["a", "The", " ", "  ", "\n", "\t", "é", "語", "🙂", "1", "'s", "'LL", "<|endoftext|>", " ", "　", "\r\n", "\0", "!", "³", "x" * 40]
    for text in ["", *("".join(dice.choice(letters) for _ in range(dice.randint(1, 40))) for _ in range(800))]:
        assert token_ids(PATH, text, 2).tolist() == [*lib.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def laid_out(counts, capacity):
    made, fill = plan(counts, capacity), defaultdict(list)
    for n, c in counts.items():
        for s, o in zip(*place(made, np.full(c, n), np.arange(c)), strict=True):
            fill[int(s)].append((int(o), n))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in parts) <= 2
    return len(fill)


def test_plan_is_gapless_and_tight():
    dice = random.Random(1)
    for _ in range(300):
        capacity = dice.choice([8, 30, 100])
        counts = {n: dice.randint(1, 40) for n in dice.sample(range(1, capacity + 1), dice.randint(1, capacity))}
        bins = laid_out(counts, capacity)
        items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        rest = []  # best fit, longest first
        for n in items:
            fit = min((g for g in rest if g >= n), default=None)
            if fit is not None:
                rest.remove(fit)
            rest.append((capacity if fit is None else fit) - n)
        assert -(-sum(items) // capacity) <= bins <= len(rest) * 1.02 + 1
    assert laid_out({}, 10) == 0


def test_pack_rows(spark):
    dice = random.Random(9)
    texts = ["", None, "one", "one", "one", *(" ".join(dice.choice(["alpha", "beta", "né"]) for _ in range(dice.randint(1, 2500))) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece int, length string")
    lib, got = theirs(), pack(docs, PATH, with_ids=True).collect()
    seen, fill = defaultdict(dict), defaultdict(list)
    for r in got:
        seen[r.doc_id][r.piece] = r
        fill[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, text in enumerate(texts):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert [(seen[i][p].start, seen[i][p].length) for p in sorted(seen[i])] == cut(len(ids), 1024)
        assert sum((seen[i][p].ids for p in sorted(seen[i])), []) == ids
    for parts in fill.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert pack(docs.limit(0), PATH).count() == 0


def test_very_long_texts(spark):
    lib = theirs()
    texts = ["\n" * 2_000_000, "x" + " " * 1_200_000 + "y", "a" * 300_000, "word " * 200_000, " " * LONG_SPACE, "\t" * (LONG_SPACE - 1) + "<|endoftext|>", "語" * 100_000 + "\u3000" * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(dict)
    for r in pack(docs, PATH, with_ids=True).collect():
        got[r.doc_id][r.piece] = r.ids
    for i, text in enumerate(texts):
        assert sum((got[i][p] for p in sorted(got[i])), []) == [*lib.encode(text, add_special_tokens=False).ids, 2]


def test_repeated_rows_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "one two")] * 3 + [(None, "one two"), (None, "other"), (1, "third")], "doc_id long, text string")
    got = pack(docs, PATH).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1, 1, 1]
    places = sorted((r.offset, r.length) for r in got)
    assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and len({r.sequence_id for r in got}) == 1
