"""Encoding against the sentencepiece library; spans against the source bytes."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T

from quillon.llm.pieces import CharacterMap, Encoder, encode, encode_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n x", "▁", "a▁b", "▁ ▁", "é", "日本語 テキスト", "\0", "a\0b", "<s> </s> <unk>", "<0x0A>", "👩‍🔬 ok", "\t tab", "x" * 700, "ab" * 400, " " * 40, "word " * 300, "﻿", "�"]


@pytest.fixture(scope="module")
def both():
    return Encoder(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_as_library(both):
    ours, theirs = both
    dice = random.Random(5)
    letters = ["a", "e", "th", " ", " ", "  ", "▁", "\n", "é", "ß", "語", "🙂", "0", "<", ">", "\0", "ing"]
    texts = EDGES + ["".join(dice.choice(letters) for _ in range(dice.randint(1, 60))) for _ in range(600)]
    for text in texts:
        ids, begins, ends, decimals = ours.encode(text)
        want = theirs.encode(text)
        assert ids.tolist() == want, repr(text)
        assert decimals.decode() == ",".join(map(str, want))
        assert ours.model.decode(want).decode() == theirs.decode(want), repr(text)
        # the spans tile the source
        if len(text):
            assert begins[0] == 0 and ends[-1] == len(text.encode())
            assert (begins[1:] == ends[:-1]).all() and (begins <= ends).all()


def test_decode_of_broken_bytes(both):
    ours, theirs = both
    dice = random.Random(6)
    for _ in range(300):
        ids = [dice.choice([dice.randint(3, 258), 29871, 263, 1, 2, 0, 411]) for _ in range(dice.randint(1, 9))]
        assert ours.model.decode(ids).decode() == theirs.decode(ids), ids


def test_character_map_takes_the_longest_prefix():
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from quillon.llm.pieces import Model, _fields

    blob = next(v for n, v in _fields(spec.serialized_model_proto()) if n == 3)
    model = Model.__new__(Model)
    model.map = CharacterMap(next(v for n, v in _fields(blob) if n == 2))
    model.squeeze, model.dummy = False, False
    for text in ["ﬁne ㍿ ①", "Å Å", "ガガ", "plain", "ｆｕｌｌ　width"]:
        flat, source = model.normalise(text.encode())
        assert flat.decode().replace("▁", " ") == spec.normalize(text)
        assert len(source) == len(flat) + 1 and source == sorted(source) and source[-1] == len(text.encode())


def test_query_rows(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(EDGES)] + [(100, None, None, None), (101, "a  b", "x", 2)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.IntegerType())])
    docs = spark.createDataFrame(rows, schema)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: r for r in encode_digests(docs, PATH).collect()}
    full = {r.doc_id: r for r in encode(docs, PATH).collect()}
    assert len(got) == len(full) == len(rows)
    for i, text, *_ in rows:
        want = lib.encode(text or "")
        assert got[i].n_tokens == len(want) and full[i].ids == want and full[i].decoded == lib.decode(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert encode_digests(docs.limit(0), PATH).count() == 0


def mapped():
    """The vocabulary with the character map of NFKC: messages of a protocol buffer merge when they follow each other."""
    from quillon.llm.pieces import _fields

    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False)
    blob = next(v for n, v in _fields(spec.serialized_model_proto()) if n == 3)
    trie = next(v for n, v in _fields(blob) if n == 2)

    def field(number, value):
        size, out = len(value), bytearray([number << 3 | 2])
        while size >= 128:
            out.append(size & 127 | 128)
            size >>= 7
        return bytes(out) + bytes([size]) + value

    return open(PATH, "rb").read() + field(3, field(2, trie))


def test_offsets_through_a_character_map(spark, tmp_path):
    """Ids and spans of every piece, with a map that lengthens, shortens and joins characters, against the library."""
    path = tmp_path / "mapped.model"
    path.write_bytes(mapped())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    dice = random.Random(8)
    letters = ["a", " ", "the", "ﬁ", "㍿", "①", "Å", "ガ", "ｆｕｌｌ", "é", "\u3000", "½", "\u00ad", "語", "🙂"]
    texts = ["ﬁne ㍿ ①", "ｆｕｌｌ　width ½", "", "plain text", *("".join(dice.choice(letters) for _ in range(dice.randint(1, 40))) for _ in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in encode(docs, str(path)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert r.ids == lib.encode(text), repr(text)
        assert r.decoded == lib.decode(r.ids), repr(text)
        if r.ids:
            raw = text.encode()
            assert r.begins[0] == 0 and r.ends[-1] == len(raw) and r.begins[1:] == r.ends[:-1]
            assert [(p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces] == list(zip(r.begins, r.ends, strict=True)), repr(text)


def test_long_texts_repeats_and_missing_ids(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["word " * 300_000, "ab" * 100_000, "\n" * 300_000, "語" * 100_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "a b"), (0, "a b")], "doc_id long, text string")
    got = encode_digests(docs, PATH).collect()
    assert len(got) == 7 and sum(r.doc_id is None for r in got) == 2
    want = {(i, hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest()) for i, t in [*enumerate(texts), (None, "a b"), (0, "a b")]}
    assert {(r.doc_id, r.ids_sha256) for r in got} == want
