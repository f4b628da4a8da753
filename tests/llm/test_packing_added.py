"""Added tokens in texts, against the tokenizers library as it is loaded."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm.packing import pack, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_in_text_are_those_of_the_library(spark):
    lib, dice = Tokenizer.from_file(PATH), random.Random(5)
    letters = ["a", "The", " ", "  ", "\n", "é", "語", "1", "'s", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "<|", "|>", "\r\n", "\0", "!"]
    texts = ["hello <|endoftext|> world", *("".join(dice.choice(letters) for _ in range(dice.randint(1, 30))) for _ in range(300))]
    want = [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert want[0] == [31373, 220, 50256, 995, 2]
    assert [token_ids(PATH, t, 2).tolist() for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in pack(docs, PATH, with_ids=True).collect()} == dict(enumerate(want[:40]))
