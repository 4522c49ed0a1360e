"""Texts with more distinct words than a worker's table holds."""

import string

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hirelane.llm.wordtok import WordTable

PATH = public_tokenizers.path("word_bpe_49k.json")


def word(i):
    out = ""
    for _ in range(5):
        out += string.ascii_lowercase[i % 26]
        i //= 26
    return out


@pytest.mark.parametrize("between", [" ", "!"])
def test_a_text_of_very_many_distinct_words(between):
    text = between.join(word(i * 7919 % 11881376) for i in range(1_200_000))
    texts = ["before", text, f"<|endoftext|>{text[:1000]}", "after"]
    library = Tokenizer.from_file(PATH)
    got = dict(WordTable(PATH).encode_all(texts))
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_the_table_grows_within_one_piece(monkeypatch):
    from hirelane.llm import wordtok

    monkeypatch.setattr(wordtok, "_SLOTS", 64)
    text = " ".join(word(i) for i in range(500))
    got = dict(WordTable(PATH, most=10).encode_all([text, text]))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert all(np.frombuffer(got[i], "<u4").tolist() == want for i in (0, 1))
